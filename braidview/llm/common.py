"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import checkpoint_folder, drop_stored, stored  # noqa: F401

#: White space of the word rules: space, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python a few MB of rows at once (64 MB otherwise): long texts go through buffers on both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two hashes with unlike seeds."""
    return [F.xxhash64(F.lit(11), text).alias("_k1"), F.xxhash64(F.lit(29), text).alias("_k2")]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing names among the rest can't matter."""
    return df.select(*names)
