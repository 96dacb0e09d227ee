"""Joins, groupings and windows that the analyses need, as plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpoint_folder

def align_views(tables: Sequence[DataFrame], key: str, fill: float | None = 0.0) -> DataFrame:
    """Inner join of views on their key; missing numbers become ``fill``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "inner")
    return out if fill is None else out.fillna(fill).replace(float("nan"), fill)


def overlap(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def lacking(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def clean_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles, what isn't a number as null; rows with any null in them are left out."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in columns}).dropna(subset=list(columns))


def pivot_means(df: DataFrame, rows: str, names: str, values: str, wanted: Sequence[object]) -> DataFrame:
    """Long records to one row per ``rows`` with the mean of ``values`` under each wanted name; the list spares a pass."""
    return df.groupBy(rows).pivot(names, list(wanted)).agg(F.avg(values))


def summarise(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and 1.96 deviations of every measure by group."""
    aggregates = []
    for m in measures:
        aggregates += [F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_sd"), (F.lit(1.96) * F.stddev_samp(m)).alias(f"{m}_ci95")]
    return df.groupBy(*keys).agg(*aggregates)


def summarise_mean_interval(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Mean, deviation, count and half width 1.96 s / sqrt(n) by group."""
    n = F.count(measure)
    return df.groupBy(*keys).agg(F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("sd"), n.alias("n"), (F.lit(1.96) * F.stddev_samp(measure) / F.sqrt(n)).alias("half_width"))


def best_of_groups(df: DataFrame, group: str, setting: str, metric: str) -> DataFrame:
    """Means by group and setting, of which each group keeps its best, ties included."""
    means = df.groupBy(group, setting).agg(F.avg(metric).alias(metric))
    return means.withColumn("_top", F.max(metric).over(Window.partitionBy(group))).where(F.col(metric) == F.col("_top")).drop("_top")


def top_groups(df: DataFrame, keys: Sequence[str], metric: str, n: int = 10) -> DataFrame:
    """The ``n`` groups with the highest mean; a report, so the limit is meant."""
    return df.groupBy(*keys).agg(F.avg(metric).alias(metric)).orderBy(F.desc(metric), *keys).limit(n)


def distinct_in_order(df: DataFrame, column: str, position: str) -> DataFrame:
    """Each value once, with the place where it came first."""
    return df.groupBy(column).agg(F.min(position).alias("first_position"))


def last_mean(df: DataFrame, group: str, order: str, measure: str, n: int = 5) -> DataFrame:
    """Mean of the last ``n`` entries by group."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return df.withColumn("_r", r).where(F.col("_r") <= n).groupBy(group).agg(F.avg(measure).alias(measure))


def rank_positions(df: DataFrame, columns: Sequence[str], key: str, partition: str | None = None) -> DataFrame:
    """Every column's place (from 0) in ascending order, ties by key: cells side by side, one window per column."""
    cells = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x"))
    cells = cells.select(key, "x.name", "x.v")
    return cells.select(key, "name", (F.row_number().over(Window.partitionBy("name").orderBy("v", key)) - 1).alias("rank"))


def top_loadings(v: DataFrame, k: int) -> DataFrame:
    """Of (view, feature, component, loading) the ``k`` largest in size per view and component, with their place."""
    w = Window.partitionBy("view", "component").orderBy(F.desc(F.abs("loading")), "feature")
    return v.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def loading_norms(v: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Count, sizes and density of the loadings by view and component."""
    live = F.abs("loading") > eps
    return v.groupBy("view", "component").agg(
        F.count_if(live).alias("l0"), F.sum(F.abs("loading")).alias("l1"), F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("l2"), F.avg(live.cast("double")).alias("density")
    )


def soft_thresholded(v: DataFrame, q: float) -> DataFrame:
    """Loadings shrunk by the ``q`` quantile of sizes of their view and component."""
    cut = F.percentile(F.abs("loading"), F.lit(q)).over(Window.partitionBy("view", "component"))
    return v.withColumn("loading", F.signum("loading") * F.greatest(F.abs("loading") - cut, F.lit(0.0)))


def feature_importance(v: DataFrame, importance: DataFrame) -> DataFrame:
    """Per view and feature the sum over components of |loading| times the component's importance."""
    return v.join(importance, ["view", "component"]).groupBy("view", "feature").agg(F.sum(F.abs("loading") * F.col("importance")).alias("importance"))


def variance_shares(values: DataFrame, threshold: float) -> DataFrame:
    """Of (view, component, value) the running share of variance (value squared), and whether it reaches the threshold."""
    w = Window.partitionBy("view")
    share = F.sum(F.col("value") * F.col("value")).over(w.orderBy("component")) / F.sum(F.col("value") * F.col("value")).over(w)
    return values.withColumn("share", share).withColumn("enough", F.col("share") >= threshold)


#: Rows of a range that one task numbers, about; ranges whose sizes are sent to all executors, at most.
RANGE_ROWS, SENT_RANGES = 200_000, 100_000


def numbered(df: DataFrame, key: str, *ties: str, place: str = "_place") -> tuple[DataFrame, int]:
    """``df`` with the rows' places from 1 in the order of ``key`` (of any type with an order), then ``ties``; and their number.

    Rows are sorted by ranges of key, ties and a number of their own, so that a key which many rows share is split as well, and checkpointed: partitions stay as they
    are. A row's place is its place in its partition and the sizes of those before it, a table with a row a partition. No task has much more than ``RANGE_ROWS`` rows at
    any size, and numbering itself shuffles nothing more.
    """
    n = df.count()
    if n <= RANGE_ROWS:
        return df.withColumn(place, F.row_number().over(Window.orderBy(key, *ties)).cast("long")), n  # one task's rows
    checkpoint_folder(df.sparkSession)
    order = [key, *ties, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(-(-n // RANGE_ROWS), *order).sortWithinPartitions(*order).drop("_tie").checkpoint()
    # the upper bits name the partition, the lower 33 count its rows
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    before = F.broadcast(before) if -(-n // RANGE_ROWS) <= SENT_RANGES else before
    at = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(before, "_part").withColumn(place, at).drop("_part", "_id", "_before").select(*df.columns, place), n


def split_rows(df: DataFrame, key: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Rows in the order of their key cut at floor(n * cumulative share); the last part takes the rest."""
    rows, n = numbered(df, key)
    cut, label, bounds = 0, F.lit(names[-1]), []
    for s in shares[:-1]:
        cut += int(n * s)
        bounds.append(cut)
    for b, name in reversed(list(zip(bounds, names))):
        label = F.when(F.col("_place") <= b, F.lit(name)).otherwise(label)
    return rows.withColumn("part", label).drop("_place")


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays within the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
