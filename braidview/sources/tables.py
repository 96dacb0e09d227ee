"""Sources and sinks: tables, delimited files, artifacts, configurations."""

from __future__ import annotations

import io
import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_matrix(spark: SparkSession, x, prefix: str = "x", key: str = "row_id") -> DataFrame:
    """A small matrix as a table with a row number; NaN becomes null."""
    x = np.asarray(x, dtype=float)
    frame = pd.DataFrame(x, columns=[f"{prefix}{j}" for j in range(x.shape[1])])
    frame.insert(0, key, np.arange(len(x)))
    df = spark.createDataFrame(frame)
    return df.select(key, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in df.columns[1:]])


def read_delimited(spark: SparkSession, paths: str | Sequence[str], schema: str, null: str = "?", header: bool = True) -> DataFrame:
    """Delimited text with a given schema (no inference pass); several paths or a glob are read as one table."""
    return spark.read.csv(list(paths) if not isinstance(paths, str) else paths, schema=schema, nullValue=null, header=header)


def write_delimited(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def read_config(path: str) -> dict:
    """A run's configuration: JSON, or YAML where its library is there."""
    with open(path) as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


#: What a manifest calls each kind of member.
def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, DataFrame):
        return "table"
    if isinstance(value, pd.DataFrame):
        return "data_frame"
    if isinstance(value, np.ndarray):
        return "matrix"
    if isinstance(value, Mapping):
        return "dict"
    if isinstance(value, (list, tuple)) and any(isinstance(v, (np.ndarray, pd.DataFrame, Mapping, list, tuple, DataFrame)) for v in value):
        return "list"
    return "json"


class Store:
    """Small files where Spark reads and writes its tables, on whatever file system a path names."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.jvm, self.conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def put(self, path: str, text: str) -> None:
        where, fs = self._at(path)
        out = fs.create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def get(self, path: str) -> str:
        where, fs = self._at(path)
        data = fs.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()
        finally:
            data.close()

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)


def write_artifact(value: Mapping[str, object], path: str, clear: bool = False, store: Store | None = None) -> str:
    """Write a result as a folder: a file (or Parquet folder) per member and a manifest. Members of lists are numbered from 1.

    All of it goes through Hadoop's file systems, so the folder may lie wherever the executors write tables.
    """
    store = store or Store()
    if clear:
        store.delete(path)
    manifest: dict[str, dict[str, str]] = {}
    for name, v in value.items():
        kind, name = _kind(v), str(name)
        at = f"{path.rstrip('/')}/{name}"
        manifest[name] = {"type": kind}
        if kind == "table":
            v.write.mode("overwrite").parquet(at + ".parquet")
        elif kind == "data_frame":
            store.put(at + ".csv", v.to_csv())
        elif kind == "matrix":
            store.put(at + ".csv", pd.DataFrame(v if v.ndim > 1 else v[:, None]).to_csv())
            manifest[name]["shape"] = json.dumps(list(v.shape))
        elif kind == "dict":
            write_artifact(v, at, store=store)
        elif kind == "list":
            write_artifact({str(i): x for i, x in enumerate(v, 1)}, at, store=store)
        elif kind == "json":
            store.put(at + ".json", json.dumps(v, default=_plain))
    store.put(f"{path.rstrip('/')}/manifest.json", json.dumps(manifest, indent=1))
    return path


def _plain(x: object) -> object:
    if isinstance(x, np.generic):
        return x.item()
    if hasattr(x, "__dict__"):
        return vars(x)
    return str(x)


def read_artifact(path: str, spark: SparkSession | None = None) -> dict[str, object]:
    """Read back what :func:`write_artifact` wrote."""
    store = Store(spark)
    out: dict[str, object] = {}
    for name, m in json.loads(store.get(f"{path.rstrip('/')}/manifest.json")).items():
        at, kind = f"{path.rstrip('/')}/{name}", m["type"]
        if kind == "null":
            out[name] = None
        elif kind == "table":
            out[name] = store.spark.read.parquet(at + ".parquet")
        elif kind == "data_frame":
            out[name] = pd.read_csv(io.StringIO(store.get(at + ".csv")), index_col=0)
        elif kind == "matrix":
            out[name] = pd.read_csv(io.StringIO(store.get(at + ".csv")), index_col=0).to_numpy().reshape(json.loads(m["shape"]))
        elif kind == "json":
            out[name] = json.loads(store.get(at + ".json"))
        else:
            members = read_artifact(at, store.spark)
            out[name] = [members[k] for k in sorted(members, key=int)] if kind == "list" else members
    return out


def long_records(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Wide views as long records (key, name, value), missing values left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("cell")
    return df.select(key, cells).select(key, "cell.name", "cell.value").where(F.col("value").isNotNull())
