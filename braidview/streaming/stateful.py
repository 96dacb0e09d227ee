"""Running statistics as state of a stream: Spark keeps, checkpoints and restores them; the driver sees none.

Every key has a queue of its newest ``capacity`` rows (a list state) and the moving statistics made from it (a value state). Before the rows of a
micro-batch go to their keys' tasks, each task keeps the newest ``capacity`` of every key, so that a key which all rows share brings no more than that from a task. A query that
is stopped and started again from its checkpoint goes on as if it hadn't been.

The state store has to be RocksDB's: ``spark.sql.streaming.stateStore.providerClass`` (see :data:`ROCKS`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.columns import value
from .whitening import StableIca, WhiteningStats

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "key string, last long, n long, batches long, mean array<double>, cov array<double>, map array<double>"


class RunningQueue(StatefulProcessor):
    """Queue, moving mean and covariance of a key and, with ``every``, a rotation towards independence; a row a micro-batch.

    ``map`` is the whitening matrix (times the rotation), row after row; null until ``least`` rows are there.
    """

    def __init__(self, width: int, capacity: int, shrinkage: float, rate: float, least: int, every: int | None, turn: float) -> None:
        self.width, self.capacity, self.every = width, capacity, every
        self.settings, self.turn = {"shrinkage": shrinkage, "rate": rate, "least": least}, turn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "seq long, x array<double>")
        self.stats = handle.getValueState("stats", "mean array<double>, cov array<double>, batches long, skew array<double>, white array<double>")

    def _square(self, x) -> np.ndarray | None:
        return None if x is None else np.array(x, dtype=float).reshape(self.width, self.width)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(s), list(x)) for frame in rows for s, x in zip(frame["seq"], frame["x"])]
        came.sort()
        held = sorted([*((int(r[0]), list(r[1])) for r in self.rows.get()), *came])[-self.capacity :]
        self.rows.put(held)
        known = self.stats.get() if self.stats.exists() else (None, None, 0, None, None)
        stats = WhiteningStats(self.width, **self.settings, mean=None if known[0] is None else np.array(known[0]), cov=self._square(known[1]))
        queue = np.array([x for _, x in held], dtype=float).reshape(-1, self.width)
        ica = StableIca(self.width, self.every or 1, self.turn, stats, self._square(known[3]), self._square(known[4]), int(known[2]))
        if self.every:
            ica.step(queue)
        else:
            stats.update(queue)
            ica.batches += 1
        flat = lambda a: None if a is None else a.ravel().tolist()
        self.stats.update((flat(stats.mean), flat(stats.cov), ica.batches, flat(ica.skew), flat(ica.white)))
        turned = None if stats.mean is None else ica.map() if self.every else stats.matrix()
        yield pd.DataFrame({"key": [key[0]], "last": [held[-1][0]], "n": [len(held)], "batches": [ica.batches], "mean": [flat(stats.mean)], "cov": [flat(stats.cov)], "map": [flat(turned)]})

    def close(self) -> None:
        pass


def running_statistics(
    stream: DataFrame, columns: Sequence[str], sequence: str, key: str | None = None, capacity: int = 4096, shrinkage: float = 0.1, rate: float = 0.02, least: int = 128, every: int | None = None, turn: float = 0.1,
) -> DataFrame:
    """A stream of OUT: for each micro-batch and key the state after it. Missing values count as 0, a null key as "".

    ``every``: independent components, whose whitening is renewed every so many batches and whose rotation moves by ``turn``.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    rows = stream.select(name.alias("key"), F.col(sequence).cast("long").alias("seq"), F.array(*[F.coalesce(value(c), F.lit(0.0)) for c in columns]).alias("x"))

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            both = frame if held is None else pd.concat([held, frame])
            held = both.sort_values("seq").groupby("key").tail(capacity)
        if held is not None:
            yield held

    processor = RunningQueue(len(columns), capacity, shrinkage, rate, least, every, turn)
    return rows.mapInPandas(newest, "key string, seq long, x array<double>").groupBy("key").transformWithStateInPandas(processor, outputStructType=OUT, outputMode="Update", timeMode="None")


def run_to_table(stats: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what a stream has now, into a table at ``path``; a later call with the same ``checkpoint`` goes on from there."""
    spark = stats.sparkSession
    provider = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        # a batch that is repeated after a failure writes its own folder anew
        sink = lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        stats.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], provider) if provider else spark.conf.unset(ROCKS[0])


def newest_state(spark: SparkSession, path: str) -> DataFrame:
    """Each key's last state in a table that :func:`run_to_table` wrote."""
    rows = spark.read.schema(OUT + ", batch long").parquet(path)
    return rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "batch").alias("s")).select("key", "s.*")
