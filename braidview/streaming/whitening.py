"""Running whitening of a stream of feature rows, on Structured Streaming's micro-batches.

The last ``capacity`` rows are a queue: each micro-batch gives its rows with the highest sequence numbers, at most ``capacity`` of them, so what the driver holds is bounded
by that parameter. Mean and covariance of the queue, shrunk towards the sphere, feed moving averages. The state is written after every batch to a folder
if one is given, with the batch's number, so a restarted query goes on from it and a repeated batch is left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import value, weighted_sum


class FeatureQueue:
    """The newest ``capacity`` rows, oldest first."""

    def __init__(self, capacity: int, width: int) -> None:
        self.capacity, self.rows = capacity, np.zeros((0, width))

    def push(self, rows: np.ndarray) -> None:
        self.rows = np.concatenate([self.rows, np.asarray(rows, dtype=float)])[-self.capacity :]

    def __len__(self) -> int:
        return len(self.rows)


@dataclass
class WhiteningStats:
    """Moving mean and covariance of a queue; nothing moves before ``least`` rows are there."""

    width: int
    shrinkage: float = 0.1
    eps: float = 1e-4
    rate: float = 0.02
    least: int = 128
    mean: np.ndarray | None = None
    cov: np.ndarray | None = None

    def update(self, rows: np.ndarray) -> bool:
        if len(rows) < self.least:
            return False
        mean = rows.mean(axis=0)
        cov = np.atleast_2d(np.cov(rows, rowvar=False))
        cov = (1 - self.shrinkage) * cov + self.shrinkage * np.trace(cov) / self.width * np.eye(self.width) + self.eps * np.eye(self.width)
        if self.mean is None:
            self.mean, self.cov = mean, cov
        else:
            self.mean, self.cov = (1 - self.rate) * self.mean + self.rate * mean, (1 - self.rate) * self.cov + self.rate * cov
        return True

    def matrix(self) -> np.ndarray:
        """The symmetric whitening matrix."""
        w, v = np.linalg.eigh(self.cov)
        return v @ np.diag(1.0 / np.sqrt(w.clip(min=1e-12))) @ v.T


def rotation(skew: np.ndarray) -> np.ndarray:
    """exp of the skew part of a matrix: a rotation, by scaling and squaring."""
    a = (skew - skew.T) / 2.0
    halvings = max(0, int(np.ceil(np.log2(max(np.linalg.norm(a), 1e-12)))) + 4)
    a = a / 2**halvings
    out = term = np.eye(len(a))
    for i in range(1, 14):
        term = term @ a / i
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


@dataclass
class StableIca:
    """Whitening refreshed every ``every`` batches, then a rotation that is moved towards independence (tanh contrast)."""

    width: int
    every: int = 8
    rate: float = 0.1
    stats: WhiteningStats | None = None
    skew: np.ndarray | None = None
    white: np.ndarray | None = None
    batches: int = 0

    def __post_init__(self) -> None:
        self.stats = self.stats or WhiteningStats(self.width)
        self.skew = np.zeros((self.width, self.width)) if self.skew is None else self.skew

    def step(self, rows: np.ndarray) -> None:
        ready = self.stats.update(rows)
        if ready and (self.white is None or self.batches % self.every == 0):
            self.white = self.stats.matrix()
        if self.white is not None:
            z = (rows - self.stats.mean) @ self.white @ rotation(self.skew)
            g = np.tanh(z).T @ z / len(z)
            self.skew = self.skew + self.rate * (g - g.T)
        self.batches += 1

    def map(self) -> np.ndarray | None:
        """What centred rows are multiplied by."""
        return None if self.white is None else self.white @ rotation(self.skew)

    def transform(self, df: DataFrame, columns: Sequence[str], prefix: str = "s") -> DataFrame:
        """Independent coordinates s_1 ... as column arithmetic."""
        if self.white is None:
            return df.withColumns({f"{prefix}_{j + 1}": F.coalesce(value(c), F.lit(0.0)) for j, c in enumerate(columns)})
        a = self.map()
        off = self.stats.mean @ a
        return df.withColumns({f"{prefix}_{j + 1}": weighted_sum(columns, a[:, j]) - F.lit(float(off[j])) for j in range(self.width)})


@dataclass
class StreamWhitener:
    """Sink for ``foreachBatch``: keeps queue and statistics, hands each whitened batch on."""

    columns: Sequence[str]
    sequence: str
    capacity: int = 4096
    state_dir: str | None = None
    on_batch: Callable[[DataFrame, int], None] | None = None
    stats: WhiteningStats = field(init=False)
    last: int = -1

    def __post_init__(self) -> None:
        self.queue, self.stats = FeatureQueue(self.capacity, len(self.columns)), WhiteningStats(len(self.columns))
        if self.state_dir:
            self._restore()

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:  # done before a restart
            return
        newest = batch.select(F.col(self.sequence), *[F.coalesce(value(c), F.lit(0.0)).alias(c) for c in self.columns]).orderBy(F.desc(self.sequence)).limit(self.capacity).collect()
        rows = np.array([tuple(r)[1:] for r in reversed(newest)], dtype=float).reshape(-1, len(self.columns))
        self.queue.push(rows)
        self.stats.update(self.queue.rows)
        self.last = number
        if self.state_dir:
            self._save(batch.sparkSession)
        if self.on_batch:
            self.on_batch(self.whiten(batch), number)

    def whiten(self, df: DataFrame, prefix: str = "w") -> DataFrame:
        if self.stats.mean is None:
            return df
        a = self.stats.matrix()
        off = self.stats.mean @ a
        return df.withColumns({f"{prefix}_{c}": weighted_sum(self.columns, a[:, j]) - F.lit(float(off[j])) for j, c in enumerate(self.columns)})

    def _save(self, spark: SparkSession) -> None:
        state = {"last": self.last, "rows": self.queue.rows.tolist(), "mean": None if self.stats.mean is None else self.stats.mean.tolist(), "cov": None if self.stats.cov is None else self.stats.cov.tolist()}
        spark.createDataFrame([(self.last, json.dumps(state))], "last long, state string").coalesce(1).write.mode("append").parquet(self.state_dir)

    def _restore(self) -> None:
        spark = SparkSession.getActiveSession()
        try:
            found = spark.read.schema("last long, state string").parquet(self.state_dir).orderBy(F.desc("last")).limit(1).collect()
        except Exception as e:  # nothing was saved yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return
        if found:
            state = json.loads(found[0]["state"])
            self.last = state["last"]
            self.queue.push(np.array(state["rows"], dtype=float).reshape(-1, len(self.columns)))
            self.stats.mean = None if state["mean"] is None else np.array(state["mean"])
            self.stats.cov = None if state["cov"] is None else np.array(state["cov"])


def event_windows(events: DataFrame, time: str, width: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and means of ``value`` over event-time windows with a watermark; works on streams and tables."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", width), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
