"""Synthetic multi-view tables with known truth. Noise is a hash of row, seed and place, so it does not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Case:
    """A table with key ``row_id``, view columns, truth columns ``t_1`` ... and outcome ``y``."""

    df: DataFrame
    views: dict[str, list[str]]
    truth: list[str]
    bases: list[np.ndarray]
    kind: str


def uniform(seed: int, place: int, key: str = "row_id") -> Column:
    """Uniform in (0, 1) from a hash."""
    h = F.xxhash64(F.col(key), F.lit(seed), F.lit(place))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, place: int, key: str = "row_id") -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2.0 * F.log(uniform(seed, 2 * place, key))) * F.cos(F.lit(2.0 * math.pi) * uniform(seed, 2 * place + 1, key))


def _table(spark: SparkSession, n: int, k: int, seed: int, prefix: str = "t") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id").withColumns({f"{prefix}_{j + 1}": normal(seed, j) for j in range(k)})


def _project(names: Sequence[str], v: np.ndarray) -> list[Column]:
    return [sum((F.col(t) * F.lit(float(w)) for t, w in zip(names, row)), F.lit(0.0)) for row in v]


def linear_footprint(spark: SparkSession, n: int = 1000, k: int = 3, widths: Sequence[int] = (100, 80, 60), noise: float = 0.5, seed: int = 42) -> Case:
    """Each component loads on its own stretch of a view's features."""
    df, views, bases, place = _table(spark, n, k, seed), {}, [], 1000
    truth = [f"t_{j + 1}" for j in range(k)]
    rng = np.random.default_rng(seed)
    for m, p in enumerate(widths):
        v = np.zeros((p, k))
        for j in range(k):
            own = slice(j * p // k, (j + 1) * p // k)
            v[own, j] = 0.5 + rng.random(len(range(p)[own]))
        views[f"view{m + 1}"] = [f"x{m + 1}_{i}" for i in range(p)]
        df = df.withColumns({c: e + F.lit(noise) * normal(seed, place + i) for i, (c, e) in enumerate(zip(views[f"view{m + 1}"], _project(truth, v)))})
        place += p
        bases.append(v)
    return Case(df.withColumn("y", F.col("t_1") + F.lit(0.1) * normal(seed, place)), views, truth, bases, "linear_footprint")


# How strongly the outcome moves the first component, and the curves of the published cases.
OUTCOME, SQUARE, FREQUENCY, HALF, MIXED_FREQUENCY = 2.0, 0.4, 2.5, 0.5, 2.0


def nonlinear_shared(spark: SparkSession, n: int = 1000, k: int = 3, widths: Sequence[int] = (100, 80, 60), noise: float = 0.5, seed: int = 42, regime: str = "mixed") -> Case:
    """Views see the shared components through curves: polynomial, sinusoidal, a mix by view (straight, squares, sines), or straight. The outcome moves the first component."""
    df, views, bases, place = _table(spark, n, k, seed), {}, [], 1000
    df = df.withColumn("y", normal(seed, 900)).withColumn("t_1", F.col("t_1") + F.lit(OUTCOME) * F.col("y"))
    truth, rng = [f"t_{j + 1}" for j in range(k)], np.random.default_rng(seed)
    for m, p in enumerate(widths):
        v, w = rng.standard_normal((p, k)), rng.standard_normal((p, k))
        straight = _project(truth, v)
        if regime == "polynomial":
            cells = [x + F.lit(SQUARE) * x * x for x in straight]
        elif regime == "sinusoidal":
            cells = [F.sin(F.lit(FREQUENCY) * x) for x in straight]
        elif regime == "mixed" and m:
            bent = [F.col(t) * F.col(t) if m == 1 else F.sin(F.lit(MIXED_FREQUENCY) * F.col(t)) for t in truth]
            cells = [F.lit(HALF) * (x + sum((b * F.lit(float(c)) for b, c in zip(bent, row)), F.lit(0.0))) for x, row in zip(straight, w)]
        else:
            cells = straight
        views[f"view{m + 1}"] = [f"x{m + 1}_{i}" for i in range(p)]
        df = df.withColumns({c: e + F.lit(noise) * normal(seed, place + i) for i, (c, e) in enumerate(zip(views[f"view{m + 1}"], cells))})
        place += p
        bases.append(v)
    return Case(df, views, truth, bases, f"nonlinear_{regime}")


def shared_plus_private(spark: SparkSession, n: int = 1000, k: int = 2, private: int = 2, widths: Sequence[int] = (100, 100), noise: float = 0.5, seed: int = 42) -> Case:
    """Shared components plus some of each view's own; the outcome follows the shared ones."""
    df, views, bases, place = _table(spark, n, k, seed), {}, [], 1000
    truth, rng = [f"t_{j + 1}" for j in range(k)], np.random.default_rng(seed)
    for m, p in enumerate(widths):
        own = [f"p{m + 1}_{j + 1}" for j in range(private)]
        df = df.withColumns({c: normal(seed, place + j) for j, c in enumerate(own)})
        place += private
        v, w = rng.standard_normal((p, k)) / math.sqrt(k), rng.standard_normal((p, private)) / math.sqrt(private)
        views[f"view{m + 1}"] = [f"x{m + 1}_{i}" for i in range(p)]
        both = _project([*truth, *own], np.hstack([v, w]))
        df = df.withColumns({c: e + F.lit(noise) * normal(seed, place + i) for i, (c, e) in enumerate(zip(views[f"view{m + 1}"], both))})
        place += p
        bases.append(v)
    return Case(df.withColumn("y", sum((F.col(t) for t in truth), F.lit(0.0)) + F.lit(0.1) * normal(seed, place)), views, truth, bases, "shared_plus_private")


def correlated_noise(spark: SparkSession, n: int = 1000, k: int = 2, views_n: int = 3, width: int = 20, rho: float = 0.5, noise: float = 1.0, seed: int = 42) -> Case:
    """Noise with correlation ``rho`` between views: a common part and one of each view's own."""
    df, views, bases, place = _table(spark, n, k, seed), {}, [], 1000
    truth, rng = [f"t_{j + 1}" for j in range(k)], np.random.default_rng(seed)
    for m in range(views_n):
        v = rng.standard_normal((width, k))
        views[f"view{m + 1}"] = [f"x{m + 1}_{i}" for i in range(width)]
        common = [normal(seed, 500 + i) for i in range(width)]
        df = df.withColumns(
            {c: e + F.lit(noise) * (F.lit(math.sqrt(rho)) * common[i] + F.lit(math.sqrt(1 - rho)) * normal(seed, place + i)) for i, (c, e) in enumerate(zip(views[f"view{m + 1}"], _project(truth, v)))}
        )
        place += width
        bases.append(v)
    return Case(df.withColumn("y", F.col("t_1")), views, truth, bases, "correlated_noise")


CASES = {
    "linear_footprint": linear_footprint, "linear": linear_footprint, "nonlinear_shared": nonlinear_shared, "nonlinear": nonlinear_shared, "shared_plus_private": shared_plus_private,
    "shared_private": shared_plus_private, "correlated_noise": correlated_noise,
}


def build(spark: SparkSession, kind: str = "nonlinear_shared", **options) -> Case:
    """A case by its name (older names too)."""
    if kind not in CASES:
        raise ValueError(f"unknown case {kind}")
    return CASES[kind](spark, **options)
