"""Scaling of views, with provenance: fitted in one or two passes, applied as plain column arithmetic."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.gram import Moments
from ..functions.linalg import l1_columns
from .columns import value
from .moments import Filled, filled, first_values, gapped_sums, second_moments

METHODS = ("none", "norm", "np", "sqrtnp", "center", "centerAndScale", "eigenvalue")


@dataclass
class Scaling:
    """What a fitted view needs to scale new rows: x -> (fill(x) - shift) * factor, column by column."""

    columns: list[str]
    methods: list[str]
    nan_fill: float
    shift: list[float]
    factor: list[float]
    steps: dict[str, object] = field(default_factory=dict)

    def as_dict(self) -> dict[str, object]:
        return asdict(self)

    def apply(self, df: DataFrame) -> DataFrame:
        made = {c: (F.coalesce(value(c), F.lit(self.nan_fill)) - F.lit(m)) * F.lit(f) for c, m, f in zip(self.columns, self.shift, self.factor)}
        return df.withColumns(made)


def derived(df: DataFrame) -> bool:
    """Whether rows come out of joins, groupings or the like, so that reading them again means working them out again."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return any(re.match(r"[\s:+|-]*(Join|Aggregate|Window|Generate|MapIn|FlatMap)", x) for x in lines)


@contextmanager
def held(df: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """The named columns of ``df`` for several passes; kept in memory and on the executors' disks meanwhile if they are :func:`derived`, read anew from plain tables."""
    rows = df.select(*[f"`{c}`" for c in columns])
    if not derived(rows):
        yield rows
        return
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def global_means(df: DataFrame, views: Mapping[str, Sequence[str]]) -> dict[str, float]:
    """Per view the mean of all cells that hold a number, 0 if none does; one pass for all views."""
    every = [c for cs in views.values() for c in cs]
    row = df.agg(*[f(value(c)).alias(f"{k}{i}") for i, c in enumerate(every) for k, f in (("s", F.sum), ("n", F.count))]).first()
    out, at = {}, 0
    for v, cs in views.items():
        n = sum(row[f"n{at + i}"] for i in range(len(cs)))
        out[v] = sum(row[f"s{at + i}"] or 0.0 for i in range(len(cs))) / n if n else 0.0
        at += len(cs)
    return out


def fit_scalings(df: DataFrame, views: Mapping[str, Sequence[str]], methods: Sequence[str] = ("centerAndScale", "np"), moments: bool = False) -> tuple[dict[str, Scaling], Moments | None]:
    """Scalings of all views, and their centred cross-products where ``moments`` or a method asks for them.

    With cross-products one pass gives everything; without, two passes inside the JVM do. The cross-products are those of the scaled views, centred whether or not the
    methods centre.
    """
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown scaling {unknown}")
    every = [c for cs in views.values() for c in cs]
    cuts = [0, *np.cumsum([len(cs) for cs in views.values()]).tolist()]
    if moments or {"norm", "eigenvalue"} & set(methods):
        with held(df, list(dict.fromkeys(every))) as rows:
            shift = first_values(rows, every)
            sums = np.zeros((2 * len(every) + 1) ** 2)
            for r in gapped_sums(rows, every, shift).collect():  # columns times columns at most
                sums[r["at"]] = r["v"]
        return scaled_moments(filled(sums.reshape(2 * len(every) + 1, -1), shift, cuts), views, methods, moments)
    with held(df, list(dict.fromkeys(every))) as rows:
        fills = global_means(rows, views)
        there = rows.select(*[F.coalesce(value(c), F.lit(fills[v])).alias(c) for v, cs in views.items() for c in cs])
        stats = there.agg(F.count("*").alias("n"), *[f(f"`{c}`").alias(f"{k}{i}") for i, c in enumerate(every) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    means, stds = (np.array([stats[f"{k}{i}"] or 0.0 for i in range(len(every))]) for k in "ms")
    return {v: _scaling(list(cs), methods, fills[v], stats["n"], means[a:b], stds[a:b], None) for (v, cs), a, b in zip(views.items(), cuts, cuts[1:])}, None


def scaled_moments(f: Filled, views: Mapping[str, Sequence[str]], methods: Sequence[str], moments: bool = True) -> tuple[dict[str, Scaling], Moments | None]:
    """Scalings and moments from what one pass tells."""
    cuts = [0, *np.cumsum([len(cs) for cs in views.values()]).tolist()]
    out = {v: _scaling(list(cs), methods, fill, f.n, f.mean[a:b], f.std[a:b], f.gram[a:b, a:b]) for (v, cs), fill, a, b in zip(views.items(), f.fills, cuts, cuts[1:])}
    return out, Moments(f.gram, cuts, f.n).scaled([np.array(s.factor) for s in out.values()]) if moments else None


def array_scalings(views: Mapping[str, np.ndarray], names: Mapping[str, Sequence[str]], methods: Sequence[str] = ("centerAndScale", "np")) -> tuple[dict[str, Scaling], Moments]:
    """:func:`fit_scalings` with moments for small views that the driver holds as arrays; NaN is missing."""
    filled, fills = [], {}
    for v, x in views.items():
        x = np.asarray(x, dtype=float)
        there = np.isfinite(x)
        fills[v] = float(x[there].mean()) if there.any() else 0.0
        filled.append(np.where(there, x, fills[v]))
    wide = np.hstack(filled)
    n, means = len(wide), wide.mean(axis=0)
    stds = wide.std(axis=0, ddof=1) if n > 1 else np.zeros(wide.shape[1])
    gram = (wide - means).T @ (wide - means)
    cuts = [0, *np.cumsum([x.shape[1] for x in filled]).tolist()]
    out = {v: _scaling(list(names[v]), methods, fills[v], n, means[a:b], stds[a:b], gram[a:b, a:b]) for v, a, b in zip(views, cuts, cuts[1:])}
    return out, Moments(gram, cuts, n).scaled([np.array(s.factor) for s in out.values()])


def fit_scaling(df: DataFrame, columns: Sequence[str], methods: Sequence[str] = ("centerAndScale", "np")) -> Scaling:
    return fit_scalings(df, {"view": columns}, methods)[0]["view"]


def _scaling(columns: list[str], methods: Sequence[str], fill: float, n: int, mean: np.ndarray, std: np.ndarray, gram: np.ndarray | None) -> Scaling:
    p = len(columns)
    shift, factor, steps = np.zeros(p), np.ones(p), {}
    for m in methods:
        if m == "none":
            continue
        if m == "np":
            steps["np_factor"] = float(n * p)
            factor = factor / (n * p)
        elif m == "sqrtnp":
            steps["sqrtnp_factor"] = math.sqrt(n * p)
            factor = factor / math.sqrt(n * p)
        elif m in ("center", "centerAndScale"):
            now = (mean - shift) * factor
            shift = mean.copy()
            steps["center_mean" if m == "center" else "cas_mean"] = now.tolist()
            if m == "centerAndScale":
                spread = std * np.abs(factor)
                spread = np.where(spread < 1e-10, 1.0, spread)
                steps["cas_std"] = spread.tolist()
                factor = factor / spread
        else:
            off = (mean - shift)[:, None]
            now = (gram + n * off @ off.T) * np.outer(factor, factor)
            if m == "norm":
                size = math.sqrt(max(np.trace(now), 0.0)) + 1e-10
                steps["norm_factor"] = size
            else:
                size = float(np.sqrt(np.linalg.eigvalsh((now + now.T) / 2).clip(min=0.0)).sum()) + 1e-10
                steps["eigen_factor"] = size
            factor = factor / size
    steps["scaled_mean"] = ((mean - shift) * factor).tolist()
    return Scaling(columns, list(methods), fill, shift.tolist(), factor.tolist(), steps)


def impute_column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become their column's mean; one pass and a map."""
    row = df.agg(*[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({c: F.coalesce(value(c), F.lit(row[f"m{i}"])) for i, c in enumerate(columns)})


def usable_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of the columns with at least two numbers that aren't all equal."""
    row = df.agg(*[f(value(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("p", F.stddev_pop), ("m", F.avg), ("s", F.stddev_samp))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns) if row[f"n{i}"] > 1 and (row[f"p{i}"] or 0.0) > 0.0}


def standardise_block(df: DataFrame, columns: Sequence[str], policy: str = "drop") -> tuple[DataFrame, list[str]]:
    """z scores of a block's columns, missing ones as 0; useless columns are dropped, or set to zero."""
    if policy not in ("drop", "zero"):
        raise ValueError("policy is drop or zero")
    good = usable_columns(df, columns)
    if not good:
        raise ValueError("no usable column is left")
    scaled = {c: F.coalesce((value(c) - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, (m, s) in good.items()}
    if policy == "drop":
        return df.withColumns(scaled).drop(*[c for c in columns if c not in good]), list(good)
    return df.withColumns(scaled | {c: F.lit(0.0) for c in columns if c not in good}), list(columns)


def residualise(df: DataFrame, columns: Sequence[str], covariates: str | Sequence[str]) -> DataFrame:
    """Columns less their least-squares fit (with intercept) on the covariates: a list, "a + b", or "mean" for the row mean of the columns.

    One pass gathers the normal equations, the residuals are a map.
    """
    if covariates == "mean":
        total = sum((value(c) for c in columns[1:]), value(columns[0]))
        df, names = df.withColumn("_row_mean", total / len(columns)), ["_row_mean"]
    else:
        names = [c.strip() for c in covariates.split("+")] if isinstance(covariates, str) else list(covariates)
    every = [*names, *[c for c in columns if c not in names]]
    mean_row = df.agg(*[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(every)]).first()
    mean = np.array([mean_row[f"m{i}"] for i in range(len(every))])
    gram, _, _ = second_moments(df, every, mean)
    at = [every.index(c) for c in columns]
    k = len(names)
    slopes = np.linalg.lstsq(gram[:k, :k], gram[:k][:, at], rcond=None)[0]
    made = {}
    for j, c in enumerate(columns):
        out = value(c) - F.lit(float(mean[at[j]]))
        for i, name in enumerate(names):
            out = out - (value(name) - F.lit(float(mean[i]))) * F.lit(float(slopes[i, j]))
        made[c] = out
    return df.withColumns(made).drop("_row_mean")


def l1_normalise(v: np.ndarray) -> np.ndarray:
    return l1_columns(v)


def apply_all(df: DataFrame, scalings: Mapping[str, Scaling]) -> DataFrame:
    for s in scalings.values():
        df = s.apply(df)
    return df
