"""Cross-products of many columns in one pass.

Each partition adds up one small matrix, row block by row block; the blocks' rows are then summed by place, so no task ever holds more than the
matrix's own rows and the driver gets columns times columns numbers whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import value

#: Numbers that a task holds of all cases at once, at most.
HELD_CELLS = 8_000_000


def second_moments(df: DataFrame, columns: Sequence[str], shift: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(X - shift)'(X - shift), the column sums of X - shift, and the number of rows; missing values count as ``shift``."""
    columns = list(columns)
    p = len(columns)
    shift = np.zeros(p) if shift is None else np.asarray(shift, dtype=float)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((p, p + 1)), 0
        for b in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in b.columns]) - shift
            x = np.nan_to_num(x, nan=0.0)
            total[:, :p] += x.T @ x
            total[:, p] += x.sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(p), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64())), "n": pa.array([n] * p, pa.int64())})

    parts = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(partial, "i int, row array<double>, n long")
    cells = parts.select("i", "n", F.posexplode("row").alias("j", "v"))
    sums = cells.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    out, n = np.zeros((p, p + 1)), 0
    for r in sums:
        out[r["i"], r["j"]] = r["v"]
        n = r["n"]
    return (out[:, :p] + out[:, :p].T) / 2, out[:, p], n


def vector_sum(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over batches of ``f`` of a batch's rows (an array, null as NaN): ``size`` numbers, added up by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += f(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "v"])

    out = np.zeros(size)
    for r in df.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        out[r["at"]] = r["v"]
    return out


def gapped_sums(df: DataFrame, columns: Sequence[str], shift: np.ndarray, case: str | None = None) -> DataFrame:
    """``case at v``: for each value of ``case`` (as text; "" without one) the cross-products of W = [x - shift with gaps as 0, 1, gap or not], by place of W'W's upper half.

    One pass gives all that scalings and centred moments need, whatever gaps are filled with. Without gaps their part is empty and isn't sent.
    """
    p = len(columns)
    size = 2 * p + 1
    upper = np.triu(np.ones((size, size), dtype=bool)).ravel()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, total in found.items():
                flat = total.ravel()
                at = np.flatnonzero(upper & (flat != 0.0))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(flat[at])], names=["case", "at", "v"])
            found.clear()

        for b in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in b.columns[1:]]) - shift
            gap = ~np.isfinite(x)
            w = np.hstack([np.where(gap, 0.0, x), np.ones((len(x), 1)), gap])
            names = np.array(b.column(0).to_pylist(), dtype=object)
            order = np.argsort(names, kind="stable") if case else np.arange(len(x))
            cuts = np.flatnonzero(names[order][1:] != names[order][:-1]) + 1 if case else []
            for part in np.split(order, cuts):
                if len(part):
                    own = w[part]
                    at = found.setdefault(names[part[0]], np.zeros((size, size)))
                    at += own.T @ own
                if len(found) * size * size > HELD_CELLS:
                    yield from told()
        yield from told()

    key = F.coalesce(F.col(f"`{case}`").cast("string"), F.lit("")) if case else F.lit("")
    rows = df.select(key.alias("case"), *[value(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return rows.mapInArrow(partial, "case string, at long, v double").groupBy("case", "at").agg(F.sum("v").alias("v"))


@dataclass
class Filled:
    """What one pass tells of columns whose gaps are filled by their view's mean."""

    n: int
    fills: list[float]
    mean: np.ndarray
    std: np.ndarray
    gram: np.ndarray  # centred


def filled(sums: np.ndarray, shift: np.ndarray, cuts: Sequence[int]) -> Filled:
    """From the square of :func:`gapped_sums`; ``cuts`` bounds the views."""
    p = len(shift)
    g = np.triu(sums) + np.triu(sums, 1).T
    n = round(g[p, p])
    total, gaps = g[:p, p], g[p + 1 :, p]
    fills, d = [], np.zeros(p)
    for a, b in zip(cuts[:-1], cuts[1:]):
        there = n - gaps[a:b]
        fills.append(float((total[a:b] + shift[a:b] * there).sum() / there.sum()) if there.sum() else 0.0)
        d[a:b] = fills[-1] - shift[a:b]
    cross = g[:p, p + 1 :] * d
    gram = g[:p, :p] + cross + cross.T + g[p + 1 :, p + 1 :] * np.outer(d, d)
    mean = (total + gaps * d) / max(n, 1)
    size = np.diag(gram).copy()
    gram = gram - n * np.outer(mean, mean)
    flat = np.diag(gram) <= 1e-13 * size  # zero but for rounding
    gram[flat], gram[:, flat] = 0.0, 0.0
    std = np.sqrt(np.diag(gram).clip(min=0.0) / max(n - 1, 1))
    return Filled(n, fills, mean + shift, std, (gram + gram.T) / 2)


def first_values(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Some row's values, 0 for gaps: columns are added up around them, so that large means don't swallow small spreads."""
    row = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return np.array([x if x is not None and np.isfinite(x) else 0.0 for x in row] if row is not None else [0.0] * len(columns), dtype=float)


def gram_long(df: DataFrame, key: str, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Cross-products as a table (i, j, value) by relational means: cells of each row side by side, summed by place."""
    cells = lambda names: F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    pairs = df.select(F.posexplode(cells(left)).alias("i", "a"), cells(right).alias("_r")).select("i", "a", F.posexplode("_r").alias("j", "b"))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def correlation_adjacency(df: DataFrame, columns: Sequence[str], threshold: float = 0.8, absolute: bool = True) -> np.ndarray:
    """Correlations of column pairs over the rows where both are present, those under the threshold as 0, ones on the diagonal.

    One pass: every batch of rows gives the sums of products of values, their squares and presences for all pairs at once, around the columns' means.
    """
    p = len(columns)
    row = df.agg(*[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(p)])

    def sums(rows: np.ndarray) -> np.ndarray:
        x = rows - mean
        here = np.isfinite(x).astype(float)
        x = np.where(here > 0, x, 0.0)
        return np.stack([x.T @ x, x.T @ here, (x**2).T @ here, here.T @ here])

    flat = vector_sum(df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)]), sums, 4 * p * p)
    xy, x, xx, n = flat.reshape(4, p, p)
    n = np.maximum(n, 1.0)
    size = np.sqrt((xx - x**2 / n).clip(min=0.0))  # of the row's column where the other one is present
    both = size * size.T
    r = np.divide(xy - x * x.T / n, both, out=np.zeros((p, p)), where=both > 1e-300)
    out = np.where((np.abs(r) if absolute else r) >= threshold, r, 0.0)
    np.fill_diagonal(out, 1.0)
    return out
