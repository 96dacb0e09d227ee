"""k nearest neighbours as edge tables; no matrix of rows by rows is ever made."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpoint_folder

#: Rows of a block side, which decides how often a row travels; distances that are held at once; rows whose cells are looked for at once.
BLOCK_ROWS, SLICE_CELLS, SLICE_ROWS = 16_384, 1 << 20, 1_024
#: Cells around pivots, at most: what every task knows of the other side.
MOST_CELLS = 1_000


def _packed(df: DataFrame, key: str, columns: Sequence[str], blocks: int, name: str) -> DataFrame:
    vector = F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])
    return df.select(F.col(key).cast("long").alias("id"), vector.alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name))


EDGES = "i long, j long, d double"


def _nearest_of(i: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, bound: np.ndarray | None = None) -> pa.Table:
    """The ``k`` rows of ``y`` nearest to every row of ``x``, ties by id, and only those within the row's ``bound``."""
    first = np.argsort(ids, kind="stable")
    ids, y = ids[first], y[first]
    sizes, keep, found = (y**2).sum(axis=1), min(k + 8, len(ids)), []
    step = max(1, SLICE_CELLS // max(len(ids), 1))
    for a in range(0, len(x), step):
        z = x[a : a + step]
        own, at = (z**2).sum(axis=1), np.arange(len(z))[:, None]
        if keep < len(ids):
            square = z @ y.T
            square *= -2.0
            square += sizes
            near = np.argpartition(square, keep - 1, axis=1)[:, :keep]
            last = square[at, near].max(axis=1) + own
        else:
            near, last = np.tile(np.arange(len(ids)), (len(z), 1)), None
        exact = np.sqrt(((z[:, None, :] - y[near]) ** 2).sum(axis=2))  # products lose digits where rows are close
        order = np.lexsort((ids[near], exact), axis=1)[:, :k]
        j, d = ids[near[at, order]], exact[at, order]
        # where rows that were left out may be as near as the last of the k, as among many copies, all rows that near are compared
        for r in () if last is None else np.flatnonzero(last <= d[:, -1] ** 2 + 1e-9 * (1.0 + own + sizes.max())):
            all_d = np.sqrt(((z[r] - y) ** 2).sum(axis=1))
            close = np.flatnonzero(all_d <= d[r, -1])
            close = close[np.lexsort((ids[close], all_d[close]))[:k]]
            j[r], d[r] = ids[close], all_d[close]
        rows = np.repeat(i[a : a + step], j.shape[1])
        j, d = j.ravel(), d.ravel()
        if bound is not None:
            within = d <= np.repeat(bound[a : a + step], len(d) // max(len(z), 1))
            rows, j, d = rows[within], j[within], d[within]
        found.append((rows, j, d))
    return _edges(found)


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    i, j, d = zip(*found) if found else ((), (), ())
    return pa.table({"i": np.concatenate([np.zeros(0, np.int64), *i]), "j": np.concatenate([np.zeros(0, np.int64), *j]), "d": np.concatenate([np.zeros(0), *d])})


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(k: int):
    """The ``k`` rows of one block nearest to every row of another."""

    def best(own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows or not other.num_rows:
            return _edges([])
        return _nearest_of(own.column("id").to_numpy(), _matrix(own.column("x")), other.column("id2").to_numpy(), _matrix(other.column("x2")), k)

    return best


def _first(edges: DataFrame, k: int) -> DataFrame:
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("_r") <= k).drop("_r")


def nearest(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], k: int, sigma: float | None = None) -> DataFrame:
    """``i j d``: the ``k`` rows of ``right`` nearest to every row of ``left`` (ties by id); with ``sigma`` the kernel exp(-d^2 / 2 sigma^2) instead of d.

    Rows are dealt into blocks; each pair of blocks is one group that keeps its own ``k`` best per row by matrix products, and a second step keeps the best
    of all blocks. Every pair of rows is looked at, as exact neighbours need, but only k rows per left row and block leave a group.
    """
    blocks = lambda df: max(1, math.ceil(df.count() / BLOCK_ROWS))
    m, n = blocks(left), blocks(right)
    # every row travels to each block of the other side
    a = _packed(left, key, columns, m, "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "x", "a", "b")
    b = _packed(right, key, columns, n, "b2").withColumn("a2", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(F.col("id").alias("id2"), F.col("x").alias("x2"), "a2", "b2")

    parts = a.groupBy("a", "b").cogroup(b.groupBy("a2", "b2")).applyInArrow(_best(k), EDGES)
    out = _first(parts, k)
    return out if sigma is None else out.withColumn("d", F.exp(-F.col("d") * F.col("d") / F.lit(2.0 * sigma**2)))


@dataclass
class Cells:
    """Pivots, how many rows are nearest to each, and the least and greatest of their distances to it."""

    pivots: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of rows to all pivots; exact differences, as bounds may not lose digits."""
        out = np.empty((len(x), len(self.pivots)))
        for a in range(0, len(x), 64):
            out[a : a + 64] = np.sqrt(((x[a : a + 64, None, :] - self.pivots) ** 2).sum(axis=2))
        return out

    def home(self, d: np.ndarray, k: int) -> np.ndarray:
        """The nearest cell with ``k`` rows; the nearest at all if there is none."""
        enough = self.count >= k
        return np.argmin(np.where(enough, d, np.inf) if enough.any() else d, axis=1)

    def least(self, d: np.ndarray) -> np.ndarray:
        """Below which distance no row of a cell can be, by the triangle inequality: its rows lie in a ring around its pivot, and nearer to it than to the row's nearest pivot."""
        ring = np.maximum(d - self.high, self.low - d)
        near = np.argmin(d, axis=1)
        apart = self.between[near]
        plane = np.divide(d**2 - d[np.arange(len(d)), near][:, None] ** 2, 2.0 * apart, out=np.zeros_like(d), where=apart > 0)
        bound = np.maximum(np.maximum(ring, plane), 0.0)
        return np.where(self.count > 0, bound - 1e-9 * (1.0 + d), np.inf)

    @cached_property
    def between(self) -> np.ndarray:
        return self.distances(self.pivots)


def _cells(rows: DataFrame, n: int, cell_rows: int) -> tuple[Cells, DataFrame]:
    """Cells of ``rows`` (``id x``), and the rows with ``cell`` and ``sub``, their part of a cell of more than ``cell_rows`` rows."""
    wanted = min(MOST_CELLS, max(1, math.ceil(n / cell_rows)))
    found = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # MOST_CELLS rows at most
    pivots = np.unique(np.array([r["x"] for r in found], dtype=float), axis=0)
    blank = Cells(pivots, np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = blank.distances(_matrix(b.column(1))) if b.num_rows else np.zeros((0, len(pivots)))
            at = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array(d[np.arange(len(d)), at])], names=["id", "x", "cell", "to"])

    dealt = rows.mapInArrow(placed, "id long, x array<double>, cell int, to double")
    count, low, high = (np.zeros(len(pivots)) for _ in range(3))
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("to").alias("low"), F.max("to").alias("high")).collect():
        count[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    subs = F.array(*[F.lit(max(1, math.ceil(c / cell_rows))) for c in count])
    return Cells(pivots, count, low, high), dealt.select("id", "x", "cell", F.pmod(F.xxhash64("id"), F.get(subs, F.col("cell"))).cast("int").alias("sub"))


VISITS = "cell int, rows int, salt long, id binary, x binary, bound binary"


def _visits(ids: np.ndarray, x: np.ndarray, bound: np.ndarray, row: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    """A record for every cell, with all of these rows that visit it; ``cell`` is sorted."""
    names, first = np.unique(cell, return_index=True)
    parts = np.split(row, first[1:]) if len(first) else []
    packed = lambda a: pa.array([np.ascontiguousarray(a[p]).tobytes() for p in parts], pa.binary())
    salt = pa.array([int(ids[p[0]]) for p in parts], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([len(p) for p in parts], pa.int32()), salt, packed(ids), packed(x), packed(bound)], names=["cell", "rows", "salt", "id", "x", "bound"])


def _meet(visits: DataFrame, cells: DataFrame, k: int) -> tuple[DataFrame, dict[int, int]]:
    """``i j d``: for every visit (``VISITS``) the ``k`` nearest of each part of the cell, within the visitor's bound; and the number of visits by cell.

    Visitors of a cell come in shares of about ``BLOCK_ROWS``, and the cell's rows travel to each share: a cell that everyone visits is many groups.
    """
    many = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.sum("rows").alias("n")).collect()}
    shares = F.array(*[F.lit(math.ceil(many.get(c, 0) / BLOCK_ROWS)) for c in range(max(many, default=-1) + 1)])
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    parts = cells.groupBy("cell").agg((F.max("sub") + 1).alias("subs"))
    a = visits.join(F.broadcast(parts), "cell").select("id", "x", "bound", "cell", F.pmod(F.xxhash64("salt", F.lit(7)), F.get(shares, F.col("cell"))).cast("int").alias("share"), spread(F.col("subs")).alias("sub"))
    b = cells.where(F.get(shares, F.col("cell")) > 0).select(F.col("id").alias("id2"), F.col("x").alias("x2"), "cell", "sub", spread(F.get(shares, F.col("cell"))).alias("share"))

    def best(own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows or not other.num_rows:
            return _edges([])
        ids, x, bound = (np.frombuffer(b"".join(own.column(c).to_pylist()), t) for c, t in (("id", np.int64), ("x", float), ("bound", float)))
        return _nearest_of(ids, x.reshape(len(ids), -1), other.column("id2").to_numpy(), _matrix(other.column("x2")), k, bound)

    return a.groupBy("cell", "sub", "share").cogroup(b.groupBy("cell", "sub", "share")).applyInArrow(best, EDGES), many


def nearest_by_cells(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], k: int, sigma: float | None = None, cell_rows: int = BLOCK_ROWS) -> tuple[DataFrame, float]:
    """The edges of :func:`nearest`, and the share of all pairs of rows that was looked at.

    The right rows are dealt to the cells of their nearest pivots. A left row first meets the nearest cell that has ``k`` rows, which bounds how far its neighbours can be; then it
    visits only cells that the triangle inequality lets hold a row within that bound. Nothing is lost; on rows in clusters most cells are skipped.
    """
    columns, n, m = list(columns), right.count(), left.count()
    if not n or not m:
        return nearest(left, right, key, columns, k, sigma), 0.0
    checkpoint_folder(left.sparkSession)
    own, other = (_packed(df, key, columns, 1, "_").drop("_") for df in (left, right))
    known, cells = _cells(other, n, cell_rows)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                yield part.column(0).to_numpy(), _matrix(part.column(1)), part

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in slices(batches):
            cell = known.home(known.distances(x), k)
            row = np.argsort(cell, kind="stable")
            yield _visits(ids, x, np.full(len(ids), np.inf), row, cell[row])

    def abroad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, part in slices(batches):
            d, bound = known.distances(x), part.column(2).to_numpy(zero_copy_only=False)
            go = known.least(d) <= bound[:, None]
            go[np.arange(len(d)), known.home(d, k)] = False
            cell, row = np.nonzero(go.T)
            yield _visits(ids, x, bound, row, cell)

    first, home = _meet(own.mapInArrow(at_home, VISITS), cells, k)
    first = _first(first, k).checkpoint()  # the second step reads it twice
    bound = first.groupBy("i").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(math.inf)).alias("bound"))
    asked = own.join(bound, F.col("id") == F.col("i")).select("id", "x", "bound")
    second, away = _meet(asked.mapInArrow(abroad, VISITS), cells, k)
    seen = sum(known.count[c] * v for many in (home, away) for c, v in many.items())
    out = _first(first.unionByName(second), k)
    return out if sigma is None else out.withColumn("d", F.exp(-F.col("d") * F.col("d") / F.lit(2.0 * sigma**2))), float(seen / (n * m))


def nearest_self(df: DataFrame, key: str, columns: Sequence[str], k: int, sigma: float | None = None) -> DataFrame:
    """Neighbours within one table: ``k`` + 1 with the row itself."""
    return nearest(df, df, key, columns, k + 1, sigma)


def multiscale_spectrum(df: DataFrame, key: str, columns: Sequence[str], radii: Sequence[float], locations: int, values: int, neighbours: int = 0, seed: int = 0) -> DataFrame:
    """``r location s_1 ... s_values``: singular values of the points around sampled locations, centred and over r.

    The points are those within ``r``, or the location's ``neighbours`` nearest within it. Locations are the rows with the smallest hashes of key and seed; they are compared
    with all rows in one broadcast of ``locations`` rows.
    """
    vector = F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])
    rows = df.select(F.col(key).cast("long").alias("id"), vector.alias("x"))
    spots = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(locations).select(F.col("id").alias("location"), F.col("x").alias("y"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    near = rows.join(F.broadcast(spots), d <= F.lit(float(max(radii)))).select("location", "id", "x", d.alias("d"))
    if neighbours:
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy("location").orderBy("d", "id"))).where(F.col("_r") <= neighbours).drop("_r")
    p = len(columns)
    # cross-products of each location and scale, summed as rows of the matrix
    scaled = near.withColumn("r", F.explode(F.array(*[F.lit(float(r)) for r in radii]))).where("d <= r")
    cells = scaled.select("location", "r", "x", F.posexplode("x").alias("i", "v"))
    sums = cells.groupBy("location", "r", "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.array(*[F.sum(F.col("v") * F.get("x", F.lit(j))) for j in range(p)]).alias("row"))

    def spectrum(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        n, s, g = part["n"].iloc[0], part["s"].to_numpy(), np.stack(part["row"].to_list())
        r = part["r"].iloc[0]
        w = np.sqrt(np.linalg.eigvalsh(g - np.outer(s, s) / n).clip(min=0.0))[::-1] / r
        w = np.pad(w, (0, max(0, values - len(w))))[:values]
        return pd.DataFrame([{"location": part["location"].iloc[0], "r": r, "n": n, **{f"s_{j + 1}": w[j] for j in range(values)}}])

    return sums.groupBy("location", "r").applyInPandas(spectrum, "location long, r double, n long, " + ", ".join(f"s_{j + 1} double" for j in range(values)))
