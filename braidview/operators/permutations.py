"""Many permutations of views' rows against each other, from one pass over the rows.

Rows are dealt to strata of about ``STRATUM_ROWS`` by a hash of their key and put in order there by the same hash. A permutation sends the row at place
q of a stratum of m rows to (a q + b) mod m, with a prime a and a shift b of its own for every view but the first. Such permutations are a subgroup of all,
so a test against them is exact. As rows only change places within their stratum, one shuffle serves all permutations: each task adds up the
views' cross-products for every permutation at once, and what is asked of a permutation is worked out where its sums are.

Keys name one row each; rows of an often repeated key share a stratum, which a task cuts at twice its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gram import Moments

STRATUM_ROWS = 32_768
#: Cross-products of all permutations that a task adds up at once, at most; more permutations than that make another pass.
CELLS = 4_000_000


def hashed_order(seed: int, view: int, key: str) -> Column:
    """60 bits that order the rows of a view at random: the head of the MD5 of seed, view and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(view), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def _prime(n: int) -> bool:
    """Whether an odd ``n`` below 3,215,031,751 is prime, by the strong test to bases 2, 3, 5 and 7."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all(any(pow(base, odd << i, n) == n - 1 for i in range(twos)) or pow(base, odd, n) == 1 for base in (2, 3, 5, 7))


def affine(seed: int, permutations: int, views: int) -> np.ndarray:
    """a and b of every permutation and view. Primes above 2^30 have no factor in common with any stratum's size; the first view stays as it is."""
    rng = np.random.default_rng([seed, permutations, views])
    out = np.zeros((permutations, views, 2), np.int64)
    out[:, 0, 0] = 1
    for t in range(permutations):
        for i in range(1, views):
            a = int(rng.integers(2**29, 2**30)) * 2 + 1
            while not _prime(a):
                a += 2
            out[t, i] = a, rng.integers(2**31)
    return out


def _pairs(cuts: Sequence[int]) -> list[tuple[slice, slice]]:
    at = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    return [(at[i], at[j]) for i in range(len(at)) for j in range(i + 1, len(at))]


def _added(x: np.ndarray, cuts: Sequence[int], moves: np.ndarray, total: np.ndarray) -> None:
    """Add a stratum's cross-products between views, for every permutation."""
    m, width = len(x), 0
    place = np.arange(m, dtype=np.int64)
    for t, by_view in enumerate(moves):
        turned = np.empty_like(x)
        for i, (a, b) in enumerate(by_view):
            own = slice(cuts[i], cuts[i + 1])
            turned[(place * (int(a) % m) + int(b)) % m, own] = x[:, own]
        width = 0
        for p, q in _pairs(cuts):
            block = turned[:, p].T @ turned[:, q]
            total[t, width : width + block.size] += block.ravel()
            width += block.size


def permuted(rows: DataFrame, key: str, columns: Sequence[str], m: Moments, permutations: int, seed: int, of: Callable[[Moments], Sequence[float]], size: int, stratum_rows: int = STRATUM_ROWS) -> np.ndarray:
    """What ``of`` (``size`` numbers) gives for the moments under each permutation, a row each.

    ``rows`` has ``key`` and the scaled and centred ``columns`` of all views in the order of ``m``, their moments as they are. One job, unless ``CELLS`` asks for more.
    """
    moves, cells = affine(seed, permutations, m.views), sum((p.stop - p.start) * (q.stop - q.start) for p, q in _pairs(m.cuts))
    step, out = max(1, CELLS // max(cells, 1)), np.zeros((permutations, size))
    if m.views < 2:
        out[:] = of(m)
        return out
    for first in range(0, permutations, step):
        found = _pass(rows, key, columns, m, moves[first : first + step], seed, of, size, stratum_rows, cells)
        for r in found.collect():  # ``size`` numbers a permutation
            out[first + r["t"]] = r["values"]
    return out


def _pass(rows: DataFrame, key: str, columns: Sequence[str], m: Moments, moves: np.ndarray, seed: int, of, size: int, stratum_rows: int, cells: int) -> DataFrame:
    strata, cuts = max(1, -(-m.n // stratum_rows)), list(m.cuts)
    h = hashed_order(seed, 0, key)
    dealt = rows.select(F.pmod(h, F.lit(strata)).alias("_stratum"), h.alias("_h"), F.col(key).alias("_key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    dealt = dealt.repartition("_stratum").sortWithinPartitions("_stratum", "_h", "_key").drop("_key", "_h")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, now, n = np.zeros((len(moves), cells)), [], None, 0
        for b in batches:
            stratum = b.column(0).to_numpy()
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            for part, of_part in zip(np.split(x, np.flatnonzero(np.diff(stratum)) + 1), stratum[np.r_[0, np.flatnonzero(np.diff(stratum)) + 1]] if len(stratum) else ()):
                if held and (of_part != now or n >= 2 * stratum_rows):
                    _added(np.concatenate(held), cuts, moves, total)
                    held, n = [], 0
                held.append(part)
                now, n = of_part, n + len(part)
        if held:
            _added(np.concatenate(held), cuts, moves, total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(moves)), cells)), pa.array(np.tile(np.arange(cells), len(moves))), pa.array(total.ravel())], names=["t", "at", "v"])

    def answer(table: pa.Table) -> pa.Table:
        flat = np.zeros(cells)
        flat[table.column("at").to_numpy()] = table.column("v").to_numpy()
        g, width = m.gram.copy(), 0
        for p, q in _pairs(cuts):
            block = flat[width : width + (p.stop - p.start) * (q.stop - q.start)].reshape(p.stop - p.start, -1)
            g[p, q], g[q, p] = block, block.T
            width += block.size
        values = [float(v) for v in of(Moments(g, cuts, m.n))]
        return pa.table({"t": table.column("t").slice(0, 1), "values": pa.array([values], pa.list_(pa.float64()))})

    by_place = dealt.mapInArrow(sums, "t long, at long, v double").groupBy("t", "at").agg(F.sum("v").alias("v"))
    # sums are small and answers may not be: they are spread over all cores
    spread = by_place.repartition(min(len(moves), rows.sparkSession.sparkContext.defaultParallelism), "t")
    return spread.groupBy("t").applyInArrow(answer, "t long, values array<double>")
