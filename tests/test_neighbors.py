"""Neighbours by cells against all pairs."""

import numpy as np
import pytest

from braidview.operators import neighbors
from braidview.sources import tables


def by_hand(x, y, k):
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return [(i, int(j), round(float(d[i, j]), 9)) for i in range(len(x)) for j in order[i]]


def got(edges):
    return sorted((r["i"], r["j"], round(r["d"], 9)) for r in edges.collect())


@pytest.mark.parametrize("kind", ["clusters", "spread", "copies"])
def test_cells_lose_no_neighbour(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    if kind == "clusters":
        x = (rng.normal(size=(6, 3)) * 50)[rng.integers(0, 6, 300)] + rng.normal(size=(300, 3))
    elif kind == "spread":
        x = rng.normal(size=(250, 5))
    else:  # a third of the rows are equal, others lie on a line, and a few are far away
        x = np.vstack([np.ones((80, 2)), np.column_stack([np.arange(150.0), np.zeros(150)]), 1e3 * rng.normal(size=(5, 2))])
    df = tables.from_matrix(spark, x).repartition(5)
    names = [f"x{j}" for j in range(x.shape[1])]
    for k, cell_rows in ((1, 20), (4, 30), (40, 25)):
        edges, share = neighbors.nearest_by_cells(df, df, "row_id", names, k, cell_rows=cell_rows)
        assert got(edges) == sorted(by_hand(x, x, k)), (k, cell_rows)
        assert 0 < share <= 1.0
    other = rng.normal(size=(70, x.shape[1])) * 30
    edges, _ = neighbors.nearest_by_cells(tables.from_matrix(spark, other), df, "row_id", names, 3, cell_rows=20)
    assert got(edges) == sorted(by_hand(other, x, 3))


def test_clustered_rows_are_looked_at_less_than_quadratically(spark):
    rng = np.random.default_rng(5)
    shares = []
    for clusters in (8, 32):
        x = (rng.uniform(-1, 1, (clusters, 3)) * 1000)[np.arange(40 * clusters) % clusters] + rng.normal(size=(40 * clusters, 3))
        df = tables.from_matrix(spark, x)
        edges, share = neighbors.nearest_by_cells(df, df, "row_id", ["x0", "x1", "x2"], 3, cell_rows=10)
        assert got(edges) == sorted(by_hand(x, x, 3))
        shares.append(share)
    assert shares[0] < 0.5 and shares[1] < shares[0] / 2  # four times the rows, less than twice as many looked at by each


def test_few_rows_and_none(spark):
    df = tables.from_matrix(spark, np.array([[0.0, 1.0], [np.nan, 2.0], [5.0, 5.0]]))
    edges, _ = neighbors.nearest_by_cells(df, df, "row_id", ["x0", "x1"], 5, cell_rows=1)
    assert got(edges) == sorted(by_hand(np.array([[0.0, 1.0], [0.0, 2.0], [5.0, 5.0]]), np.array([[0.0, 1.0], [0.0, 2.0], [5.0, 5.0]]), 3))
    assert neighbors.nearest_by_cells(df.limit(0), df, "row_id", ["x0", "x1"], 2)[0].collect() == []
    assert neighbors.nearest_by_cells(df, df.limit(0), "row_id", ["x0", "x1"], 2)[0].collect() == []
    kernel, _ = neighbors.nearest_by_cells(df, df, "row_id", ["x0", "x1"], 1, sigma=1.0)
    assert [r["d"] for r in kernel.collect()] == [1.0, 1.0, 1.0]


def test_copies_are_taken_by_id_and_few_distances_are_held():
    """Of more copies than candidates any could be taken before, and distances of 512 rows were held with three copies of them."""
    import tracemalloc

    rng = np.random.default_rng(6)
    y = np.vstack([np.ones((60, 2)), rng.normal(size=(16_000, 2)) * 30])
    ids = rng.permutation(len(y))
    x = np.vstack([np.ones((3, 2)), rng.normal(size=(600, 2)) * 30])
    tracemalloc.start()
    got = neighbors._nearest_of(np.arange(len(x)), x, ids, y, 4).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    for r in (0, 1, 2):
        assert got[got["i"] == r]["j"].tolist() == sorted(ids[:60].tolist())[:4]
    for r in (3, 100, 602):
        d = np.sqrt(((x[r] - y) ** 2).sum(axis=1))
        assert got[got["i"] == r]["j"].tolist() == ids[np.lexsort((ids, d))[:4]].tolist()
