"""Streams with state against loops over the same batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidview.streaming import stateful, whitening

SCHEMA = "site string, seq long, a double, b double"


def batches(seed=1, n=4, rows=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = rng.uniform(-1, 1, (rows, 2)) @ np.array([[2.0, 0.5], [0.3, 1.0]])
        out.append([(None if j % 3 == 0 else "s", 1000 * i + int(j), None if j == 5 else float(p), float(q)) for j, (p, q) in enumerate(x)])
    return out


def streamed(spark, folder, parts, runs, **settings):
    """The state after every batch; the stream is started anew for each of ``runs``, which say how many parts have come by then."""
    done = 0
    for upto in runs:
        for part in parts[done:upto]:
            spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
            stats = stateful.running_statistics(stream, ["a", "b"], "seq", "site", **settings)
            stateful.run_to_table(stats, f"{folder}/out", f"{folder}/checkpoint")
        done = upto
    return spark.read.schema(stateful.OUT + ", batch long").parquet(f"{folder}/out")


@pytest.mark.parametrize("every", [None, 2])
def test_states_are_those_of_a_loop(spark, tmp_path, every):
    parts = batches()
    got = {(r["key"], r["batch"]): r for r in streamed(spark, str(tmp_path), parts, [1, 4], capacity=50, least=30, rate=0.3, every=every).collect()}
    assert len(got) == 8
    for key in ("", "s"):
        queue, stats = whitening.FeatureQueue(50, 2), whitening.WhiteningStats(2, rate=0.3, least=30)
        ica = whitening.StableIca(2, every or 1, stats=stats)
        for i, part in enumerate(parts):
            queue.push(np.array([[a or 0.0, b] for site, _, a, b in part if (site or "") == key]))
            if every:
                ica.step(queue.rows)
            else:
                stats.update(queue.rows)
            r = got[key, i]
            assert r["n"] == len(queue) and r["batches"] == i + 1 and r["last"] == max(x[1] for x in part if (x[0] or "") == key)
            if stats.mean is None:
                assert r["mean"] is None and r["map"] is None
                continue
            assert np.allclose(r["mean"], stats.mean) and np.allclose(np.array(r["cov"]).reshape(2, 2), stats.cov)
            assert np.allclose(np.array(r["map"]).reshape(2, 2), ica.map() if every else stats.matrix())


def test_a_stream_without_new_rows_keeps_its_state(spark, tmp_path):
    parts = batches(n=2)
    streamed(spark, str(tmp_path), parts, [2], capacity=50, least=10)
    before = stateful.newest_state(spark, f"{tmp_path}/out").collect()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    stateful.run_to_table(stateful.running_statistics(stream, ["a", "b"], "seq", "site", capacity=50, least=10), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(stateful.newest_state(spark, f"{tmp_path}/out").collect()) == sorted(before)
    assert spark.conf.get(stateful.ROCKS[0]) != stateful.ROCKS[1]


def test_late_rows_and_repeated_numbers(spark, tmp_path):
    """The queue is of the highest numbers, whenever they come."""
    parts = [[("s", i, float(i), 0.0) for i in range(50, 60)], [("s", i, float(i), 0.0) for i in [*range(40, 50), 70, 70]]]
    got = streamed(spark, str(tmp_path), parts, [2], capacity=5, least=2, rate=1.0).where(F.col("batch") == 1).first()
    assert got["n"] == 5 and got["last"] == 70 and got["mean"][0] == pytest.approx(np.mean([57, 58, 59, 70, 70]))
