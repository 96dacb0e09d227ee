import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from braidview import catalogue
from braidview.functions import linalg
from braidview.operators import columns, moments, neighbors, permutations, prep, relational
from braidview.plans import embed, exchange, explain, harness, linear, neural
from braidview.sources import generators, tables
from braidview.streaming import whitening


@pytest.fixture(scope="module")
def case(spark):
    c = generators.build(spark, "linear_footprint", n=240, k=2, widths=(6, 5), noise=0.2)
    c.df = c.df.repartition(3).persist()
    return c


def test_side_columns(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 18.0)], "`T1Hier_left-Caudate_vol` double, `T1Hier_right-Caudate_vol` double")
    out = columns.add_side_average(columns.add_asymmetry(df, df.columns), df.columns)
    got = out.toPandas()
    assert got["T1Hier_Asym-Caudate_vol"].tolist() == [2.0, 2.0] and got["T1Hier_LRAVG-Caudate_vol"].tolist() == [11.0, 19.0]
    named = columns.imaging_table(df.toDF("T1Hier_Left-Caudate_vol", "T1Hier_Right-Caudate_vol"), asymmetry=True)
    assert {"T1Hier_Asym-Caudate_vol", "T1Hier_LRAVG-Caudate_vol"} <= set(named.columns)


def test_apply_bases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (None, float("nan"), 5.0)], "t1_f1 double, t1_f2 double, dt_f1 double")
    out, added = columns.apply_bases(df, {"t1": np.eye(2), "dt": np.array([[2.0]]), "none": np.eye(1)}, {"t1": ["t1_f1", "t1_f2"], "dt": ["dt_f1"], "none": ["absent"]})
    assert added == ["t1_PC1", "t1_PC2", "dt_PC1"]
    assert [tuple(r) for r in out.select(added).collect()] == [(1.0, 2.0, 6.0), (0.0, 0.0, 10.0)]
    again, names = columns.apply_bases(out, {"t1": np.eye(2)}, {"t1": ["t1_f1", "t1_f2"]})
    assert names == ["t1_PCr00.11", "t1_PCr00.12"]


def test_scaling_provenance(spark):
    rng = np.random.default_rng(0)
    df = tables.from_matrix(spark, rng.normal(10, 1, (100, 4)))
    names = [f"x{i}" for i in range(4)]
    s = prep.fit_scaling(df, names, ["centerAndScale"])
    assert np.allclose(s.steps["cas_mean"], 10, atol=0.5)
    new = tables.from_matrix(spark, np.full((2, 4), 10.0))
    assert np.allclose(np.array(s.apply(new).select(names).collect(), dtype=float), (10 - np.array(s.shift)) * np.array(s.factor))
    with pytest.raises(ValueError):
        prep.fit_scaling(df, names, ["other"])


def test_joint_residuals(spark):
    rng = np.random.default_rng(1)
    age = rng.normal(size=50)
    sex = 0.5 * age + rng.normal(size=50)
    y = 2 * age + 3 * sex + rng.normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({"age": age, "sex": sex, "y": y}))
    x = np.column_stack([np.ones(50), age, sex])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    for spec in (["age", "sex"], "age + sex"):
        assert np.allclose([r["y"] for r in prep.residualise(df, ["y"], spec).collect()], want, atol=1e-8)
    assert prep.residualise(df, ["age", "y"], "mean").count() == 50


def test_aggregates(spark):
    df = spark.createDataFrame([("linear", 0.0, 42, 0.8), ("linear", 0.0, 43, 0.9), ("ned", 0.0, 42, 0.7), ("ned", 0.5, 43, 0.9)], "model string, sparsity double, seed int, recovery double")
    r = relational.summarise(df, ["model", "sparsity"], ["recovery"]).where("model = 'linear'").first()
    assert r["recovery"] == pytest.approx(0.85) and r["recovery_ci95"] == pytest.approx(0.1385929, abs=1e-6)
    best = {x["model"]: x["recovery"] for x in relational.best_of_groups(df, "model", "sparsity", "recovery").collect()}
    assert best == {"linear": pytest.approx(0.85), "ned": 0.9}


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    x = np.random.default_rng(2).normal(size=(70, 3))
    df = tables.from_matrix(spark, x)
    got = neighbors.nearest_self(df, "row_id", ["x0", "x1", "x2"], 2).toPandas().sort_values(["i", "d", "j"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert (got["j"].to_numpy().reshape(-1, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


# averages of views' own components may mix them up; joint mixers may not
@pytest.mark.parametrize(("mixer", "least"), [("avg", 0.4), ("newton", 0.4), ("svd", 0.8), ("ica", 0.8)])
def test_fit_recovers_truth(case, mixer, least):
    f = linear.canonical(linear.fit(case.df, case.views, linear.Spec(k=2, mixer=mixer, iterations=15)))
    out, errors = linear.predict(case.df, f)
    from braidview.plans import metrics

    assert metrics.latent_recovery(out, ["u_1", "u_2"], case.truth) > least
    assert all(0 <= e < 1 for e in errors.values())
    part = linear.add_scores(case.df.where("row_id < 10"), f).orderBy("row_id").select("u_1").collect()
    whole = linear.add_scores(case.df, f).where("row_id < 10").orderBy("row_id").select("u_1").collect()
    assert np.allclose([r[0] for r in part], [r[0] for r in whole])  # a row's score doesn't depend on other rows


def test_inference(case):
    spec = linear.Spec(k=2, iterations=4)
    assert linear.estimate_rank(case.df, "row_id", case.views, permutations=1) >= 1
    assert linear.alignment_test(case.df, "row_id", case.views, spec, permutations=2)["p"] == 0.0
    a, b = (linear.shuffled(case.df, "row_id", case.views, 5).orderBy("row_id").select("x2_0").collect() for _ in range(2))
    assert a == b
    assert linear.path(case.df, case.views, [[0], [0, 1]], spec)[-1]["rv_with_last"] == pytest.approx(1.0)
    assert linear.path_graph([(0, 1), (1, 2)], 3) == {0: [1], 1: [0, 2], 2: [1]}
    assert set(linear.structural_models(case.df, case.views, {"line": {0: [1], 1: [0]}}, spec)) == {"line"}


@pytest.mark.parametrize("stratum", [1000, 64])
def test_many_permutations_equal_each_one_by_hand(spark, case, stratum):
    """Every permutation's cross-products are those of rows moved by hand; all come from one job."""
    names = [c for cs in case.views.values() for c in cs]
    scalings, m = prep.fit_scalings(case.df, case.views, ["centerAndScale"], moments=True)
    got = linear.null_values(case.df.repartition(5), "row_id", scalings, m, 7, 3, lambda x: x.block(0, 1).ravel(), 30, stratum_rows=stratum)
    held = case.df.select("row_id", permutations.hashed_order(3, 0, "row_id").alias("h"), *names).toPandas()
    x = held[names].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    strata = max(1, -(-len(x) // stratum))
    moves = permutations.affine(3, 7, 2)
    for t in range(7):
        want = np.zeros((6, 5))
        for s in range(strata):
            own = np.flatnonzero(held["h"] % strata == s)
            own = own[np.argsort(held["h"].to_numpy()[own], kind="stable")]
            to = (moves[t, 1, 0] * np.arange(len(own)) + moves[t, 1, 1]) % len(own)
            assert sorted(to) == list(range(len(own)))
            moved = np.empty((len(own), 5))
            moved[to] = x[own, 6:]
            want += x[own, :6].T @ moved
        assert np.allclose(got[t].reshape(6, 5), want, atol=1e-8)
    assert all(permutations._prime(a) for a in (2**31 - 1, 2_147_483_629)) and not any(permutations._prime(a) for a in (2**31 - 3, 1_373_653, 25_326_001))


def test_permutations_in_several_passes(case, monkeypatch):
    scalings, m = prep.fit_scalings(case.df, case.views, ["center"], moments=True)
    one = linear.null_values(case.df, "row_id", scalings, m, 5, 3, lambda x: [x.block(0, 1).sum()])
    monkeypatch.setattr(permutations, "CELLS", 70)
    assert np.allclose(one, linear.null_values(case.df, "row_id", scalings, m, 5, 3, lambda x: [x.block(0, 1).sum()]))
    assert linear.null_values(case.df, "row_id", scalings, m, 0, 3, lambda x: [1.0]).shape == (0, 1)


def test_one_pass_fills_gaps_and_centres(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5)) * [1, 2, 1e-3, 1, 0] + [1e6, 0, 5, -3, 1e4]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 1e4
    x[0, 4] = np.nan
    df = tables.from_matrix(spark, x).repartition(4)
    views = {"a": ["x0", "x1"], "b": ["x2", "x3"], "c": ["x4"]}
    scalings, m = prep.fit_scalings(df, views, ["centerAndScale"], moments=True)
    filled = x.copy()
    for at in ([0, 1], [2, 3], [4]):
        part = filled[:, at]
        part[np.isnan(part)] = np.nanmean(part)
        filled[:, at] = part
    sd = filled.std(axis=0, ddof=1)
    z = (filled - filled.mean(axis=0)) / np.where(sd < 1e-10, 1, sd)
    assert m.n == 90 and np.allclose(m.gram, z.T @ z, atol=1e-6)
    native, _ = prep.fit_scalings(df, views, ["centerAndScale"])
    for v in views:
        assert np.allclose(native[v].shift, scalings[v].shift) and np.allclose(native[v].factor, scalings[v].factor, rtol=1e-6) and native[v].nan_fill == pytest.approx(scalings[v].nan_fill)


def test_a_thousand_fits_in_one_job_equal_the_loop(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n, cases = 12, 1000
    shared = rng.normal(size=(n * cases, 1))
    x = np.hstack([shared + 0.5 * rng.normal(size=(n * cases, 2)), shared + 0.5 * rng.normal(size=(n * cases, 2))])
    df = tables.from_matrix(spark, x).withColumn("part", F.col("row_id") % cases).repartition(4)
    views, spec = {"a": ["x0", "x1"], "b": ["x2", "x3"]}, linear.Spec(k=2, iterations=8)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "fits")
    got = {r["case"]: r for r in linear.fit_by_case(df, "part", views, spec).collect()}
    assert len(jobs.getJobIdsForGroup("fits")) <= 6  # a first row, then the stages of one query
    spark.sparkContext.setJobGroup("other", "other")
    assert len(got) == cases
    for c in (0, 1, 499, 999):
        want = linear.fit_arrays({"a": x[c::cases, :2], "b": x[c::cases, 2:]}, spec)
        r = got[str(c)]
        assert r["n"] == n and r["rounds"] == want.rounds and np.allclose(r["energies"], want.energies, rtol=1e-6)
        assert all(np.allclose(b, w.ravel(), atol=1e-6) for b, w in zip(r["bases"], want.bases))
    with pytest.raises(ValueError, match="ica"):
        linear.fit_by_case(df, "part", views, linear.Spec(k=1, mixer="ica"))


def test_cases_that_are_null_or_flushed(spark, case):
    df = case.df.withColumn("part", F.when(F.col("row_id") % 3 == 0, F.lit(None)).otherwise(F.col("row_id") % 3))
    asked = lambda m, s: {"total": float(m.total(0)), "names": sorted(s)}
    got = {r["case"]: r for r in linear.by_case(df, "part", case.views, ["center"], asked, "total double, names array<string>").collect()}
    assert set(got) == {"", "1", "2"} and sum(r["n"] for r in got.values()) == 240 and got["1"]["names"] == sorted(case.views)
    names = next(iter(case.views.values()))
    x = df.where("part is null").select(*names).toPandas().to_numpy()
    assert got[""]["total"] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


def test_explanations(case):
    f = linear.fit(case.df, case.views, linear.Spec(k=2, iterations=5))
    assert explain.report_metrics(explain.report(f))["combined_r2"] > 0.9
    a = explain.attribute_outcome(case.df, f, "y")
    assert a["combined"]["global_r2"] > 0.8 and a["score"]["global_r2"] <= 1.0
    s = explain.summarise_basis(np.array([[1.0, 0.0], [0.0, 2.0], [0.0, 0.0]]), ["a", "b", "c"], 1)
    assert s["l0"] == [1, 1] and s["top_features"][1][0]["feature"] == "b"


@pytest.mark.parametrize("kind", neural.KINDS)
def test_neural(case, kind):
    f = neural.fit_neural(case.df, case.views, neural.NeuralSpec(kind=kind, k=2, epochs=6, warmup=2, hidden=(8, 4), flow_hidden=8, rate=5e-3, dynamic=kind == "ned"))
    out = neural.score_neural(case.df, f)
    us = [c for c in out.columns if c.startswith("u_")]
    sd = out.agg(*[F.stddev_samp(c) for c in us]).first()
    assert all(x < 1.01 for x in sd) and max(sd) > 0.99  # a latent may collapse, none may be out of scale
    assert out.where(" or ".join(f"isnan({c})" for c in us)).count() == 0
    if f.weights is not None:
        assert f.weights.sum() == pytest.approx(1.0) and (f.weights >= 0).all()


@pytest.mark.parametrize("kind", neural.KINDS)
def test_neural_training_is_the_same_in_any_number_of_tasks(case, kind):
    df = case.df.withColumn("flat", F.lit(3.0))
    views = {**case.views, next(iter(case.views)): [*next(iter(case.views.values())), "flat"]}
    spec = neural.NeuralSpec(kind=kind, k=2, epochs=14, batch=50, warmup=2, hidden=(8, 4), flow_hidden=8, rate=5e-3, dynamic=True, freeze_private=3, patience=1, tol=0.02)
    a, b = neural.fit_neural(df, views, spec, tasks=1), neural.fit_neural(df.repartition(7), views, spec, tasks=3)
    assert len(a.history) == len(b.history)
    assert np.allclose(a.history, b.history, rtol=1e-8) and np.allclose(a.weights, b.weights, atol=1e-8) and np.allclose(a.mai, b.mai, atol=1e-8)
    assert all(np.allclose(v, b.params[k], rtol=0, atol=1e-8) for k, v in a.params.items())
    x, y = (neural.score_neural(df, f).orderBy("row_id").toPandas().filter(regex="^(u_|z_|r_x)") for f in (a, b))
    assert np.allclose(x, y, atol=1e-6)


def test_training_in_tasks_equals_arrays(spark):
    """A barrier stage takes the steps of the loop over arrays, on rows with repetitions, which keep their ids in any partition."""
    x = np.random.default_rng(4).normal(size=(150, 5)).round(1)
    x[100:] = x[0]
    df = tables.from_matrix(spark, x).selectExpr("x0 c0", "x1 c1", "x2 c2", "x3 c3", "x4 c4")
    spec = neural.NeuralSpec(k=2, epochs=6, batch=32, warmup=1, hidden=(6,), rate=5e-3)
    ids = lambda rows: rows.groupBy(*df.columns).count().withColumn("_rank", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).select(neural.row_ids(df.columns, F.col("_rank")).alias("_row"), *df.columns)
    one, two = ids(df), ids(df.repartition(5).orderBy("c3"))
    assert one.select("_row").distinct().count() == 150 and one.exceptAll(two).count() == 0
    held = np.array([tuple(r) for r in one.orderBy("_row").collect()])
    rows, keys = held[:, 1:], np.array([r["_row"] for r in one.orderBy("_row").collect()])
    starts = [linalg.gram_svd(v.T @ v, 2)[1] for v in (rows[:, :3], rows[:, 3:])]
    params, history, _, _ = neural.train_share(exchange.Alone(), rows, keys, 150, [3, 2], spec, starts)
    found = neural.train_table(two, [3, 2], spec, tasks=4)
    assert np.allclose(history, found[1], rtol=1e-8) and all(np.allclose(v, found[0][k], rtol=0, atol=1e-8) for k, v in params.items())


def test_epochs_take_every_row_once_in_new_orders(monkeypatch):
    keys = neural.epoch_keys(np.arange(100), 0, 3)
    whole = np.vstack(list(exchange.in_order(exchange.Alone(), keys, 100)))
    monkeypatch.setattr(exchange, "CHUNK_ROWS", 30)
    assert len(list(exchange.in_order(exchange.Alone(), keys, 100))) == 4 and (np.vstack(list(exchange.in_order(exchange.Alone(), keys, 100))) == whole).all()
    spec = neural.NeuralSpec(batch=7)
    x = np.arange(100.0)[:, None]
    first, second = (np.vstack([b[:, 1:] for b in exchange.in_order(exchange.Alone(), neural.epoch_keys(np.arange(100), spec.seed, e), 100)])[:, 0] for e in (0, 1))
    assert sorted(first) == sorted(second) == list(range(100)) and (first != second).any()
    assert [len(b) for b in neural.regrouped(iter([x[:5], x[5:30], x[30:]]), 40)] == [40, 40, 20]


def test_neural_mixes_independent_components(spark):
    rng = np.random.default_rng(7)
    truth = rng.uniform(-1, 1, (600, 2))
    both = np.hstack([truth @ rng.normal(size=(2, 3)), truth @ rng.normal(size=(2, 3))])
    df = tables.from_matrix(spark, both)
    views = {"a": ["x0", "x1", "x2"], "b": ["x3", "x4", "x5"]}
    spec = neural.NeuralSpec(mixer="ica", topology="star", epochs=2, hidden=(4,), first_layer="raw", sign="any")
    us = neural.score_neural(df, neural.fit_neural(df, views, spec), reconstruct=False).orderBy("row_id").select("u_1", "u_2").toPandas().to_numpy()
    match = np.abs(np.corrcoef(us.T, truth.T)[:2, 2:])
    assert match.max(axis=1).min() > 0.95 and set(match.argmax(axis=1)) == {0, 1}  # singular vectors leave the sources mixed
    mixed = neural._mixed([neural.var(truth @ np.array([[1.0, 0.7], [0.4, 1.0]]))], spec).x
    assert np.abs(np.corrcoef(mixed.T, truth.T)[:2, 2:]).max(axis=1).min() > 0.95
    fits = [neural.fit_neural(df, views, spec, tasks=t) for t in (1, 3)]  # sums over tasks instead of all latents at once
    assert all(np.allclose(a["map"], b["map"], atol=1e-8) for a, b in zip(fits[0].mixing, fits[1].mixing))


def test_flow_inverts():
    for mask in ("block", "alternate"):
        spec = neural.NeuralSpec(kind="flow", k=3, mask=mask)
        p = {k: neural.Var(v) for k, v in neural.initial_parameters([7], spec).items()}
        x = np.random.default_rng(0).normal(size=(20, 7))
        z, det = neural.flow_forward(p, 0, neural.var(x), spec)
        assert np.allclose(neural.flow_inverse(p, 0, z, spec).x, x, atol=1e-9) and det.shape == (20,)


def test_agreement_orders_views():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 4)) * [4, 2, 1, 0.5]
    views = [base + s * rng.normal(size=base.shape) for s in (0.05, 0.05, 1.0)] + [rng.normal(size=base.shape)]
    m = neural.agreement(views, "procrustes_r2_sharp")
    assert m[0] > m[2] > m[3]
    assert np.allclose(neural.gate(m, 5), 0.25) and neural.gate(m, 40).sum() == pytest.approx(1.0)


def test_embedding_and_extension(spark):
    rng = np.random.default_rng(4)
    names = ["T1Hier_Left-Caudate_vol", "T1Hier_Right-Caudate_vol", "DTI_mean_fa_Left", "DTI_mean_fa_Right", "PET_suvr_Left", "PET_suvr_Right", "age"]
    df = spark.createDataFrame(pd.DataFrame({n: rng.normal(size=20) for n in names}))
    f, _ = embed.embed_table(df, linear.Spec(k=2, iterations=3), covariates="age", asymmetry=False)
    out, info = embed.extend_embedding(df, dict(zip(f.views, f.bases)), f.views, {"pet": ["PET_suvr_Left", "PET_suvr_Right"]})
    assert info["added"] == ["pet_PC1", "pet_PC2"] and set(info["added"]) <= set(out.columns)
    assert all(np.allclose(np.linalg.norm(b, axis=0)[np.linalg.norm(b, axis=0) > 0], 1.0) for b in info["bases"].values())
    with pytest.raises(ValueError):
        embed.extend_embedding(df, dict(zip(f.views, f.bases)), f.views, {"pet": ["absent"]})


def test_artifacts(spark, tmp_path):
    value = {"m": np.arange(6.0).reshape(3, 2), "d": {"x": pd.DataFrame({"PC1": [1.0, 2.0]}, index=["a", "b"])}, "l": [np.ones(2), np.zeros((2, 2))], "s": ["a", "b"], "n": None, "t": spark.range(3)}
    got = tables.read_artifact(tables.write_artifact(value, str(tmp_path / "a"), clear=True), spark)
    assert np.array_equal(got["m"], value["m"]) and got["d"]["x"].equals(value["d"]["x"]) and got["s"] == ["a", "b"] and got["n"] is None
    assert [x.shape for x in got["l"]] == [(2,), (2, 2)] and got["t"].count() == 3


def test_delimited(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (3, None)], "a int, b double")
    tables.write_delimited(df, str(tmp_path / "x"))
    assert tables.read_delimited(spark, str(tmp_path / "x"), "a int, b double").count() == 2


def test_streaming_whitening(spark, tmp_path):
    rng = np.random.default_rng(5)
    src = str(tmp_path / "in")
    x = rng.normal(size=(600, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
    tables.from_matrix(spark, x).repartition(2).write.parquet(src)
    w = whitening.StreamWhitener(["x0", "x1"], "row_id", 400, str(tmp_path / "state"))
    w.stats.shrinkage = 0.0
    stream = spark.readStream.schema("row_id long, x0 double, x1 double").parquet(src)
    q = stream.writeStream.foreachBatch(w).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(w.queue) == 400
    cov = np.cov(np.array(w.whiten(tables.from_matrix(spark, w.queue.rows)).select("w_x0", "w_x1").collect()).T)
    assert np.allclose(cov, np.eye(2), atol=0.02)
    again = whitening.StreamWhitener(["x0", "x1"], "row_id", 400, str(tmp_path / "state"))
    assert again.last == w.last and np.allclose(again.stats.cov, w.stats.cov)
    ica = whitening.StableIca(2)
    ica.step(x)
    assert ica.transform(tables.from_matrix(spark, x), ["x0", "x1"]).columns[-1] == "s_2"


def test_generators_repeat(spark):
    for kind in ("linear_footprint", "nonlinear_shared", "shared_plus_private", "correlated_noise"):
        options = {"views_n": 2, "width": 4} if kind == "correlated_noise" else {"widths": (4, 3)}
        a, b, c = (generators.build(spark, kind, n=50, seed=s, **options).df.repartition(p).orderBy("row_id").select("x1_0", "y").collect() for s, p in ((1, 2), (1, 5), (2, 2)))
        assert a == b and a != c


def test_harness(spark, case):
    out = harness.run_one(case, "linear", 2, iterations=5)
    assert out["recovery"] > 0.8 and out["test_r2"] > 0.5
    assert harness.accepted(harness.run_one, {"k": 1, "other": 2}) == {"k": 1}
    grid = harness.sweep(spark, ["linear"], "linear_footprint", 2, 2, (0.0,), case={"n": 120, "widths": (5, 4)}, iterations=3)
    assert grid["results"].count() == 2 and grid["best"].count() == 1


def test_registered_models_run_their_whole_job(spark, sf_dir, monkeypatch):
    from types import SimpleNamespace

    views = catalogue._customer_views(spark, sf_dir)
    _, centred = prep.fit_scalings(views, catalogue.CUSTOMER_VIEWS, ["center"], moments=True)
    shuffles, rounds, epochs, solve = [], set(), [], linear.solve
    monkeypatch.setattr(linear, "null_values", lambda df, key, s, m, n, seed, of, size=1: shuffles.extend(range(n)) or np.tile(of(centred), (n, 1)))
    monkeypatch.setattr(linear, "solve", lambda m, spec, *a, **k: rounds.add(spec.iterations) or solve(m, linear.Spec(k=2, iterations=1), *a, **k))
    for name, operator in (("alignment_permutations", 100), ("rank_estimate", 20), ("refit_permutations", 50)):
        shuffles.clear()
        catalogue.QUERIES[name](spark, sf_dir)
        assert len(set(shuffles)) == operator
    assert rounds == {linear.Spec(k=2).iterations}
    monkeypatch.setattr(neural, "fit_neural", lambda df, views, spec: epochs.append(spec.epochs))
    for f in ("score_neural", "impute_view"):
        monkeypatch.setattr(neural, f, lambda *a, **k: SimpleNamespace(select=lambda *c: None))
    for name in ("neural_scores", "flow_roundtrip", "flow_imputation"):
        catalogue.QUERIES[name](spark, sf_dir)
    assert epochs == [neural.NeuralSpec().epochs] * 3


def test_flagship(spark, sf_dir):
    got = catalogue.flagship(spark, sf_dir)
    assert got.columns == ["c_custkey", "u_1", "u_2"] and got.count() > 0


def test_numbering_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(relational, "RANGE_ROWS", 40)
    skewed = [2**k for k in range(40)] + [7] * 90 + list(range(-200, 0))
    for values, kind in ((skewed, "long"), ([f"k{v:030d}" if v >= 0 else "a" for v in skewed], "string"), ([None, 3, 1, None, 2] * 30, "long"), ([], "long")):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").repartition(5)
        rows, n = relational.numbered(df, "v", "i")
        want = [i for i, v in sorted(enumerate(values), key=lambda x: (x[1] is not None, x[1] if x[1] is not None else 0, x[0]))]
        assert n == len(values) and [r["i"] for r in sorted(rows.collect(), key=lambda r: r["_place"])] == want
        assert sorted(r["_place"] for r in rows.collect()) == list(range(1, n + 1))
        if n > 40:  # neither a key that most rows share nor nulls make a large task
            assert max(x for x in rows.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 120
    parts = relational.split_rows(spark.range(1000).selectExpr("concat('k', lpad(id, 5, '0')) k"), "k", [0.6, 0.2, 0.2], ["a", "b", "c"]).groupBy("part").agg(F.count("*").alias("n"), F.max("k").alias("m"))
    assert {r["part"]: (r["n"], r["m"]) for r in parts.collect()} == {"a": (600, "k00599"), "b": (200, "k00799"), "c": (200, "k00999")}


def test_adjacency_with_missing_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    x[:, 1] += x[:, 0]
    x[rng.random((80, 3)) < 0.2] = np.nan
    df = tables.from_matrix(spark, x)
    got = moments.correlation_adjacency(df, ["x0", "x1", "x2"], 0.0)
    for i in range(3):
        for j in range(3):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            assert got[i, j] == pytest.approx(1.0 if i == j else np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert moments.correlation_adjacency(df, ["x0", "x1", "x2"], 2.0).tolist() == np.eye(3).tolist()


def test_batches_keep_every_row():
    from braidview.plans import neural

    for n in (0, 1, 5, 10, 11, 21):
        got = list(neural.regrouped(iter([np.arange(a, min(n, a + 4))[:, None] for a in range(0, n, 4)]), 5))
        assert np.concatenate([np.zeros((0, 1)), *got])[:, 0].tolist() == list(range(n))
        assert all(len(x) > 1 for x in got) or n == 1
    with pytest.raises(ValueError):
        neural.NeuralSpec(kind="lend", k=1, metric="none such")


def test_arrays_and_tables_give_the_same_fit(spark):
    c = generators.build(spark, "linear_footprint", n=300, k=2, widths=(6, 5), noise=0.2)
    frame = c.df.orderBy("row_id").toPandas()
    arrays = {v: frame[cs].to_numpy() for v, cs in c.views.items()}
    arrays["view1"][3, 2] = np.nan
    frame.loc[3, c.views["view1"][2]] = np.nan
    assert [b.shape for b in linear.fit_arrays(arrays, linear.Spec(k=2, mixer="ica", iterations=2), c.views).bases] == [(6, 2), (5, 2)]
    for mixer in ("svd", "newton"):
        spec = linear.Spec(k=2, mixer=mixer, iterations=10)
        a, b = linear.fit(spark.createDataFrame(frame), c.views, spec), linear.fit_arrays(arrays, spec, c.views)
        for x, y in zip(a.bases, b.bases):
            assert np.allclose(np.abs(x), np.abs(y), atol=1e-5)
        assert a.rounds == b.rounds and np.allclose(a.energies, b.energies, rtol=1e-5)


def test_ica_where_the_rows_are(case, monkeypatch):
    spec = linear.Spec(k=2, mixer="ica", iterations=2)
    here = linear.fit(case.df, case.views, spec)
    monkeypatch.setattr(linear, "ICA_CELLS", 0)
    there = linear.fit(case.df, case.views, spec)
    for a, b in zip(here.scores[0].maps, there.scores[0].maps):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-9 * np.abs(a).max())


@pytest.mark.parametrize("mask", ["block", "alternate"])
def test_flow_layers_are_single_nodes_with_right_gradients(mask):
    """A flow is one node of the differentiator in either direction (one for every operation before), and its gradients are those of differences."""
    rng, spec = np.random.default_rng(8), neural.NeuralSpec(kind="flow", k=2, flow_hidden=5, mask=mask)
    p = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in neural.initial_parameters([5], spec).items()}
    x, weight = rng.normal(size=(9, 5)), rng.normal(size=(9, 5))

    def value(p, x):
        held = {k: neural.var(v) for k, v in p.items()}
        at = neural.var(x)
        z, det = neural.flow_forward(held, 0, at, spec)
        back = neural.flow_inverse(held, 0, z * 0.7, spec)
        return (z * weight).sum() + (det * det).sum() + (back * back).sum(), held, at

    total, held, at = value(p, x)
    total.backward()
    nodes, todo = set(), [total]
    while todo:
        v = todo.pop()
        if id(v) not in nodes:
            nodes.add(id(v))
            todo += v.parents
    assert len(nodes) < len(p) + 25
    for k in (*rng.choice(sorted(p), 8, replace=False), None):
        own = x if k is None else p[k]
        place = tuple(int(rng.integers(0, n)) for n in own.shape)
        step = np.zeros(own.shape)
        step[place] = 1e-6
        high, low = (float(value({**p, k: own + s} if k else p, x if k else own + s)[0].x) for s in (step, -step))
        assert (held[k].g if k else at.g)[place] == pytest.approx((high - low) / 2e-6, rel=1e-5, abs=1e-6)


def test_embedding_works_out_its_rows_once(spark):
    """Every pass read the joins and groupings anew before."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, *map(float, rng.normal(size=5))) for i in range(60)], "id long, a double, b double, c double, d double, age double").mapInPandas(counted, "id long, a double, b double, c double, d double, age double")
    for make in (
        lambda: linear.add_scores(*embed.embed_table(rows, linear.Spec(k=1, iterations=2), {"x": ["a", "b"], "y": ["c", "d"]}, covariates="age")[::-1]),
        lambda: embed.extend_embedding(rows, {"x": np.eye(2)}, {"x": ["a", "b"]}, {"y": ["c", "d"]})[0],
    ):
        before = seen.value
        assert make().count() == 60 and seen.value - before == 60


PACKED = [{"kind": "lend", "quantile": 0.3}, {"kind": "flow_v", "sign": "any"}, {"kind": "flow"}, {"kind": "flow", "mask": "alternate", "k": 3, "flow_layers": 3}, {"kind": "flow_v"}, {"kind": "flow_v", "topology": "graph", "graph": {}, "mixer": "avg"}, {"kind": "lend"}, {"kind": "lend", "topology": "star", "mixer": "avg", "k": 1, "dropout": 0.0}]


@pytest.mark.parametrize("kw", PACKED)
def test_packed_steps_are_the_differentiators(kw):
    from braidview.plans import packed

    spec = neural.NeuralSpec(**({"k": 2, "hidden": (7, 5), "flow_hidden": 6} | kw))
    rng = np.random.default_rng(8)
    xs = [rng.normal(size=(40, 4)) for _ in range(3)]
    params = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in neural.initial_parameters([4] * 3, spec).items()}
    both = packed.Packed([4] * 3, spec)
    flat = both.pack(params)
    assert packed.fits([4] * 3, spec) and flat.size == sum(v.size for v in params.values())
    assert all((v == params[k]).all() for k, v in both.unpack(flat).items()) and set(both.unpack(flat)) == set(params)
    for epoch, n in ((0, 40), (30, 33), (149, 2), (149, 40)):
        value, grads, _ = neural.gradients(params, [x[:n] for x in xs], spec, epoch, None, np.random.default_rng(5))
        got, own = both.gradients(flat, np.hstack(xs)[:n], epoch, np.random.default_rng(5))
        assert got == pytest.approx(value, rel=1e-12)
        assert all(np.allclose(g, grads[k], rtol=1e-8, atol=1e-10) for k, g in both.unpack(own).items())
    assert not np.isfinite(both.gradients(flat, np.full((5, 12), np.nan), 0, rng)[0])
    assert not any(packed.fits(w, neural.NeuralSpec(**{"kind": "flow", "k": 2} | k)) for w, k in (([4, 3], {}), ([3, 3], {}), ([4, 4], {"mixer": "svd"}), ([4, 4], {"dynamic": True}), ([4, 4], {"energy": "acc"}), ([4, 4], {"kind": "ned"})))


@pytest.mark.parametrize("kind", ["flow", "flow_v", "lend"])
def test_training_takes_packed_steps(kind, monkeypatch):
    """Models of the registered shape train without the differentiator, and get the parameters that it gives."""
    rng = np.random.default_rng(9)
    shared = rng.normal(size=(130, 2))
    xs = [shared @ rng.normal(size=(2, 4)) + 0.1 * rng.normal(size=(130, 4)) for _ in range(2)]
    spec = neural.NeuralSpec(kind=kind, k=2, epochs=12, batch=43, warmup=2, hidden=(6, 4), flow_hidden=6, rate=5e-3)
    plain = neural.gradients
    monkeypatch.setattr(neural, "gradients", lambda *a, **k: pytest.fail("a step by nodes"))
    found = neural.train_arrays(xs, spec)
    monkeypatch.setattr(neural, "gradients", plain)
    monkeypatch.setattr(neural, "fits", lambda *a: False)
    want = neural.train_arrays(xs, spec)
    assert np.allclose(found[1], want[1], rtol=1e-9) and set(found[0]) == set(want[0])
    assert all(np.allclose(v, want[0][k], rtol=0, atol=1e-9) for k, v in found[0].items())


@pytest.mark.parametrize("kind", ["flow", "lend", "ned_private"])
def test_the_first_task_takes_steps_of_small_batches(case, kind, monkeypatch):
    """Rows are sent to it in the order of the epoch; steps that all tasks take together lead to the same parameters."""
    views = {v: cs[:4] for v, cs in case.views.items()}
    spec = neural.NeuralSpec(kind=kind, k=2, epochs=5, batch=50, warmup=2, hidden=(6, 4), flow_hidden=6, rate=5e-3)
    led = neural.fit_neural(case.df, views, spec, tasks=3)
    alone = neural.fit_neural(case.df, views, spec, tasks=1)
    monkeypatch.setattr(neural, "LED_ROWS", 0)
    together = neural.fit_neural(case.df, views, spec, tasks=3)
    assert all((v == alone.params[k]).all() and np.allclose(v, together.params[k], rtol=0, atol=1e-8) for k, v in led.params.items())


def test_rows_are_sent_in_order(monkeypatch):
    """Three tasks' rows reach the first one chunk by chunk in the order of their keys."""
    from types import SimpleNamespace

    monkeypatch.setattr(exchange, "CHUNK_ROWS", 20)
    keys = [neural.epoch_keys(np.arange(a, 90, 3), 0, 1) for a in range(3)]
    rows = [np.arange(a, 90.0, 3)[:, None] for a in range(3)]
    sent = [[], [], []]
    for r in (1, 2):
        assert list(exchange.rows_in_order(SimpleNamespace(collect=sent[r].append), keys[r], rows[r], 90)) == []
    ready = iter(zip(sent[1], sent[2]))
    got = list(exchange.rows_in_order(SimpleNamespace(collect=lambda x: [x, *next(ready)]), keys[0], rows[0], 90))
    assert len(got) == 5 and sorted(np.vstack(got)[:, 0]) == list(range(90))
    place = np.empty(90, dtype=np.int64)
    for k, x in zip(keys, rows):
        place[x[:, 0].astype(int)] = k
    assert (np.diff(place[np.vstack(got)[:, 0].astype(int)]) > 0).all()
