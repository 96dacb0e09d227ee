"""The linear multi-view model: fit, score, reconstruct, and what can be asked of a fit.

Rows are read once, for scaling statistics and cross-products together; iterations run at the driver on features by
features matrices. Scoring is column arithmetic, map-only, and the same for a row whatever rows it comes with, unless ``transductive`` asks
for the mixing to be made anew on the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.constraints import constrain, parse_constraint, tangent
from ..functions.gram import IcaStep, Moments, Score, array_step, consensus, downhill, energy, only, reconstruction_error, reconstruction_map, rv_of
from ..functions.linalg import canonical_sign, gram_svd, one_sample_t, orthogonality_defect, orthogonality_summary
from ..functions.steps import make_step
from ..operators.columns import value, weighted_sum
from ..operators.moments import filled, first_values, gapped_sums, second_moments, vector_sum
from ..operators.permutations import hashed_order, permuted
from ..operators.prep import Scaling, array_scalings, fit_scalings, scaled_moments
from ..operators.relational import numbered
from ..operators.wide import WideScaling, fit_wide_scalings, project, wide_moments

Views = Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class Spec:
    """What a fit is asked for. ``quantile``: one for all views, or a list by view."""

    k: int
    iterations: int = 100
    step: str = "lars"
    energy: str = "acc"
    constraint: str = "orthox0.1x1"
    mixer: str = "svd"
    quantile: float | Sequence[float] = 0.5
    sign: str = "either"
    smoothers: Sequence[np.ndarray | None] | None = None
    priors: Sequence[np.ndarray | None] | None = None
    prior_weights: float | Sequence[float] | None = None
    topology: str = "star"
    graph: Mapping[int, Sequence[int]] | None = None
    prune: float | None = None
    scale: Sequence[str] = ("centerAndScale", "np")
    tol: float = 1e-6
    step_options: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.priors is not None and self.prior_weights is None:
            raise ValueError("priors need prior_weights")


@dataclass
class Fit:
    spec: Spec
    views: dict[str, list[str]]
    scalings: dict[str, Scaling]
    bases: list[np.ndarray]
    scores: list[Score]
    maps: list[np.ndarray]
    energies: list[float]
    rounds: int
    n: int
    moments: Moments

    def score_of(self, i: int) -> Score:
        return self.scores[i if len(self.scores) > 1 else 0]

    @property
    def orthogonality(self) -> list[dict[str, float]]:
        return [orthogonality_summary(v) for v in self.bases]


def initial_bases(m: Moments, k: int, seed: int = 0) -> list[np.ndarray]:
    """Leading right singular vectors of every view, turned so that their largest entries are positive (the mean of views depends on it); views with fewer columns than ``k`` are filled up with small noise."""
    rng, out = np.random.default_rng(seed), []
    for i in range(m.views):
        _, v = m.svd(i, k)
        v = canonical_sign(v)
        out.append(np.hstack([v, 1e-4 * rng.standard_normal((len(v), k - v.shape[1]))]) if v.shape[1] < k else v)
    return out


def solve(m: Moments, spec: Spec, rows=None) -> tuple[list[np.ndarray], list[Score], list[float], int]:
    """Bases, scores, energies by round and the number of rounds; no job of its own (but for the ica mixer's ``rows``)."""
    rule, step, views = parse_constraint(spec.constraint), make_step(spec.step, **spec.step_options), range(m.views)
    bases = initial_bases(m, spec.k)
    priors = list(spec.priors) if spec.priors is not None else [None] * m.views
    pull = spec.prior_weights if isinstance(spec.prior_weights, (list, tuple)) else [spec.prior_weights or 0.0] * m.views
    share, bend, draw = [1.0] * m.views, [1.0] * m.views, [1.0] * m.views
    agree = lambda: consensus(m, bases, spec.mixer, spec.topology, spec.graph, spec.prune, rows=rows)
    held = lambda v, i: constrain(v, rule, spec.quantile, spec.sign, spec.smoothers[i] if spec.smoothers else None, i)
    history: list[float] = []
    for turn in range(spec.iterations):
        scores = agree()
        u = [scores[i if len(scores) > 1 else 0] for i in views]
        for i in views:

            def cost(v: np.ndarray, i: int = i) -> float:
                v = held(v, i)
                total = share[i] * energy(m, i, v, u[i], spec.energy)
                if priors[i] is not None:
                    total += draw[i] * energy(m, i, v, u[i], "dat", priors[i], pull[i])
                if rule.kind == "ortho":
                    total += rule.weight * bend[i] * orthogonality_defect(v)
                return total

            here = np.abs(bases[i]) if spec.sign == "positive" else bases[i]
            way = share[i] * downhill(m, i, here, u[i], spec.energy)
            if priors[i] is not None:
                way = way + draw[i] * downhill(m, i, here, u[i], "dat", priors[i], pull[i])
            bases[i] = held(step(i, bases[i], held(tangent(way, here, rule.kind), i), cost), i)
        if turn == 0:
            for i in views:
                first, defect = energy(m, i, bases[i], u[i], spec.energy), orthogonality_defect(bases[i])
                share[i] = 1.0 / (abs(first) * m.views + 1e-10)
                bend[i] = abs(first) * share[i] / defect if defect > 1e-10 else 0.0
                if priors[i] is not None:
                    raw = abs(energy(m, i, bases[i], u[i], "dat", priors[i], pull[i]))
                    draw[i] = abs(first) * share[i] / raw if raw > 1e-10 else 1.0
        history.append(sum(share[i] * energy(m, i, bases[i], u[i], spec.energy) for i in views))
        if turn and abs(history[-2] - history[-1]) < spec.tol * (abs(history[-2]) + 1e-10):
            break
    return bases, agree(), history, len(history)


def fit(df: DataFrame, views: Views, spec: Spec) -> Fit:
    """Fit the model. Only the ica mixer needs rows in its iterations."""
    views = {v: list(cs) for v, cs in views.items()}
    scalings, m = fit_scalings(df, views, spec.scale, moments=True)
    rows = _row_reader(df, scalings, m) if spec.mixer == "ica" else None
    bases, scores, history, rounds = solve(m, spec, rows)
    by_view = scores if len(scores) > 1 else scores * m.views
    return Fit(spec, views, scalings, bases, scores, [reconstruction_map(m, i, u) for i, u in enumerate(by_view)], history, rounds, m.n, m)


def fit_arrays(views: Mapping[str, np.ndarray], spec: Spec, names: Views | None = None) -> Fit:
    """The same fit of small views that the driver holds as arrays; columns are named <view>_0 ... unless ``names`` says otherwise."""
    named = {v: list(names[v]) if names else [f"{v}_{i}" for i in range(np.shape(x)[1])] for v, x in views.items()}
    scalings, m = array_scalings(views, named, spec.scale)
    rows = None
    if spec.mixer == "ica":
        x = np.hstack([(np.where(np.isfinite(x), x, s.nan_fill) - s.shift) * s.factor for x, s in zip(views.values(), scalings.values())])
        x = x - x.mean(axis=0)
        rows = lambda b: array_step(x @ b)
    bases, scores, history, rounds = solve(m, spec, rows)
    by_view = scores if len(scores) > 1 else scores * m.views
    return Fit(spec, named, scalings, bases, scores, [reconstruction_map(m, i, u) for i, u in enumerate(by_view)], history, rounds, m.n, m)


def by_case(df: DataFrame, case: str, views: Views, scale: Sequence[str], of: Callable[[Moments, dict[str, Scaling]], Mapping[str, object]], schema: str) -> DataFrame:
    """``case n`` and the columns of ``schema``, which ``of`` makes from the scalings and moments of each case's rows: one job for all cases.

    Tasks add up cross-products case by case, and what is asked of a case is worked out where its sums come together, so neither a case's rows nor all cases' sums are anywhere in one
    place. A null case counts as "".
    """
    views = {v: list(cs) for v, cs in views.items()}
    every, cuts = [c for cs in views.values() for c in cs], [0, *np.cumsum([len(cs) for cs in views.values()]).tolist()]
    shift, size = first_values(df, every), 2 * len(every) + 1
    names = [x.split()[0] for x in schema.split(", ")]

    def answer(table: pa.Table) -> pa.Table:
        sums = np.zeros(size * size)
        sums[table.column("at").to_numpy()] = table.column("v").to_numpy()
        found = filled(sums.reshape(size, size), shift, cuts)
        scalings, m = scaled_moments(found, views, scale)
        made = of(m, scalings)
        return pa.table({"case": table.column("case").slice(0, 1), "n": pa.array([found.n], pa.int64()), **{k: pa.array([made[k]]) for k in names}})

    sums = gapped_sums(df, every, shift, case)
    spread = sums.repartition(df.sparkSession.sparkContext.defaultParallelism, "case")  # fits cost more than their sums weigh
    return spread.groupBy("case").applyInArrow(answer, f"case string, n long, {schema}")


def fit_by_case(df: DataFrame, case: str, views: Views, spec: Spec) -> DataFrame:
    """A fit for every case, all in one job: ``case n rounds energies bases maps`` (bases and score maps by view, row after row)."""
    if spec.mixer == "ica":
        raise ValueError("fits by case see no rows, which the ica mixer needs")

    def fitted(m: Moments, scalings: dict[str, Scaling]) -> dict[str, object]:
        bases, scores, history, rounds = solve(m, spec)
        return {"rounds": rounds, "energies": [float(x) for x in history], "bases": [v.ravel().tolist() for v in bases], "maps": [x.ravel().tolist() for u in scores for x in u.maps]}

    return by_case(df, case, views, spec.scale, fitted, "rounds long, energies array<double>, bases array<array<double>>, maps array<array<double>>")


@dataclass
class WideFit:
    """A fit of wide views (see :mod:`..operators.wide`): bases and maps have a row a column."""

    spec: Spec
    views: dict[str, int]
    scalings: dict[str, WideScaling]
    bases: list[np.ndarray]
    scores: list[Score]
    energies: list[float]
    moments: Moments


def fit_wide(df: DataFrame, views: Mapping[str, int], spec: Spec, rank: int = 20, passes: int = 2) -> WideFit:
    """The fit of sparse views with ``views[name]`` columns each, from moments of rank ``rank``; the driver holds columns times rank numbers.

    The ica mixer needs rows and isn't offered here; ``centerAndScale`` and ``np`` are the scalings.
    """
    if spec.mixer == "ica":
        raise ValueError("wide views aren't mixed by independent components")
    scalings, n = fit_wide_scalings(df, views, "centerAndScale" in spec.scale, "np" in spec.scale)
    m = wide_moments(df, scalings, n, rank, passes=passes)
    bases, scores, history, _ = solve(m, spec)
    return WideFit(spec, dict(views), scalings, bases, scores, history, m)


def add_wide_scores(df: DataFrame, f: WideFit, prefix: str = "u") -> DataFrame:
    """Columns u_1 ... u_k (with one score per view: u_<view>_1 ...); map-only."""
    for i, u in enumerate(f.scores):
        tag = prefix if len(f.scores) == 1 else f"{prefix}_{list(f.views)[i]}"
        df = project(df, f.scalings, dict(zip(f.views, u.maps)), [f"{tag}_{j + 1}" for j in range(u.maps[0].shape[1])])
    return df


#: Cells (rows times columns) that the ica mixer brings to the driver, which spares a job for each of its steps; beyond, its sums are made where the rows are.
ICA_CELLS = 5_000_000


def _row_reader(df: DataFrame, scalings: dict[str, Scaling], m: Moments) -> Callable[[np.ndarray], IcaStep]:
    """Steps of the ica mixer on projections of the scaled rows."""
    names = [c for s in scalings.values() for c in s.columns]
    mean = np.concatenate([np.array(s.steps["scaled_mean"]) for s in scalings.values()])
    rows = df
    for s in scalings.values():
        rows = s.apply(rows)
    rows = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    if m.n * len(m.gram) <= ICA_CELLS:
        x = np.array([tuple(r) for r in rows.collect()], dtype=float) - mean
        return lambda b: array_step(x @ b)

    def of(b: np.ndarray) -> IcaStep:
        q = b.shape[1]

        def step(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = a.shape[1]

            def sums(batch: np.ndarray) -> np.ndarray:
                y = (batch - mean) @ b
                g = np.tanh(y @ a)
                return np.concatenate([(y.T @ g).ravel(), (1.0 - g**2).sum(axis=0)])

            total = vector_sum(rows, sums, q * k + k) / m.n
            return total[: q * k].reshape(q, k), total[q * k :]

        return step

    return of


def scaled(df: DataFrame, f: Fit) -> DataFrame:
    for s in f.scalings.values():
        df = s.apply(df)
    return df


def _with_maps(df: DataFrame, f: Fit, made: Mapping[str, tuple[list[str], np.ndarray, float]]) -> DataFrame:
    """Add columns that are a constant plus weighted sums of scaled columns, without changing those."""
    raw = {c: (s, i) for s in f.scalings.values() for i, c in enumerate(s.columns)}
    out = {}
    for name, (columns, weights, constant) in made.items():
        e = F.lit(float(constant))
        for c, w in zip(columns, weights):
            if w:
                s, i = raw[c]
                e = e + (F.coalesce(value(c), F.lit(s.nan_fill)) - F.lit(s.shift[i])) * F.lit(float(w * s.factor[i]))
        out[name] = e
    return df.withColumns(out)


def _offsets(df: DataFrame, f: Fit) -> np.ndarray:
    """Means of the scaled columns in ``df``."""
    names = [c for s in f.scalings.values() for c in s.columns]
    row = scaled(df, f).agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names)]).first()
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(names))])


def remix(df: DataFrame, f: Fit) -> tuple[list[Score], np.ndarray, Moments]:
    """The consensus made anew on ``df``, the scaled columns' means there, and its moments."""
    names = [c for s in f.scalings.values() for c in s.columns]
    mean = _offsets(df, f)
    gram, _, n = second_moments(scaled(df, f), names, mean)
    m = Moments(gram, f.moments.cuts, n)
    return consensus(m, f.bases, f.spec.mixer, f.spec.topology, f.spec.graph, f.spec.prune), mean, m


def add_scores(df: DataFrame, f: Fit, prefix: str = "u", transductive: bool = False) -> DataFrame:
    """Columns u_1 ... u_k (with one score per view: u_<view>_1 ...)."""
    names = [c for s in f.scalings.values() for c in s.columns]
    scores, mean = f.scores, np.concatenate([np.array(s.steps["scaled_mean"]) for s in f.scalings.values()])
    if transductive:
        scores, mean, _ = remix(df, f)
    made = {}
    for i, u in enumerate(scores):
        a = u.stacked()
        tag = prefix if len(scores) == 1 else f"{prefix}_{list(f.views)[i]}"
        for j in range(a.shape[1]):
            made[f"{tag}_{j + 1}"] = (names, a[:, j], -float(mean @ a[:, j]))
    return _with_maps(df, f, made)


def add_latents(df: DataFrame, f: Fit, prefix: str = "z") -> DataFrame:
    """Each view's own projection: z_<view>_1 ..."""
    return _with_maps(df, f, {f"{prefix}_{v}_{j + 1}": (cs, b[:, j], 0.0) for (v, cs), b in zip(f.views.items(), f.bases) for j in range(b.shape[1])})


def add_reconstructions(df: DataFrame, f: Fit, prefix: str = "r", transductive: bool = False) -> DataFrame:
    """Each scaled column as the scores give it: r_<column>. What a view lacks is imputed from the others if its columns are missing."""
    scored = add_scores(df, f, "_u", transductive)
    made = {}
    for i, (v, cs) in enumerate(f.views.items()):
        tag = "_u" if len(f.scores) == 1 else f"_u_{v}"
        us = [f"{tag}_{j + 1}" for j in range(len(f.maps[i]))]
        made |= {f"{prefix}_{c}": weighted_sum(us, f.maps[i][:, n]) for n, c in enumerate(cs)}
    return scored.withColumns(made).drop(*[c for c in scored.columns if c.startswith("_u_")])


def errors(df: DataFrame, f: Fit) -> dict[str, float]:
    """Relative reconstruction error per view on new rows, from their moments."""
    names = [c for s in f.scalings.values() for c in s.columns]
    gram, _, n = second_moments(scaled(df, f), names, np.zeros(len(names)))
    m = Moments(gram, f.moments.cuts, n)
    return {v: reconstruction_error(m, i, f.score_of(i), f.maps[i]) for i, v in enumerate(f.views)}


def predict(df: DataFrame, f: Fit, transductive: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """Scores, latents and reconstructions of new rows, and the views' errors."""
    if not f.maps:
        raise ValueError("the fit has no reconstruction maps")
    return add_latents(add_scores(add_reconstructions(df, f, transductive=transductive), f, transductive=transductive), f), errors(df, f)


def pair_similarity(f: Fit) -> dict[tuple[str, str], float]:
    """RV coefficients of the views' own projections."""
    names = list(f.views)
    own = [only(f.moments, i, v) for i, v in enumerate(f.bases)]
    return {(names[i], names[j]): rv_of(f.moments, own[i], own[j]) for i in range(len(names)) for j in range(i + 1, len(names))}


def decompose(f: Fit, kind: str | None = None) -> dict[str, dict[str, object]]:
    """Energy of each view and the size of its descent direction by feature."""
    kind, out = kind or f.spec.energy, {}
    for i, (v, cs) in enumerate(f.views.items()):
        way = np.abs(downhill(f.moments, i, f.bases[i], f.score_of(i), kind)).sum(axis=1)
        out[v] = {"energy": energy(f.moments, i, f.bases[i], f.score_of(i), kind), "features": dict(zip(cs, way.tolist()))}
    return out


def shuffled(df: DataFrame, key: str, views: Views, seed: int) -> DataFrame:
    """Rows of every view put in an order of their own, by a hash of seed, view and key, and joined by their places.

    The order depends on keys and seed alone. One exchange per view; no task orders all rows.
    """
    names = list(views)
    out = ranked(df.select(*[f"`{c}`" for c in views[names[0]]], F.col(key)), hashed_order(seed, 0, key), key)
    for i, v in enumerate(names[1:], 1):
        other = ranked(df.select(*[f"`{c}`" for c in views[v]], F.col(key).alias("_other")), hashed_order(seed, i, "_other"), "_other").drop("_other")
        out = out.join(other, "_place")
    return out.drop("_place")


def ranked(df: DataFrame, order: Column, tie: str, place: str = "_place") -> DataFrame:
    """Rows numbered from 1 in the order of ``order`` (then ``tie``), without gathering them."""
    return numbered(df.withColumn("_order", order), "_order", tie, place=place)[0].drop("_order")


def permutation_moments(df: DataFrame, key: str, f_scalings: Mapping[str, Scaling], views: Views, seed: int) -> Moments:
    """Moments with rows of the views shuffled against each other."""
    rows = shuffled(df, key, views, seed)
    for s in f_scalings.values():
        rows = s.apply(rows)
    names = [c for cs in views.values() for c in cs]
    mean = np.zeros(len(names))
    gram, total, n = second_moments(rows, names, mean)
    gram = gram - np.outer(total, total) / n
    return Moments(gram, [0, *np.cumsum([len(cs) for cs in views.values()]).tolist()], n)


@contextmanager
def _held(df: DataFrame, key: str, views: Views) -> Iterator[DataFrame]:
    """Key and views' columns of ``df``, computed once however often they are shuffled."""
    rows = df.select(*[f"`{c}`" for c in dict.fromkeys([key, *[c for cs in views.values() for c in cs]])]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def null_values(df: DataFrame, key: str, scalings: Mapping[str, Scaling], m: Moments, permutations: int, seed: int, of: Callable[[Moments], Sequence[float]], size: int = 1, **options) -> np.ndarray:
    """What ``of`` gives for each of many permutations of the views' rows (see :mod:`..operators.permutations`), a row of ``size`` numbers each: one job."""
    rows, names = df, []
    for s in scalings.values():
        rows = s.apply(rows)
        rows = rows.withColumns({c: F.col(f"`{c}`") - F.lit(float(x)) for c, x in zip(s.columns, s.steps["scaled_mean"])})
        names += s.columns
    return permuted(rows, key, names, m, permutations, seed, of, size, **options)


def final_energy(m: Moments, bases: Sequence[np.ndarray], scores: Sequence[Score], kind: str) -> float:
    return sum(energy(m, i, bases[i], scores[i if len(scores) > 1 else 0], kind) for i in range(m.views))


def refit_test(df: DataFrame, key: str, views: Views, spec: Spec, permutations: int = 50, seed: int = 0) -> dict[str, object]:
    """Final energy against those of fits to permuted views: one-sample t of the null against the observed one, alternative "less"."""

    def refitted(m: Moments) -> list[float]:
        bases, _, _, _ = solve(m, spec)
        return [final_energy(m, bases, consensus(m, bases, spec.mixer, spec.topology, spec.graph), spec.energy)]

    with _held(df, key, views) as rows:
        seen = fit(rows, views, spec)
        null = null_values(rows, key, seen.scalings, seen.moments, permutations, seed, refitted)[:, 0].tolist()
    observed = final_energy(seen.moments, seen.bases, seen.scores, spec.energy)
    t, p = one_sample_t(null, observed, "less") if permutations > 1 and np.std(null) > 0 else (0.0, 1.0)
    return {"observed": observed, "null": null, "t": t, "p": p}


def mean_alignment(m: Moments, bases: Sequence[np.ndarray], scores: Sequence[Score]) -> float:
    return float(np.mean([rv_of(m, only(m, i, v), scores[i if len(scores) > 1 else 0]) for i, v in enumerate(bases)]))


def alignment_test(df: DataFrame, key: str, views: Views, spec: Spec, permutations: int = 100, seed: int = 0) -> dict[str, object]:
    """Mean RV of view projections with the score against shuffled refits; p is the share of the null at or above it."""

    def refitted(m: Moments) -> list[float]:
        bases, scores, _, _ = solve(m, spec)
        return [mean_alignment(m, bases, scores)]

    with _held(df, key, views) as rows:
        seen = fit(rows, views, spec)
        observed = mean_alignment(seen.moments, seen.bases, seen.scores)
        null = null_values(rows, key, seen.scalings, seen.moments, permutations, seed, refitted)[:, 0].tolist()
    return {"observed": observed, "null": null, "p": float(np.mean([x >= observed for x in null])) if null else 1.0}


def _alignment_curve(m: Moments, top: int) -> np.ndarray:
    """For 1 ... ``top`` components the mean RV of each view's subspace with the consensus of the others'."""
    left = []
    for i in range(m.views):
        s, v = m.svd(i, top)
        left.append(v / np.where(s > 0, s, np.inf))
    out = []
    for k in range(1, top + 1):
        values = []
        for i in range(m.views):
            others = [j for j in range(m.views) if j != i]
            big = np.zeros((len(m.gram), k * len(others)))
            for n, j in enumerate(others):
                big[m.cuts[j] : m.cuts[j + 1], n * k : (n + 1) * k] = left[j][:, :k]
            s, t = gram_svd(big.T @ m.gram @ big, k)
            joint = big @ (t / np.where(s > 0, s, np.inf))
            rest = Score([joint[m.cuts[j] : m.cuts[j + 1]] for j in range(m.views)])
            values.append(rv_of(m, only(m, i, left[i][:, :k]), rest))
        out.append(float(np.mean(values)))
    return np.array(out)


def estimate_rank(df: DataFrame, key: str, views: Views, permutations: int = 20, share: float = 0.99, seed: int = 0) -> int:
    """Shared rank: where the alignment of views stands out most from that of shuffled ones; without permutations the curve's elbow.

    The search ends at the smallest number of components that holds ``share`` of some view's variance.
    """
    views = {v: list(cs) for v, cs in views.items()}
    with _held(df, key, views) as rows:
        return _estimate_rank(rows, key, views, permutations, share, seed)


def _estimate_rank(df: DataFrame, key: str, views: Views, permutations: int, share: float, seed: int) -> int:
    scalings, m = fit_scalings(df, views, ["center"], moments=True)
    tops = []
    for i in range(m.views):
        s, _ = gram_svd(m.block(i, i))
        tops.append(int(np.argmax(np.cumsum(s**2) >= share * (s**2).sum())) + 1)
    top = max(1, min(tops))
    real = _alignment_curve(m, top)
    if permutations and m.views > 1:
        null = null_values(df, key, scalings, m, permutations, seed, lambda x: _alignment_curve(x, top), top)
        return int(np.argmax(real - null.mean(axis=0))) + 1
    if len(real) < 3:
        return 1
    height = (real - real.min()) / (real.max() - real.min() + 1e-10)
    return int(np.argmax(height - np.linspace(0, 1, len(real)))) + 1


def path(df: DataFrame, views: Views, steps: Sequence[Sequence[int]], spec: Spec) -> list[dict[str, object]]:
    """Fits of growing sets of views, all from one set of moments; each with the RV of its score to the last one's."""
    views = {v: list(cs) for v, cs in views.items()}
    _, m = fit_scalings(df, views, spec.scale, moments=True)
    found = []
    for chosen in steps:
        sub = m.subset(chosen)
        bases, scores, history, _ = solve(sub, spec)
        a = np.zeros((len(m.gram), spec.k))
        for n, i in enumerate(chosen):
            a[m.cuts[i] : m.cuts[i + 1]] = scores[0].maps[n]
        found.append((list(chosen), bases, Score([a[m.cuts[i] : m.cuts[i + 1]] for i in range(m.views)]), history))
    return [{"views": c, "bases": b, "score": u, "energies": h, "rv_with_last": rv_of(m, u, found[-1][2])} for c, b, u, h in found]


def path_graph(edges: Sequence[tuple[int, int]], views: int) -> dict[int, list[int]]:
    """Undirected neighbours of every view."""
    out: dict[int, list[int]] = {i: [] for i in range(views)}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            if y not in out[x]:
                out[x].append(y)
    return out


def structural_models(df: DataFrame, views: Views, graphs: Mapping[str, Mapping[int, Sequence[int]]], spec: Spec) -> dict[str, dict[str, object]]:
    """One fit per graph, with the mean of its last five energies."""
    from dataclasses import replace

    out = {}
    for name, g in graphs.items():
        f = fit(df, views, replace(spec, topology="graph", graph=g))
        out[name] = {"fit": f, "loss": float(np.mean(f.energies[-5:]))}
    return out


def canonical(f: Fit) -> Fit:
    """The same fit with every score column turned so that its largest map entry is positive."""
    for u in f.scores:
        a = u.stacked()
        turn = np.where((canonical_sign(a) * a).sum(axis=0) < 0, -1.0, 1.0)
        u.maps[:] = [x * turn for x in u.maps]
        if len(f.scores) == 1:
            f.maps[:] = [w * turn[:, None] for w in f.maps]
    return f
