"""What a fit says about features: summaries of bases, alignments, attributions, all from bases and moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gram import Moments, Score, only
from ..functions.linalg import clean, orthogonality_defect, ridge
from ..operators.columns import value
from ..operators.moments import second_moments
from .linear import Fit, add_scores, scaled


def summarise_basis(v, names: Sequence[str] | None = None, top: int = 10, eps: float = 1e-8) -> dict[str, object]:
    """Per component: sizes, density and the ``top`` features (at least one, at most all)."""
    v = clean(v)
    names = list(names) if names else [f"feature_{i}" for i in range(len(v))]
    top = min(max(1, top), len(v))
    leading = []
    for j in range(v.shape[1]):
        order = np.argsort(-np.abs(v[:, j]), kind="stable")[:top]
        leading.append([{"feature": names[i], "index": int(i), "weight": float(v[i, j])} for i in order])
    live = np.abs(v) > eps
    return {
        "l0": live.sum(axis=0).tolist(), "l1": np.abs(v).sum(axis=0).tolist(), "l2": np.sqrt((v**2).sum(axis=0)).tolist(), "component_density": live.mean(axis=0).tolist(),
        "density": float(live.mean()), "orthogonality_defect": orthogonality_defect(v), "top_features": leading,
    }


@dataclass
class Contract:
    """The linear first layer of a fit: bases, summaries and feature names by view. The scores stay expressions on the data."""

    views: dict[str, list[str]]
    bases: list[np.ndarray]
    summaries: list[dict[str, object]]


def contract(f: Fit, top: int = 10) -> Contract:
    return Contract(f.views, f.bases, [summarise_basis(v, names, top) for v, names in zip(f.bases, f.views.values())])


def loadings_table(spark: SparkSession, f: Fit) -> DataFrame:
    """Bases in long form: (view, feature, component, loading)."""
    rows = [(v, c, j + 1, float(b[i, j])) for (v, cs), b in zip(f.views.items(), f.bases) for i, c in enumerate(cs) for j in range(b.shape[1])]
    return spark.createDataFrame(rows, "view string, feature string, component int, loading double")


def feature_importance(v: np.ndarray, component_importance) -> np.ndarray:
    return np.abs(clean(v)) @ np.asarray(component_importance, dtype=float)


def _map(m: Moments, source: Score, target: Score, l2: float) -> dict[str, object]:
    """Ridge of one score on another, from moments."""
    a, b = source.stacked(), target.stacked()
    xx, xy, yy = a.T @ m.gram @ a, a.T @ m.gram @ b, b.T @ m.gram @ b
    w = ridge(xx, xy, l2)
    rest = np.diag(yy - 2.0 * w.T @ xy + w.T @ xx @ w)
    total = np.diag(yy)
    return {"coefficients": w, "r2_by_target": (1.0 - rest / np.maximum(total, 1e-8)).tolist(), "global_r2": float(1.0 - rest.sum() / max(total.sum(), 1e-8))}


def _joined(m: Moments, bases: Sequence[np.ndarray]) -> Score:
    k = [b.shape[1] for b in bases]
    out, at = [], 0
    for i, b in enumerate(bases):
        a = np.zeros((m.width(i), sum(k)))
        a[:, at : at + k[i]] = b
        out.append(a)
        at += k[i]
    return Score(out)


def attribute_scores(f: Fit, l2: float = 1e-6) -> dict[str, object]:
    """How well each view's first layer, and all together, give the score; components weigh by the size of their coefficients.

    With one score per view, each view is held against its own and the joint map against the first view's.
    """
    m, per = f.moments, {}
    for i, (name, b) in enumerate(zip(f.views, f.bases)):
        found = _map(m, only(m, i, b), f.score_of(i), l2)
        weight = np.abs(found["coefficients"]).sum(axis=1)
        per[name] = found | {"component_importance": weight.tolist(), "feature_importance": dict(zip(f.views[name], feature_importance(b, weight).tolist()))}
    return {"per_view": per, "combined": _map(m, _joined(m, f.bases), f.score_of(0), l2)}


def attribute_outcome(df: DataFrame, f: Fit, outcome: str, l2: float = 1e-6) -> dict[str, object]:
    """The same for an outcome column, with the score itself as the mark to reach; one pass over the rows."""
    z = add_scores(scaled_with_outcome(df, f, outcome), f, "_u")
    us = [c for c in z.columns if c.startswith("_u_")]
    names = [c for cs in f.views.values() for c in cs] + us + ["_y"]
    x = scaled(z, f)
    row = x.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names)]).first()
    gram, _, n = second_moments(x, names, [row[f"m{i}"] for i in range(len(names))])
    p, k = len(f.moments.gram), len(us)
    m = Moments(gram[:p, :p], f.moments.cuts, n)
    y, yy = gram[:p, -1], gram[-1, -1]

    def of(a: np.ndarray) -> dict[str, object]:
        w = ridge(a.T @ m.gram @ a, (a.T @ y)[:, None], l2)
        rest = yy - 2.0 * float(w[:, 0] @ (a.T @ y)) + float(w[:, 0] @ (a.T @ m.gram @ a) @ w[:, 0])
        return {"coefficients": w[:, 0].tolist(), "global_r2": 1.0 - rest / max(yy, 1e-8)}

    per = {}
    for i, (name, b) in enumerate(zip(f.views, f.bases)):
        per[name] = of(only(m, i, b).stacked())
        per[name]["feature_importance"] = dict(zip(f.views[name], feature_importance(b, np.abs(per[name]["coefficients"])).tolist()))
    u = ridge(gram[p : p + k, p : p + k], gram[p : p + k, -1:], l2)
    rest = yy - 2.0 * float(u[:, 0] @ gram[p : p + k, -1]) + float(u[:, 0] @ gram[p : p + k, p : p + k] @ u[:, 0])
    return {"per_view": per, "combined": of(_joined(m, f.bases).stacked()), "score": {"global_r2": 1.0 - rest / max(yy, 1e-8)}}


def scaled_with_outcome(df: DataFrame, f: Fit, outcome: str) -> DataFrame:
    return df.select(*[f"`{c}`" for cs in f.views.values() for c in cs], value(outcome).alias("_y")).where(F.col("_y").isNotNull())


def report(f: Fit, top: int = 10) -> dict[str, object]:
    """Contract summaries, attributions and how far the views' layers agree."""
    a = attribute_scores(f)
    return {"sparsity_summary": contract(f, top).summaries, "shared_attribution": a, "alignment": {v: x["global_r2"] for v, x in a["per_view"].items()}}


def report_metrics(r: dict[str, object]) -> dict[str, float]:
    """A report in a few numbers: mean density, mean defect, mean and best alignment, joint attribution."""
    aligned = list(r["alignment"].values())
    return {
        "mean_density": float(np.mean([s["density"] for s in r["sparsity_summary"]])), "mean_defect": float(np.mean([s["orthogonality_defect"] for s in r["sparsity_summary"]])),
        "mean_alignment_r2": float(np.mean(aligned)), "best_alignment_r2": float(np.max(aligned)), "combined_r2": r["shared_attribution"]["combined"]["global_r2"],
    }


def counterfactual(basis: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The change of features that a change of scores asks for: change times basis transposed."""
    return np.asarray(change, dtype=float) @ clean(basis).T
