"""Quality of fits on rows: recovery, prediction, reconstruction, spread. Everything comes from one pass of moments per table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import orthogonality_defect, procrustes_from_grams, procrustes_r2, ridge, rv_from_grams
from ..operators.columns import value
from ..operators.moments import second_moments


def _centred(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    row = df.agg(*[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    gram, _, n = second_moments(df, columns, mean)
    return gram, mean, n


def latent_recovery(df: DataFrame, found: Sequence[str], true: Sequence[str]) -> float:
    """Procrustes R^2 of score columns against true ones."""
    g, _, _ = _centred(df, [*found, *true])
    k = len(found)
    return procrustes_from_grams(np.trace(g[:k, :k]), np.trace(g[k:, k:]), g[:k, k:])


def rv_columns(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> float:
    g, _, _ = _centred(df, [*left, *right])
    k = len(left)
    return rv_from_grams(g[:k, :k], g[k:, k:], g[:k, k:])


def outcome_r2(df: DataFrame, scores: Sequence[str], outcome: str) -> float:
    """In-sample R^2 of least squares on the scores."""
    g, _, _ = _centred(df, [*scores, outcome])
    k = len(scores)
    b = np.linalg.pinv(g[:k, :k]) @ g[:k, k]
    return float(1.0 - (g[k, k] - b @ g[:k, k]) / g[k, k]) if g[k, k] > 0 else 0.0


def held_out_r2(train: DataFrame, test: DataFrame, scores: Sequence[str], outcome: str) -> float:
    """R^2 on ``test`` of least squares fitted on ``train``."""
    g, mean, _ = _centred(train, [*scores, outcome])
    k = len(scores)
    b = ridge(g[:k, :k], g[:k, k : k + 1], 0.0)[:, 0]
    h, total, n = second_moments(test, [*scores, outcome], mean)
    rest = h[k, k] - 2.0 * b @ h[:k, k] + b @ h[:k, :k] @ b
    spread = h[k, k] - total[k] ** 2 / n
    return float(1.0 - rest / spread) if spread > 0 else 0.0


def is_classification(df: DataFrame, outcome: str, fewest: int = 10) -> bool:
    """Fewer than ten different values, all whole numbers."""
    row = df.agg(F.countDistinct(outcome), F.max(F.when(F.col(outcome) != F.floor(outcome), 1).otherwise(0))).first()
    return row[0] < fewest and not row[1]


def held_out_accuracy(train: DataFrame, test: DataFrame, scores: Sequence[str], outcome: str) -> float:
    """Accuracy of logistic regression (ridge as with C = 1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    put = VectorAssembler(inputCols=list(scores), outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol=outcome, regParam=1.0 / max(1, train.count()), standardization=False).fit(put.transform(train))
    return float(model.transform(put.transform(test)).agg(F.avg((F.col("prediction") == F.col(outcome)).cast("double"))).first()[0])


def held_out(train: DataFrame, test: DataFrame, scores: Sequence[str], outcome: str) -> dict[str, float]:
    if is_classification(train, outcome):
        return {"accuracy": held_out_accuracy(train, test, scores, outcome)}
    return {"r2": held_out_r2(train, test, scores, outcome)}


def reconstruction_mse(df: DataFrame, views: dict[str, Sequence[str]], prefix: str = "r") -> float:
    """Mean over views of the mean squared difference of columns and their reconstructions."""
    per = []
    for cs in views.values():
        terms = [F.avg((value(c) - F.col(f"`{prefix}_{c}`")) ** 2) for c in cs]
        per.append(sum(terms[1:], terms[0]) / len(terms))
    row = df.agg(*[p.alias(f"v{i}") for i, p in enumerate(per)]).first()
    return float(np.mean(list(row)))


def spread(df: DataFrame, scores: Sequence[str], least: float = 1e-4) -> dict[str, float]:
    """Deviations of scores: mean, extremes, their ratio, and how many have collapsed."""
    row = df.agg(*[F.stddev_samp(value(c)).alias(f"s{i}") for i, c in enumerate(scores)]).first()
    s = np.array([x or 0.0 for x in row])
    return {"u_std_mean": float(s.mean()), "u_std_min": float(s.min()), "u_std_max": float(s.max()), "u_std_ratio": float(s.max() / (s.min() + 1e-8)), "collapsed_dims": int((s < least).sum())}


def shared_private(df: DataFrame, shared: dict[str, Sequence[str]], private: dict[str, Sequence[str]]) -> dict[str, float]:
    """RV overlap of each view's shared and private scores, and their total variances."""
    over, names = [], [c for x in (shared, private) for cs in x.values() for c in cs]
    g, _, n = _centred(df, names)
    at = {c: i for i, c in enumerate(names)}
    for v in shared:
        a, b = [at[c] for c in shared[v]], [at[c] for c in private[v]]
        over.append(rv_from_grams(g[np.ix_(a, a)], g[np.ix_(b, b)], g[np.ix_(a, b)]))
    total = lambda x: float(sum(g[at[c], at[c]] for cs in x.values() for c in cs) / (n - 1))
    return {"shared_private_overlap": float(np.mean(over)), "shared_variance": total(shared), "private_variance": total(private)}


def basis_recovery(found: Sequence[np.ndarray], true: Sequence[np.ndarray]) -> float:
    return float(np.mean([procrustes_r2(t, f) for f, t in zip(found, true)]))


def basis_orthogonality(bases: Sequence[np.ndarray]) -> float:
    return float(np.mean([orthogonality_defect(v) for v in bases]))


def consistency(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> float:
    """Mean size of the correlation of paired score columns."""
    row = df.agg(*[F.abs(F.corr(value(a), value(b))).alias(f"r{i}") for i, (a, b) in enumerate(zip(left, right))]).first()
    return float(np.mean([0.0 if x is None or math.isnan(x) else x for x in row]))


def all_metrics(df: DataFrame, scores: Sequence[str], true: Sequence[str] | None = None, outcome: str | None = None, views: dict[str, Sequence[str]] | None = None) -> dict[str, float]:
    out: dict[str, float] = dict(spread(df, scores))
    if true:
        out["recovery"] = latent_recovery(df, scores, true)
    if outcome:
        out["outcome_r2"] = outcome_r2(df, scores, outcome)
    if views:
        out["recon_error"] = reconstruction_mse(df, views)
    return out
