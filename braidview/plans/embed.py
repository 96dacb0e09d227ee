"""From a named-column table to an embedding, and its extension by new views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gram import Moments
from ..functions.linalg import gram_svd, unit_columns
from ..operators.columns import apply_bases, apply_bases_shortened, assemble_views, imaging_predictors, quality_rows, value, weighted_sum
from ..operators.moments import correlation_adjacency
from ..operators.prep import derived, fit_scalings, impute_column_means, residualise, standardise_block
from ..sources.scratch import stored
from .linear import Fit, Spec, fit
from .neural import NeuralFit, NeuralSpec, fit_neural


def _settled(df: DataFrame) -> DataFrame:
    """Rows that come out of joins or groupings, written once: each of the passes that follow would work them out again."""
    return stored(df, "embed") if derived(df) else df


def embed_table(
    df: DataFrame, spec: Spec | NeuralSpec, views: Mapping[str, Sequence[str]] | None = None, grade: str | None = "T1Hier_resnetGrade", least_grade: float = 1.02, mask: Column | None = None,
    covariates: str | Sequence[str] | None = None, asymmetry: bool = True,
) -> tuple[Fit | NeuralFit, DataFrame]:
    """Pick the views by column names, keep the rows of good quality, impute means, take out covariates, fit.

    The constraint of ``spec`` is honoured for linear fits. Also returns the prepared rows.
    """
    if views is None:
        views = assemble_views(imaging_predictors(df.columns, asymmetry))
    if not views:
        raise ValueError("no column belongs to any view")
    rows = quality_rows(df, grade, least_grade, mask) if grade and grade in df.columns else df if mask is None else df.where(mask)
    names = [c for cs in views.values() for c in cs]
    rows = impute_column_means(_settled(rows), names)
    if covariates:
        for cs in views.values():
            rows = residualise(rows, list(cs), covariates)
    return (fit(rows, views, spec) if isinstance(spec, Spec) else fit_neural(rows, views, spec)), rows


def components_needed(m: Moments, i: int, method: str = "cumulative", share: float = 0.9, least: int = 2) -> int:
    """How many components a view asks for: enough variance, or the largest drop between neighbouring singular values."""
    s, _ = gram_svd(m.block(i, i))
    if method == "cumulative":
        k = int(np.argmax(np.cumsum(s**2) >= share * (s**2).sum())) + 1
    else:
        k = int(np.argmax(s[:-1] / np.maximum(s[1:], 1e-12))) + 1 if len(s) > 1 else 1
    return max(least, min(k, m.width(i)))


def combined(counts: Sequence[int], policy: str = "max", least: int = 2) -> int:
    """One rank for several views."""
    if policy not in ("max", "median", "min"):
        raise ValueError("policy is max, median or min")
    return max(least, int({"max": np.max, "median": np.median, "min": np.min}[policy](list(counts))))


def prefixes(names: Sequence[str]) -> list[str]:
    """What stands before the first separator of each name, sorted."""
    return sorted({n.split("_", 1)[0].split(".", 1)[0] for n in names})


def extend_embedding(
    df: DataFrame, bases: Mapping[str, np.ndarray], features: Mapping[str, Sequence[str]], new_views: Mapping[str, Sequence[str]], spec: Spec | None = None, mode: str = "concatenate",
    split: Sequence[str] = ("t1", "dt", "rsf"), k_new: Mapping[str, int] | int | None = None, method: str = "cumulative", share: float = 0.9, policy: str = "max", drop: str = "drop",
    adjacency: float | None = 0.8, model: str = "linear",
) -> tuple[DataFrame, dict[str, object]]:
    """Add new views to an embedding: score the old blocks, fit the scores (one block, or one by prefix) with the new views, and append the new scores.

    Old and new bases get unit columns. ``adjacency`` smooths linear fits by the thresholded correlations of each block's columns.
    """
    if mode not in ("concatenate", "split", "auto"):
        raise ValueError("mode is concatenate, split or auto")
    names = [c for cs in new_views.values() for c in cs]
    missing = [c for c in names if c not in df.columns]
    taken = [v for v in new_views if v in bases]
    if missing or taken:
        raise ValueError(f"missing columns {missing}; views that exist already {taken}")
    rows, scored = apply_bases_shortened(_settled(df), bases, features)
    if not scored:
        raise ValueError("no feature of the embedding is in the table")
    blocks: dict[str, list[str]] = {}
    if mode == "concatenate":
        blocks["joint"] = scored
    else:
        for p in prefixes(scored) if mode == "auto" else split:
            own = [c for c in scored if c.startswith(p)]
            if own:
                blocks[p] = own
    work = rows
    kept = {}
    for b, cs in {**blocks, **new_views}.items():
        copies = [f"_{b}_{c}" for c in cs]
        work = work.select("*", *[value(c).alias(k) for c, k in zip(cs, copies)])
        work, kept[b] = standardise_block(work, copies, drop)
    scalings, m = fit_scalings(work, kept, ["centerAndScale"], moments=True)
    order = list(kept)
    counts = {v: (k_new if isinstance(k_new, int) else (k_new or {}).get(v)) or components_needed(m, order.index(v), method, share) for v in new_views}
    k = min(combined(list(counts.values()), policy), min(len(c) for c in kept.values()) if model != "linear" else 10**9)
    smooth = [correlation_adjacency(work, kept[v], adjacency) for v in order] if adjacency is not None and model == "linear" else None
    if model == "linear":
        f = fit(work, kept, replace(spec or Spec(k=k, iterations=30), k=k, smoothers=smooth))
    else:
        f = fit_neural(work, kept, NeuralSpec(kind=model, k=k, epochs=30))
    found = {v: unit_columns(b) for v, b in zip(order, f.bases)}
    added = []
    for v in new_views:
        made = {}
        for j in range(found[v].shape[1]):
            made[f"{v}_PC{j + 1}"] = weighted_sum(kept[v], found[v][:, j])
        work = work.withColumns(made)
        added += made
    out = work.drop(*[c for cs in kept.values() for c in cs])
    everything = {b: unit_columns(np.asarray(x, dtype=float)) for b, x in bases.items()} | {v: found[v] for v in new_views}
    named = {b: list(features[b]) for b in bases} | {v: [c.removeprefix(f"_{v}_") for c in kept[v]] for v in new_views}
    return out, {"bases": everything, "features": named, "added": added, "scored": scored, "k": k, "k_by_view": counts, "blocks": {b: list(c) for b, c in kept.items()}, "fit": f}


def score_table(df: DataFrame, bases: Mapping[str, np.ndarray], features: Mapping[str, Sequence[str]], **options) -> tuple[DataFrame, list[str]]:
    return apply_bases(df, bases, features, **options)
