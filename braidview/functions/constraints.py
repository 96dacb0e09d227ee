"""Sparsity, sign and orthogonality of basis matrices (features by components) at the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .linalg import newton_schulz, polar


@dataclass(frozen=True)
class Constraint:
    kind: str
    weight: float
    iterations: int


def parse_constraint(text: str) -> Constraint:
    """"<kind>x<weight>x<iterations>"; parts that are missing or no numbers keep their defaults."""
    kind, *rest = (p.strip() for p in text.split("x"))
    weight, iterations = (1.0 if kind in ("Stiefel", "Grassmann") else 0.0), 1
    try:
        weight = float(rest[0])
    except (IndexError, ValueError):
        pass
    try:
        iterations = int(rest[1])
    except (IndexError, ValueError):
        pass
    return Constraint(kind, weight, iterations)


def tangent(gradient: np.ndarray, v: np.ndarray, kind: str) -> np.ndarray:
    """The gradient's part along the Grassmann or Stiefel manifold at ``v``."""
    inner = v.T @ gradient
    if kind == "Grassmann":
        return gradient - v @ inner
    if kind == "Stiefel":
        return gradient - v @ (inner + inner.T) / 2.0
    return gradient


def clamp(v: np.ndarray, sign: str) -> np.ndarray:
    return v.clip(min=0.0) if sign == "positive" else v.clip(max=0.0) if sign == "negative" else v


def threshold_columns(v: np.ndarray, quantile: float | Sequence[float], sign: str = "either", soft: bool = True, unit: bool = False) -> np.ndarray:
    """Per column: sign clamp, then shrink by (or cut below) the given quantile of sizes, then perhaps unit norm. With a single quantile of 0 nothing happens."""
    per_column = np.ndim(quantile) > 0
    if not per_column and quantile <= 0:
        return v
    v = clamp(np.array(v, dtype=float), sign)
    for j in range(v.shape[1]):
        q = quantile[j] if per_column else quantile
        if q > 0:
            size = np.abs(v[:, j])
            cut = np.quantile(size, q)
            v[:, j] = np.sign(v[:, j]) * (size - cut).clip(min=0.0) if soft else np.where(size < cut, 0.0, v[:, j])
        n = np.linalg.norm(v[:, j])
        if unit and n > 0:
            v[:, j] /= n
    return v


def orthogonal_sparse(v, quantile: float | Sequence[float] = 0.0, sign: str = "either", orthogonalise: bool = True, unit: bool = True, soft: bool = False, by_rank: str | None = None) -> np.ndarray:
    """Nearest orthonormal columns, then :func:`threshold_columns`; ``by_rank`` ("orthorank" or "basic") uses rank segmentation instead."""
    v = np.asarray(v, dtype=float)
    if by_rank:
        return segment_by_rank(v, quantile, basic=by_rank == "basic", sign=sign, by_column=True)
    if not v.any():
        return v.copy()
    if orthogonalise and v.shape[1] > 1:
        v = polar(v)
    return threshold_columns(v, quantile, sign, soft, unit)


def indicator(m, preprocess: bool = True) -> np.ndarray:
    """A row for each column in turn, the free one with the largest value, as 0/1; rows that are mostly negative may be turned first."""
    m = np.array(m, dtype=float)
    if preprocess:
        m[(m < 0).sum(axis=1) > (m > 0).sum(axis=1)] *= -1.0
    out, free = np.zeros_like(m), np.ones(len(m), dtype=bool)
    for j in range(min(m.shape)):
        row = int(np.where(free, m[:, j], -np.inf).argmax())
        out[row, j], free[row] = 1.0, False
    return out


def masked_by_indicator(m) -> np.ndarray:
    """The entries of ``m`` at the indicator of m or of -m, whichever holds more in size."""
    m = np.asarray(m, dtype=float)
    options = [m * indicator(s * m) for s in (1.0, -1.0)]
    return max(options, key=lambda x: np.abs(x).sum())


def segment_by_rank(v, quantile: float, basic: bool = False, sign: str = "positive", by_column: bool = False) -> np.ndarray:
    """Keep the largest entries of each row (or column); with a sign, only those of the side that holds more."""
    v = np.asarray(v, dtype=float)
    if not basic:
        return masked_by_indicator(v)
    rows = v.T if by_column else v
    keep = int(round(rows.shape[1] * (1.0 - quantile)))
    out = np.zeros_like(rows)
    for k, row in enumerate(rows):
        if sign != "either":
            row = row.clip(min=0.0) if row.clip(min=0.0).sum() >= -row.clip(max=0.0).sum() else row.clip(max=0.0)
        best = np.argsort(-np.abs(row), kind="stable")[:keep]
        out[k, best] = row[best]
    return out.T if by_column else out


def orthonormal_nonnegative(v, rounds: int = 100, tol: float = 1e-4, sign: str = "positive") -> np.ndarray:
    """Orthonormality and sign in turn until little changes."""
    v = np.asarray(v, dtype=float)
    for _ in range(rounds):
        new = clamp(polar(v), sign)
        if np.linalg.norm(new - v) < tol:
            return new
        v = new
    return v


def partly_orthonormal(v, rounds: int = 10, sign: str = "positive", strength: float = 1.0) -> np.ndarray:
    """A step of the given strength towards orthonormal columns, then the sign; ``rounds`` times."""
    v = np.asarray(v, dtype=float)
    for _ in range(rounds):
        v = clamp((1.0 - strength) * v + strength * polar(v), sign)
    return v


def constrain(
    v, constraint: Constraint, quantile: float | Sequence[float] = 0.0, sign: str = "either", smoother: np.ndarray | None = None, view: int | None = None, algorithm: str = "soft",
) -> np.ndarray:
    """Sign (by absolute value), smoothing, the constraint's projection, then soft thresholds. A list of quantiles is by view if ``view`` is given."""
    v = np.nan_to_num(np.asarray(v, dtype=float), nan=0.0)
    if sign in ("positive", "negative"):
        v = np.abs(v) * (1.0 if sign == "positive" else -1.0)
    if smoother is not None:
        v = smoother @ v
    if np.ndim(quantile) > 0 and view is not None:
        quantile = quantile[view]
    family = constraint.kind.removesuffix("_ns").removesuffix("_polar")
    if family in ("Stiefel", "Grassmann"):
        v = orthonormal_nonnegative(v, sign=sign) if algorithm == "nnorth" else polar(v)
    elif family == "NewtonSchulz":
        v = newton_schulz(v, max(10, constraint.iterations))
    elif family in ("ortho", "nsaflow") and constraint.weight > 0:
        v = partly_orthonormal(v, constraint.iterations, sign, constraint.weight)
    elif family not in ("ortho", "nsaflow", "none"):
        return v
    return threshold_columns(v, quantile, sign) if algorithm == "soft" else v
