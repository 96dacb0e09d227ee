"""Dense algebra on small matrices (features by components) at the driver."""

from __future__ import annotations

import math

import numpy as np


def clean(x) -> np.ndarray:
    """Float matrix with NaN and infinities as 0; a vector becomes a column."""
    x = np.nan_to_num(np.asarray(x, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
    return x[:, None] if x.ndim == 1 else x


def canonical_sign(v: np.ndarray) -> np.ndarray:
    """Columns turned so that each one's entry of largest size is positive; of entries as large but for rounding the first one counts."""
    v = np.array(v, dtype=float)
    if v.size:
        size = np.abs(v)
        peak = v[(size >= (1.0 - 1e-9) * size.max(axis=0)).argmax(axis=0), np.arange(v.shape[1])]
        v *= np.where(peak < 0, -1.0, 1.0)
    return v


def svd(x, rank: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin SVD (u, s, v) with NaN as 0, truncated to ``rank``; failure raises."""
    u, s, vt = np.linalg.svd(clean(x), full_matrices=False)
    r = len(s) if rank is None else min(rank, len(s))
    return u[:, :r], s[:r], vt[:r].T


def gram_svd(g: np.ndarray, rank: int | None = None, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a matrix known by its Gram matrix; values below ``tol`` of the largest are 0."""
    w, v = np.linalg.eigh((g + g.T) / 2)
    w, v = w[::-1].clip(min=0.0), v[:, ::-1]
    s = np.sqrt(w)
    s[s < tol * (s[0] if len(s) else 0.0)] = 0.0
    r = len(s) if rank is None else min(rank, len(s))
    return s[:r], canonical_sign(v[:, :r])


def pca(x, components: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, loadings and singular values of the centred data; constant columns get zero loadings."""
    x = clean(x)
    x = x - x.mean(axis=0)
    live = x.std(axis=0) > 0
    loadings = np.zeros((x.shape[1], components))
    if not live.any():
        return np.zeros((len(x), components)), loadings, np.zeros(components)
    _, s, v = svd(x[:, live], components)
    loadings[np.ix_(live, range(v.shape[1]))] = canonical_sign(v)
    return x @ loadings, loadings, np.pad(s, (0, components - len(s)))


def whiten(x, components: int | None = None) -> np.ndarray:
    """Left singular vectors, each divided by its singular value (plus 1e-8)."""
    u, s, _ = svd(x, components)
    return u / (s + 1e-8)


def polar(v: np.ndarray) -> np.ndarray:
    """The nearest matrix with orthonormal columns; directions that ``v`` lacks (but for rounding) stay empty, as any filling would depend on the rounding."""
    u, s, vt = np.linalg.svd(clean(v), full_matrices=False)
    there = s > 1e-10 * s[:1].max(initial=0.0)
    return u[:, there] @ vt[there]


def newton_schulz(x: np.ndarray, iterations: int = 5, tol: float = 1e-7) -> np.ndarray:
    """Orthogonalisation by products only: y <- y (3 I - y'y) / 2, from Frobenius norm 1 at most."""
    y = np.array(x, dtype=float)
    y /= max(1.0, np.linalg.norm(y))
    for _ in range(iterations):
        z = y @ (3.0 * np.eye(y.shape[1]) - y.T @ y) / 2.0
        done = np.linalg.norm(z - y) < tol
        y = z
        if done:
            break
    return y


def unit_columns(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=0)
    return v / np.where(n > 0, n, 1.0)


def unit_rows(x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + eps)


def l1_columns(x: np.ndarray) -> np.ndarray:
    n = np.abs(x).sum(axis=0)
    return x / np.where(n > 0, n, 1.0)


def _off_diagonal(g: np.ndarray) -> np.ndarray:
    return g - np.diag(np.diag(g))


def orthogonality_defect(a) -> float:
    """Sum of squared off-diagonal entries of a'a at Frobenius norm 1; 0 for (almost) nothing."""
    a = np.asarray(a, dtype=float)
    n = np.linalg.norm(a)
    if n < 1e-10:
        return 0.0
    return float((_off_diagonal(a.T @ a / n**2) ** 2).sum())


def orthogonality_defect_gradient(a) -> np.ndarray:
    """Gradient of the defect at Frobenius norm 1, taken as if the norm were fixed."""
    a = np.asarray(a, dtype=float)
    n = np.linalg.norm(a)
    if n < 1e-10:
        return np.zeros_like(a)
    return 4.0 * (a / n) @ _off_diagonal(a.T @ a / n**2)


def stiefel_defect(a) -> float:
    a = np.asarray(a, dtype=float)
    return float(np.linalg.norm(a.T @ a - np.eye(a.shape[1])))


def mean_defect(a) -> float:
    """Mean squared cosine between different columns."""
    a = np.asarray(a, dtype=float)
    k = a.shape[1]
    if k < 2:
        return 0.0
    c = unit_columns(a)
    return float((_off_diagonal(c.T @ c) ** 2).sum() / (k * (k - 1)))


def mean_defect_gradient(a) -> np.ndarray:
    a = np.asarray(a, dtype=float)
    k = a.shape[1]
    if k < 2:
        return np.zeros_like(a)
    n = np.linalg.norm(a, axis=0)
    n = np.where(n > 0, n, 1.0)
    c = a / n
    to_c = 4.0 / (k * (k - 1)) * c @ _off_diagonal(c.T @ c)
    return (to_c - c * (c * to_c).sum(axis=0)) / n


def orthogonality_summary(a) -> dict[str, float]:
    s = np.linalg.svd(np.asarray(a, dtype=float), compute_uv=False)
    return {
        "invariant_defect": orthogonality_defect(a), "stiefel_defect": stiefel_defect(a), "mean_defect": mean_defect(a),
        "condition_number": float(s[0] / s[-1]) if s[-1] > 0 else math.inf, "effective_rank": float((s**2).sum() / s[0] ** 2) if s[0] > 0 else 0.0,
    }


def rv_from_grams(xx: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> float:
    """RV coefficient from centred cross-products; 0 if either side is 0."""
    low = math.sqrt((xx**2).sum() * (yy**2).sum())
    return float((xy**2).sum() / low) if low > 0 else 0.0


def rv(x, y) -> float:
    x, y = clean(x), clean(y)
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    return rv_from_grams(x.T @ x, y.T @ y, x.T @ y)


def adjusted_rv(x, y) -> float:
    """The plain RV coefficient, 0 for one row or none, under the name that callers know."""
    return rv(x, y) if len(x) > 1 else 0.0


def procrustes_from_grams(aa: float, bb: float, ab: np.ndarray) -> float:
    """R^2 of the best rotation and scale: (sum of singular values of a'b)^2 over the two squared norms."""
    if aa <= 0 or bb <= 0:
        return 0.0
    return float(np.linalg.svd(ab, compute_uv=False).sum() ** 2 / (aa * bb))


def procrustes_r2(true, found) -> float:
    a, b = clean(true), clean(found)
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    return procrustes_from_grams((a**2).sum(), (b**2).sum(), b.T @ a)


def procrustes_mse(true, found) -> float:
    a, b = clean(true), clean(found)
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    total = (a**2).sum()
    return float(total * (1.0 - procrustes_r2(true, found)) / a.size) if a.size else 0.0


def ridge(xx: np.ndarray, xy: np.ndarray, l2: float = 1e-6) -> np.ndarray:
    """Coefficients from centred cross-products; least squares where the system is singular."""
    try:
        return np.linalg.solve(xx + l2 * np.eye(len(xx)), xy)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(xx, xy, rcond=None)[0]


def linear_map(source, target, l2: float = 1e-6) -> dict[str, object]:
    """Ridge map with intercept, and R^2 by target and over all (denominators of 1e-8 at least)."""
    x, y = clean(source), clean(target)
    mx, my = x.mean(axis=0), y.mean(axis=0)
    xc, yc = x - mx, y - my
    b = ridge(xc.T @ xc, xc.T @ yc, l2)
    rest, total = ((yc - xc @ b) ** 2).sum(axis=0), (yc**2).sum(axis=0)
    return {
        "coefficients": b, "intercept": my - mx @ b, "r2_by_target": 1.0 - rest / np.maximum(total, 1e-8), "global_r2": float(1.0 - rest.sum() / max(total.sum(), 1e-8)),
    }


def column_correlations(a, b, eps: float = 1e-8) -> np.ndarray:
    """Correlations of the columns of two score matrices, scales of sqrt(eps) at least."""
    a, b = clean(a), clean(b)
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    scale = lambda z: np.maximum(np.sqrt((z**2).sum(axis=0)), math.sqrt(eps))
    return (a.T @ b) / np.outer(scale(a), scale(b))


def hat_prediction(x, y, rank: int | None = None) -> np.ndarray:
    """Projection of ``y`` on the leading left singular vectors of ``x``."""
    u, _, _ = svd(x, rank)
    return u @ (u.T @ clean(y))


def smooth_regression(x, y, rank: int | None = None) -> dict[str, np.ndarray]:
    """Regression of ``y`` on ``x`` through its leading singular vectors: factors of ``x``, coefficients, fit."""
    u, s, v = svd(x, rank)
    coefficients = v @ ((u.T @ clean(y)) / np.where(s > 0, s, np.inf)[:, None])
    return {"u": u, "s": s, "v": v, "coefficients": coefficients, "fitted": u @ (u.T @ clean(y))}


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for step in range(400):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / max(abs(1.0 + term * d), tiny) * (1 if 1.0 + term * d > 0 else -1)
        c = 1.0 + term / c if abs(c) > tiny else 1.0 + term / tiny
        value *= c * d
        if step and abs(c * d - 1.0) < 1e-14:
            break
    return front * (value - 1.0)


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function."""
    tail = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def f_sf(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def one_sample_t(values, mu: float, alternative: str = "two-sided") -> tuple[float, float]:
    x = np.asarray(values, dtype=float)
    t = (x.mean() - mu) / (x.std(ddof=1) / math.sqrt(len(x)))
    low = t_cdf(t, len(x) - 1)
    return float(t), {"less": low, "greater": 1.0 - low}.get(alternative, 2.0 * min(low, 1.0 - low))


def welch_of_moments(na: int, ma: float, va: float, nb: int, mb: float, vb: float) -> tuple[float, float, float]:
    """Welch's statistic, degrees of freedom and two-sided p value from counts, means and sample variances."""
    ea, eb = va / na, vb / nb
    t = (ma - mb) / math.sqrt(ea + eb)
    df = (ea + eb) ** 2 / (ea**2 / (na - 1) + eb**2 / (nb - 1))
    low = t_cdf(t, df)
    return float(t), float(df), 2.0 * min(low, 1.0 - low)


def cohens_d_of_moments(na: int, ma: float, va: float, nb: int, mb: float, vb: float) -> float:
    return float((ma - mb) / math.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)))


def _moments(x) -> tuple[int, float, float]:
    x = np.asarray(x, dtype=float)
    return len(x), float(x.mean()), float(x.var(ddof=1))


def welch_t(a, b) -> tuple[float, float, float]:
    """:func:`welch_of_moments` of two samples."""
    return welch_of_moments(*_moments(a), *_moments(b))


def cohens_d(a, b) -> float:
    return cohens_d_of_moments(*_moments(a), *_moments(b))


def anova_of_sums(full: float, less: float, df1: int, df2: int) -> dict[str, float]:
    """F test of two nested models from their residual sums of squares, with partial eta squared (the type II comparison)."""
    f = ((less - full) / df1) / (full / df2)
    return {"f": f, "df1": int(df1), "df2": int(df2), "p": f_sf(f, df1, df2), "partial_eta2": (less - full) / less}


def anova(design_full: np.ndarray, design_less: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """F test of the columns that the smaller design lacks."""
    rest = lambda d: float(((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2).sum())
    rank = np.linalg.matrix_rank(design_full)
    return anova_of_sums(rest(design_full), rest(design_less), rank - np.linalg.matrix_rank(design_less), len(y) - rank)
