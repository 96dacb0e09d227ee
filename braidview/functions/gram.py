"""Consensus, energies and maps of several views from their cross-products alone.

With G[i][j] = X_i'X_j (centred views) and n, every score matrix of the linear model is U = sum_m X_m A_m for small A_m, so
U'U, X_i'U and all that follows need no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from .linalg import canonical_sign, gram_svd, rv_from_grams

ICA = ("logcosh", "exp", "gauss", "kurtosis")
ENERGIES = ("regression", "acc", *ICA, "nc", "normalized_correlation", "dat")


class Factored:
    """The matrix ``left @ right.T`` by its factors, columns by a few numbers each: cross-products of wide views, which no machine holds as a square."""

    __array_ufunc__ = None  # numpy leaves products to this class

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right = left, right

    def __len__(self) -> int:
        return len(self.left)

    def __getitem__(self, at) -> Factored:
        rows, columns = at if isinstance(at, tuple) else (at, slice(None))
        return Factored(self.left[rows], self.right[columns])

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return self.left @ (self.right.T @ x)

    def __rmatmul__(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.left) @ self.right.T


@dataclass
class Moments:
    """Centred cross-products of the views' columns side by side; ``cuts`` bounds the views."""

    gram: np.ndarray | Factored
    cuts: list[int]
    n: int

    @property
    def views(self) -> int:
        return len(self.cuts) - 1

    def block(self, i: int, j: int) -> np.ndarray:
        return self.gram[self.cuts[i] : self.cuts[i + 1], self.cuts[j] : self.cuts[j + 1]]

    def width(self, i: int) -> int:
        return self.cuts[i + 1] - self.cuts[i]

    def total(self, i: int) -> float:
        """The sum of squares of view ``i``."""
        g = self.block(i, i)
        return float((g.left * g.right).sum() if isinstance(g, Factored) else np.trace(g))

    def svd(self, i: int, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Leading singular values and right vectors of view ``i``."""
        g = self.block(i, i)
        if not isinstance(g, Factored):
            return gram_svd(g, rank)
        u, s, _ = np.linalg.svd(g.left, full_matrices=False)
        r = len(s) if rank is None else min(rank, len(s))
        return s[:r], canonical_sign(u[:, :r])

    def subset(self, views: Sequence[int]) -> Moments:
        at = np.concatenate([np.arange(self.cuts[i], self.cuts[i + 1]) for i in views])
        return Moments(self.gram[at, at] if isinstance(self.gram, Factored) else self.gram[np.ix_(at, at)], [0, *np.cumsum([self.width(i) for i in views]).tolist()], self.n)

    def scaled(self, factors: Sequence[np.ndarray]) -> Moments:
        f = np.concatenate(factors)
        if isinstance(self.gram, Factored):
            return Moments(Factored(self.gram.left * f[:, None], self.gram.right * f[:, None]), self.cuts, self.n)
        return Moments(self.gram * np.outer(f, f), self.cuts, self.n)


@dataclass
class Score:
    """A score matrix U = sum_m X_m A_m, known by its maps."""

    maps: list[np.ndarray]

    def stacked(self) -> np.ndarray:
        return np.concatenate(self.maps)

    def own(self, m: Moments) -> np.ndarray:
        a = self.stacked()
        return a.T @ m.gram @ a

    def with_view(self, m: Moments, i: int) -> np.ndarray:
        """X_i'U."""
        return m.gram[m.cuts[i] : m.cuts[i + 1]] @ self.stacked()


def only(m: Moments, i: int, v: np.ndarray) -> Score:
    """The score X_i v."""
    return Score([v if j == i else np.zeros((m.width(j), v.shape[1])) for j in range(m.views)])


def rv_of(m: Moments, a: Score, b: Score) -> float:
    x, y = a.stacked(), b.stacked()
    return rv_from_grams(x.T @ m.gram @ x, y.T @ m.gram @ y, x.T @ m.gram @ y)


def _newton_schulz(t: np.ndarray, k: np.ndarray, rounds: int = 10, tol: float = 1e-7) -> np.ndarray:
    """Newton-Schulz on rows that are only known through their Gram matrix ``k``."""
    size = lambda x: math.sqrt(max(float(np.trace(x.T @ k @ x)), 0.0))
    t = t / max(1.0, size(t))
    for _ in range(rounds):
        new = t @ (3.0 * np.eye(t.shape[1]) - t.T @ k @ t) / 2.0
        done = size(new - t) < tol
        t = new
        if done:
            break
    return t


#: Of an unmixing A: the mean over centred rows x of x tanh(x'A), and that of 1 - tanh(x'A)^2.
IcaStep = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def array_step(rows: np.ndarray) -> IcaStep:
    x = rows - rows.mean(axis=0)

    def step(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.tanh(x @ a)
        return x.T @ g / len(x), (1.0 - g**2).mean(axis=0)

    return step


def ica_turn(k: np.ndarray, n: int, rank: int, step: IcaStep, rounds: int = 2000, tol: float = 1e-2, seed: int = 42) -> np.ndarray:
    """Unmixing of ``n`` centred rows with Gram matrix ``k`` by symmetric FastICA (logcosh), as columns for the rows' own coordinates; rows are only seen through ``step``."""
    s, v = gram_svd(k, rank)
    white = v / s * math.sqrt(n)
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((rank, rank)))[0]
    for _ in range(rounds):
        xg, slope = step(white @ w)
        new = white.T @ xg - w * slope
        u, _, t = np.linalg.svd(new)
        new = u @ t
        done = np.abs(np.abs((new * w).sum(axis=0)) - 1.0).max() < tol
        w = new
        if done:
            break
    return white @ w


def ica_rotation(rows: np.ndarray, k: int) -> np.ndarray:
    """:func:`ica_turn` of rows that are held."""
    x = rows - rows.mean(axis=0)
    return ica_turn(x.T @ x, len(x), k, array_step(x))


def mix(k: np.ndarray, views: int, rank: int, mixer: str, n: int, step: IcaStep | None = None) -> np.ndarray:
    """The mixing T (views * rank by rank) of normalised projections with Gram matrix ``k``, at unit deviation."""
    if mixer in ("avg", "newton"):
        t = np.concatenate([np.eye(rank)] * views) / views
        t = _newton_schulz(t, k) if mixer == "newton" else t
    elif mixer == "ica":
        if step is None:
            raise ValueError("the ica mixer needs rows")
        t = ica_turn(k, n, rank, step)
    else:  # svd; pca is the same on centred views
        _, v = gram_svd(k)
        t = np.zeros((len(k), rank))
        t[:, : min(rank, v.shape[1])] = v[:, :rank]
    deviation = np.sqrt(np.einsum("ij,ik,kj->j", t, k, t).clip(min=0.0) / max(n - 1, 1))
    return t / (deviation + 1e-6)


def consensus(
    m: Moments, bases: Sequence[np.ndarray], mixer: str = "svd", topology: str = "star", graph: Mapping[int, Sequence[int]] | None = None,
    prune: float | None = None, weights: Sequence[float] | None = None, rows: Callable[[np.ndarray], IcaStep] | None = None,
) -> list[Score]:
    """One score for ``star``; for ``loo`` and ``graph`` one per view, from the others or from its neighbours (its own projection if there are none).

    Projections are brought to unit root mean square first; a projection that is zero counts as zero. ``prune`` leaves out views whose
    projection has a smaller cosine than that with the mean of all, unless none would be left. ``rows(B)`` gives the ica mixer a step on the rows of X B.
    """
    if topology not in ("star", "loo", "graph"):
        raise ValueError(f"unknown topology {topology}")
    if topology == "graph" and graph is None:
        raise ValueError("topology graph needs a graph")
    rank = bases[0].shape[1]
    own = [v.T @ m.block(i, i) @ v for i, v in enumerate(bases)]
    rms = [math.sqrt(max(float(np.trace(o)), 0.0) / m.n) for o in own]
    unit = [v / (r + 1e-8) * (1.0 if weights is None else float(weights[i])) if r > 0 else np.zeros_like(v) for i, (v, r) in enumerate(zip(bases, rms))]
    big = np.zeros((len(m.gram), m.views * rank))
    for i, v in enumerate(unit):
        big[m.cuts[i] : m.cuts[i + 1], i * rank : (i + 1) * rank] = v
    k = big.T @ m.gram @ big
    kept = set(range(m.views))
    if prune is not None and m.views > 1:
        mean = np.concatenate([np.eye(rank)] * m.views) / m.views
        whole = math.sqrt(max(float(np.trace(mean.T @ k @ mean)), 0.0))
        close = set()
        for i in kept:
            at = slice(i * rank, (i + 1) * rank)
            size = math.sqrt(max(float(np.trace(k[at, at])), 0.0))
            if min(whole, size) <= 1e-8 or float(np.trace(k[at] @ mean)) / (size * whole) >= prune:
                close.add(i)
        kept = close or kept

    def score_of(views: Sequence[int]) -> Score:
        at = np.concatenate([np.arange(i * rank, (i + 1) * rank) for i in views])
        t = mix(k[np.ix_(at, at)], len(views), rank, mixer, m.n, None if rows is None else rows(big[:, at]))
        a = big[:, at] @ t
        return Score([a[m.cuts[i] : m.cuts[i + 1]] for i in range(m.views)])

    if topology == "star":
        return [score_of(sorted(kept))]
    sources = [[j for j in (range(m.views) if topology == "loo" else graph.get(i, [])) if j in kept and (j != i or topology == "graph")] for i in range(m.views)]
    return [score_of(s) if s else only(m, i, unit[i]) for i, s in enumerate(sources)]


def energy(m: Moments, i: int, v: np.ndarray, u: Score, kind: str, prior: np.ndarray | None = None, weight: float = 0.0) -> float:
    """The energy of view ``i``'s basis against the score; kinds as in ENERGIES, others 0."""
    xu = u.with_view(m, i)
    if kind == "regression":
        return float(m.total(i) - 2.0 * (xu * v).sum() + (u.own(m) * (v.T @ v)).sum())
    if kind == "acc":
        return -float(np.abs(xu.T @ v).sum()) / (m.n - 1)
    if kind in ICA:
        s = xu.T @ v
        a = np.abs(s)
        value = {"logcosh": lambda: a - math.log(2.0) + np.log1p(np.exp(-2.0 * a)), "exp": lambda: -np.exp(-(s**2) / 2.0), "gauss": lambda: -0.5 * np.exp(-(s**2)), "kurtosis": lambda: s**4 / 4.0}[kind]()
        return -float(value.sum()) / m.n
    if kind in ("nc", "normalized_correlation"):
        size = math.sqrt(max(float(np.trace(u.own(m))), 0.0)) * math.sqrt(max(float(np.trace(v.T @ m.block(i, i) @ v)), 0.0))
        return -float((xu * v).sum()) / (size + 1e-10)
    if kind == "dat" and prior is not None:
        return -weight * float(((prior @ v) ** 2).sum())
    return 0.0


def downhill(m: Moments, i: int, v: np.ndarray, u: Score, kind: str, prior: np.ndarray | None = None, weight: float = 0.0) -> np.ndarray:
    """The direction of descent that belongs to :func:`energy`, on the scale that the step rules expect."""
    xu = u.with_view(m, i)
    if kind == "regression":
        return 2.0 * (xu - v)
    if kind == "acc":
        s = xu.T @ v
        # what is zero but for rounding has no sign: it would depend on the order in which rows were added up
        return xu @ np.where(np.abs(s) > 1e-8 * np.abs(s).max(initial=0.0), np.sign(s), 0.0) / (m.n - 1)
    if kind in ICA:
        s = xu.T @ v
        slope = {"logcosh": lambda: np.tanh(s), "exp": lambda: s * np.exp(-(s**2) / 2.0), "gauss": lambda: s * np.exp(-(s**2)), "kurtosis": lambda: s**3}[kind]()
        return xu @ slope / v.shape[1]
    if kind in ("nc", "normalized_correlation"):
        # the quotient's own gradient; without it the basis would only move through its projections
        gv = m.block(i, i) @ v
        size, top = math.sqrt(max(float((v * gv).sum()), 1e-20)), float((xu * v).sum())
        return (xu - top * gv / size**2) / (math.sqrt(max(float(np.trace(u.own(m))), 1e-20)) * size)
    if kind == "dat" and prior is not None:
        return 2.0 * weight * prior.T @ (prior @ v)
    return np.zeros_like(v)


def reconstruction_map(m: Moments, i: int, u: Score) -> np.ndarray:
    """W with X_i close to U W."""
    return np.linalg.pinv(u.own(m), hermitian=True) @ u.with_view(m, i).T


def reconstruction_error(m: Moments, i: int, u: Score, w: np.ndarray) -> float:
    """||X_i - U W|| / ||X_i||."""
    total = m.total(i)
    rest = total - 2.0 * float((w * u.with_view(m, i).T).sum()) + float((u.own(m) * (w @ w.T)).sum())
    return math.sqrt(max(rest, 0.0) / total) if total > 0 else 0.0
