"""A small reverse-mode differentiator over numpy arrays: enough for perceptrons, flows and the losses of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np


class Var:
    """An array that remembers how it was made."""

    __slots__ = ("back", "g", "parents", "x")
    __array_priority__ = 100

    def __init__(self, x, parents: Sequence[Var] = (), back: Callable[[np.ndarray], Sequence[np.ndarray]] | None = None) -> None:
        self.x, self.parents, self.back, self.g = np.asarray(x, dtype=float), parents, back, None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.x.shape

    def __add__(self, o):
        o = var(o)
        return Var(self.x + o.x, (self, o), lambda g: (_fit(g, self.shape), _fit(g, o.shape)))

    __radd__ = __add__

    def __neg__(self):
        return Var(-self.x, (self,), lambda g: (-g,))

    def __sub__(self, o):
        o = var(o)
        return Var(self.x - o.x, (self, o), lambda g: (_fit(g, self.shape), _fit(-g, o.shape)))

    def __rsub__(self, o):
        return var(o) + (-self)

    def __mul__(self, o):
        o = var(o)
        return Var(self.x * o.x, (self, o), lambda g: (_fit(g * o.x, self.shape), _fit(g * self.x, o.shape)))

    __rmul__ = __mul__

    def __truediv__(self, o):
        o = var(o)
        return Var(self.x / o.x, (self, o), lambda g: (_fit(g / o.x, self.shape), _fit(-g * self.x / o.x**2, o.shape)))

    def __rtruediv__(self, o):
        return var(o) / self

    def __pow__(self, p: float):
        return Var(self.x**p, (self,), lambda g: (g * p * self.x ** (p - 1),))

    def __matmul__(self, o):
        o = var(o)
        return Var(self.x @ o.x, (self, o), lambda g: (g @ o.x.T, self.x.T @ g))

    @property
    def T(self):
        return Var(self.x.T, (self,), lambda g: (g.T,))

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.x)
            np.add.at(out, at, g)
            return (out,)

        return Var(self.x[at], (self,), back)

    def sum(self, axis=None, keepdims: bool = False):
        def back(g):
            out = np.empty(self.shape)
            out[...] = g if axis is None or keepdims else np.expand_dims(g, axis)
            return (out,)

        return Var(self.x.sum(axis=axis, keepdims=keepdims), (self,), back)

    def mean(self, axis=None, keepdims: bool = False):
        n = self.x.size if axis is None else self.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / max(n, 1))

    def backward(self) -> None:
        """Gradients of this scalar for everything that it was made from."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parents]
        self.g = np.ones_like(self.x)
        for v in reversed(order):
            if v.back is not None and v.g is not None:
                for p, g in zip(v.parents, v.back(v.g)):
                    p.g = g if p.g is None else p.g + g
                v.g = None if v.parents else v.g


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Undo broadcasting."""
    if g.shape == shape:
        return g
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


def _unary(value: np.ndarray, x: Var, slope: np.ndarray) -> Var:
    return Var(value, (x,), lambda g: (g * slope,))


def exp(x):
    y = np.exp(np.clip(x.x, -60, 60))
    return _unary(y, x, y)


def log(x):
    return _unary(np.log(x.x), x, 1.0 / x.x)


def tanh(x):
    y = np.tanh(x.x)
    return _unary(y, x, 1.0 - y**2)


def relu(x):
    return _unary(x.x.clip(min=0.0), x, (x.x > 0).astype(float))


def absolute(x):
    return _unary(np.abs(x.x), x, np.sign(x.x))


def sqrt(x):
    y = np.sqrt(x.x)
    return _unary(y, x, 0.5 / np.where(y > 0, y, np.inf))


def logcosh(x):
    return _unary(np.abs(x.x) + np.log1p(np.exp(-2.0 * np.abs(x.x))) - np.log(2.0), x, np.tanh(x.x))


def softplus(x):
    return _unary(np.logaddexp(0.0, x.x), x, 1.0 / (1.0 + np.exp(-np.clip(x.x, -60, 60))))


def concat(parts: Iterable[Var], axis: int = 1) -> Var:
    parts = list(parts)
    cuts = np.cumsum([p.shape[axis] for p in parts])[:-1]
    return Var(np.concatenate([p.x for p in parts], axis=axis), parts, lambda g: np.split(g, cuts, axis=axis))


def columns(x: Var, first: int, last: int) -> Var:
    def back(g):
        out = np.zeros_like(x.x)
        out[:, first:last] = g
        return (out,)

    return Var(x.x[:, first:last], (x,), back)


def centred(x: Var) -> Var:
    """Rows less their mean."""
    mean = lambda a: a.sum(axis=0, keepdims=True) / max(len(a), 1)
    return Var(x.x - mean(x.x), (x,), lambda g: (g - mean(g),))


def column_size(x: Var, n: int, eps: float) -> Var:
    """sqrt(sum of squares / n + eps) of every column."""
    y = np.sqrt((x.x * x.x).sum(axis=0, keepdims=True) * (1.0 / n) + eps)
    return Var(y, (x,), lambda g: (x.x * (g / (n * np.where(y > 0, y, np.inf))),))


def standardised(x: Var, n: int, eps: float, least: float = 0.0) -> Var:
    """Rows less their mean, over the size of their columns (see :func:`column_size`) plus ``least``."""
    d = x.x - x.x.sum(axis=0, keepdims=True) / max(len(x.x), 1)
    size = np.sqrt((d * d).sum(axis=0, keepdims=True) * (1.0 / n) + eps)
    y = d / (size + least)

    def back(g):
        g = (g - d * ((g * y).sum(axis=0, keepdims=True) / (n * size))) / (size + least)
        return (g - g.sum(axis=0, keepdims=True) / max(len(g), 1),)

    return Var(y, (x,), back)


def newton_schulz(x: Var, rounds: int) -> Var:
    """Rounds of x (3 - x'x) / 2 as one node."""
    eye, steps, u = 3.0 * np.eye(x.shape[1]), [], x.x
    for _ in range(rounds):
        a = (eye - u.T @ u) * 0.5
        steps.append((u, a))
        u = u @ a

    def back(g):
        for own, a in reversed(steps):
            c = own.T @ g
            g = g @ a.T - own @ ((c + c.T) * 0.5)
        return (g,)

    return Var(u, (x,), back)


def fixed(x: Var) -> Var:
    """The value without its history."""
    return Var(x.x)


def straight_through(value: np.ndarray, x: Var) -> Var:
    """``value`` ahead, the identity for ``x`` back."""
    return Var(value, (x,), lambda g: (g,))


def layer_norm(x: Var, scale: Var, shift: Var, eps: float = 1e-5) -> Var:
    d = x - x.mean(axis=1, keepdims=True)
    return d / sqrt((d * d).mean(axis=1, keepdims=True) + eps) * scale + shift
