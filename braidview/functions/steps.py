"""Step rules for basis matrices. Gradients point downhill: a plain step adds them. State is kept by view."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .linalg import polar

Energy = Callable[[np.ndarray], float]


def backtrack(v: np.ndarray, direction: np.ndarray, slope: float, energy: Energy, start: float = 1.0, alpha: float = 1e-4, shrink: float = 0.5, tries: int = 10, least: float = 1e-12) -> float:
    """The first step, halving, that lowers the energy by alpha times step times slope (Armijo); 0 if none does."""
    here, step = energy(v), start
    for _ in range(tries):
        if step <= least:
            break
        e = energy(v + step * direction)
        if np.isfinite(e) and e <= here + alpha * step * slope:
            return step
        step *= shrink
    return 0.0


def backtrack_both(v: np.ndarray, direction: np.ndarray, slope: float, energy: Energy, start: float = 1.0) -> tuple[float, np.ndarray]:
    """Backtracking along a direction and its opposite; the larger accepted step wins."""
    ahead, back = backtrack(v, direction, slope, energy, start), backtrack(v, -direction, -slope, energy, start)
    return (ahead, direction) if ahead >= back else (back, -direction)


class Step:
    """A rule: ``rule(view, v, gradient, energy)`` is the next basis."""

    defaults: dict[str, float] = {"learning_rate": 0.01, "beta1": 0.9, "beta2": 0.999, "epsilon": 1e-8}

    def __init__(self, **options) -> None:
        self.p = {**Step.defaults, **type(self).defaults, **options}
        self.state: dict[int, dict[str, object]] = {}

    def __call__(self, view: int, v: np.ndarray, gradient: np.ndarray, energy: Energy | None = None) -> np.ndarray:
        s = self.state.setdefault(view, {"t": 0, "m": np.zeros_like(v), "s": np.zeros_like(v), "top": np.zeros_like(v), "step": 1.0, "slow": v.copy()})
        s["t"] += 1
        return self.move(s, v, gradient, energy)

    def move(self, s: dict, v: np.ndarray, g: np.ndarray, energy: Energy | None) -> np.ndarray:
        return v + self.p["learning_rate"] * g


class GradientStep(Step):
    pass


class Moments(Step):
    """Adam and its kin. ``kind``: adam, nadam, adamw, amsgrad with line search (hybrid)."""

    kind = "adam"

    def move(self, s, v, g, energy):
        p = self.p
        s["m"] = p["beta1"] * s["m"] + (1 - p["beta1"]) * g
        s["s"] = p["beta2"] * s["s"] + (1 - p["beta2"]) * g**2
        if self.kind == "hybrid":
            s["top"] = np.maximum(s["top"], s["s"])
            direction = s["m"] / (np.sqrt(s["top"]) + p["epsilon"])
            step = p["learning_rate"] if energy is None else backtrack(v, direction, -float((g * direction).sum()), energy, s["step"])
            s["step"] = 1.5 * step if step > 1e-9 else 1.0
            return v + step * direction
        m, q = s["m"] / (1 - p["beta1"] ** s["t"]), s["s"] / (1 - p["beta2"] ** s["t"])
        if self.kind == "nadam":
            m = p["beta1"] * m + (1 - p["beta1"]) * g / (1 - p["beta1"] ** s["t"])
        decay = p.get("weight_decay", 0.01) if self.kind == "adamw" else 0.0
        return v * (1 - p["learning_rate"] * decay) + p["learning_rate"] * m / (np.sqrt(q) + p["epsilon"])


class Hybrid(Moments):
    kind = "hybrid"


class Nadam(Moments):
    kind = "nadam"


class AdamW(Moments):
    kind = "adamw"


class RmsProp(Step):
    def move(self, s, v, g, energy):
        beta = self.p.get("beta", 0.9)
        s["s"] = beta * s["s"] + (1 - beta) * g**2
        return v + self.p["learning_rate"] * g / (np.sqrt(s["s"]) + self.p["epsilon"])


class Adagrad(Step):
    def move(self, s, v, g, energy):
        s["s"] = s["s"] + g**2
        return v + self.p["learning_rate"] * g / (np.sqrt(s["s"]) + 1e-10)


class Armijo(Step):
    """Line search along the gradient with some momentum; it goes downhill, on one side or on both."""

    defaults = {"learning_rate": 0.1}
    both = False

    def move(self, s, v, g, energy):
        s["m"] = 0.9 * s["m"] + 0.1 * g
        direction = g + 0.1 * s["m"]
        if energy is None:
            return v + self.p["learning_rate"] * direction
        slope, start = -float((g * direction).sum()), self.p["learning_rate"]
        if self.both:
            step, direction = backtrack_both(v, direction, slope, energy, start)
        else:
            step = backtrack(v, direction, slope, energy, start)
        return v + step * direction


class ArmijoBoth(Armijo):
    both = True


class Lookahead(Step):
    """Fast steps of an inner rule; every ``k`` of them the slow weights follow by ``alpha`` and take over."""

    inner: type[Step] = Hybrid

    def __init__(self, **options) -> None:
        super().__init__(**{"k": 5, "alpha": 0.5, **options})
        self.fast = self.inner(**options)

    def __call__(self, view, v, gradient, energy=None):
        s = self.state.setdefault(view, {"t": 0, "slow": v.copy()})
        s["t"] += 1
        v = self.fast(view, v, gradient, energy)
        if s["t"] % self.p["k"] == 0:
            v = s["slow"] = s["slow"] + self.p["alpha"] * (v - s["slow"])
        return v


class LookaheadBoth(Lookahead):
    inner = ArmijoBoth


class Lars(Step):
    """Steps in proportion to the basis' own size."""

    def move(self, s, v, g, energy):
        decay, size = self.p.get("decay_rate", 1e-3), np.linalg.norm(v)
        trust = size / (np.linalg.norm(g) + decay * size + 1e-10)
        return v + self.p["learning_rate"] * trust * (g - decay * v)


class Retraction(Step):
    """A gradient step back onto orthonormal columns, by ``retract``."""

    def move(self, s, v, g, energy):
        return self.p.get("retract", polar)(v + self.p["learning_rate"] * g)


class LimitedMemory(Step):
    """L-BFGS direction from the last pairs of steps and gradients."""

    def move(self, s, v, g, energy):
        pairs = s.setdefault("pairs", [])
        if "last" in s:
            dv, dg = v - s["last"][0], s["last"][1] - g
            if float((dv * dg).sum()) > 1e-10:
                pairs.append((dv, dg))
                del pairs[:-10]
        s["last"] = (v.copy(), g.copy())
        q, past = g.copy(), []
        for dv, dg in reversed(pairs):
            a = float((dv * q).sum() / (dv * dg).sum())
            q = q - a * dg
            past.append(a)
        if pairs:
            q = q * float((pairs[-1][0] * pairs[-1][1]).sum() / (pairs[-1][1] ** 2).sum())
        for (dv, dg), a in zip(pairs, reversed(past)):
            q = q + dv * (a - float((dg * q).sum() / (dv * dg).sum()))
        rate = self.p["learning_rate"] if energy is None else backtrack(v, q, -float((g * q).sum()), energy)
        return v + rate * q


class Momentum(Step):
    """Gradient steps on a decaying sum of gradients."""

    def direction(self, s: dict, g: np.ndarray) -> np.ndarray:
        return g

    def move(self, s, v, g, energy):
        beta = self.p.get("momentum", 0.9)
        s["m"] = beta * s["m"] + (1 - beta) * self.direction(s, g)
        return v + self.p["learning_rate"] * s["m"]


class Noisy(Momentum):
    """Momentum on gradients with normal noise of deviation ``sigma`` (variational gradient descent)."""

    def direction(self, s, g):
        return g + self.p.get("sigma", 0.1) * s.setdefault("rng", np.random.default_rng(self.p.get("seed", 0))).standard_normal(g.shape)


class Preconditioned(Momentum):
    """Momentum on gradients divided by a running mean of their squares, which starts at 1 (a diagonal stand-in for the Hessian)."""

    def direction(self, s, g):
        s["scale"] = 0.99 * s.get("scale", 1.0) + 0.01 * g**2
        return g / (s["scale"] + self.p["epsilon"])


class Random(Step):
    """The best of some random moves, if any is better than staying; ``along`` the gradient, or from the basis itself. Without an energy the first move is taken."""

    along = 0.0

    def move(self, s, v, g, energy):
        rng = s.setdefault("rng", np.random.default_rng(self.p.get("seed", 0)))
        noise = self.p.get("noise_scale", 0.1) * rng.standard_normal((int(self.p.get("n_trials", 16)), *v.shape))
        moves = v + self.p["learning_rate"] * (self.along * g + noise)
        if energy is None:
            return moves[0]
        return min([v, *moves], key=lambda x: float(np.nan_to_num(energy(x), nan=np.inf)))


class RandomAlong(Random):
    along = 1.0


class AmsGrad(Step):
    """Adam whose second moment never falls."""

    def move(self, s, v, g, energy):
        b1, b2 = self.p["beta1"], self.p["beta2"]
        s["m"], s["s"] = b1 * s["m"] + (1 - b1) * g, b2 * s["s"] + (1 - b2) * g**2
        s["top"] = np.maximum(s["top"], s["s"])
        return v + self.p["learning_rate"] * s["m"] / (np.sqrt(s["top"]) + self.p["epsilon"])


class AdaDelta(Step):
    """Steps in the unit of the basis: the root of past squared steps over that of past squared gradients."""

    def move(self, s, v, g, energy):
        rho, least = self.p.get("rho", 0.95), self.p.get("least", 1e-6)
        s["s"] = rho * s["s"] + (1 - rho) * g**2
        step = np.sqrt((s["m"] + least) / (s["s"] + least)) * g
        s["m"] = rho * s["m"] + (1 - rho) * step**2
        return v + step


class Rectified(Step):
    """Adam with the variance of its early rates rectified; plain momentum while that variance is unknown."""

    def move(self, s, v, g, energy):
        b1, b2, t = self.p["beta1"], self.p["beta2"], s["t"]
        s["m"], s["s"] = b1 * s["m"] + (1 - b1) * g, b2 * s["s"] + (1 - b2) * g**2
        mean, most = s["m"] / (1 - b1**t), 2 / (1 - b2) - 1
        length = most - 2 * t * b2**t / (1 - b2**t)
        if length <= 5:
            return v + self.p["learning_rate"] * mean
        r = np.sqrt((length - 4) * (length - 2) * most / ((most - 4) * (most - 2) * length))
        return v + self.p["learning_rate"] * r * mean / (np.sqrt(s["s"] / (1 - b2**t)) + self.p["epsilon"])


class Ranger(Lookahead):
    inner = Rectified


class OnManifold(Moments):
    """Adam's step without what leaves the tangent space of orthonormal columns, and back onto them."""

    def move(self, s, v, g, energy):
        step = super().move(s, v, g, energy) - v
        turn = v.T @ step
        return polar(v + step - v @ (turn + turn.T) / 2)


class Searched(Step):
    """The direction of an inner rule, as far as a line search allows; without an energy the inner rule's own step."""

    inner: type[Step] = Moments

    def __init__(self, **options) -> None:
        super().__init__(**options)
        self.own = self.inner(**options)

    def move(self, s, v, g, energy):
        ahead = self.own.move(s, v, g, energy)
        if energy is None:
            return ahead
        direction = (ahead - v) / self.p["learning_rate"]
        slope = -float((g * direction).sum())
        if slope >= 0:  # the inner rule's memory points uphill
            direction, slope = g, -float((g * g).sum())
        return v + backtrack(v, direction, slope, energy) * direction


class SearchedRmsProp(Searched):
    inner = RmsProp


class SearchedNadam(Searched):
    inner = Nadam


RULES: dict[str, type[Step]] = {
    "hybrid_adam": Hybrid, "adam": Moments, "nadam": Nadam, "rmsprop": RmsProp, "gd": GradientStep, "armijo_gradient": Armijo,
    "bidirectional_armijo_gradient": ArmijoBoth, "lookahead": Lookahead, "bidirectional_lookahead": LookaheadBoth, "nsa_flow": Retraction, "lars": Lars,
    "torch_adamw": AdamW, "torch_adagrad": Adagrad, "torch_nadam": Nadam, "torch_lbfgs": LimitedMemory, "adagrad": Adagrad, "lbfgs": LimitedMemory,
    "random_search": Random, "random_gradient": RandomAlong, "sgd_momentum": Momentum, "ls_adam": Searched, "ls_rmsprop": SearchedRmsProp, "ls_nadam": SearchedNadam,
    "amsgrad": AmsGrad, "adadelta": AdaDelta, "ranger": Ranger, "vsgd": Noisy, "riemannian_adam": OnManifold, "psgd": Preconditioned,
}


def list_steps() -> list[str]:
    """The names of all rules."""
    return sorted(RULES)


def make_step(name: str, **options) -> Step:
    """The rule of a name."""
    if name not in RULES:
        raise ValueError(f"no step rule is named {name}; there are {', '.join(list_steps())}")
    return RULES[name](**options)
