"""Training steps with the weights of all views and layers side by side in one vector.

At batches of a few hundred rows a step of :func:`.neural.gradients` spends its time on calls, not on arithmetic. Here views of one width are stacked, with a batch's
rows along the last axis and biases as columns of the weights, so that a call serves all views, and the weights' gradients of all layers are three products.
Losses and gradients are those of :func:`.neural.gradients`, which remains for all that doesn't :func:`fit <fits>` here.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np


def fits(widths: Sequence[int], spec) -> bool:
    """Whether a model's steps can be taken here: views of one width, scores by products only, flows of even width."""
    if len(set(widths)) != 1 or spec.dynamic or spec.optimizer in ("lars", "larslow") or spec.mixer in ("svd", "pca", "ica") or spec.energy != "regression":
        return False
    if spec.flows:
        d = spec.k if spec.kind == "flow_v" else widths[0]
        return d % 2 == 0 and d >= spec.k and spec.flow_layers > 0 and 0 <= spec.scale_bound <= 60
    return spec.kind == "lend" and len(spec.hidden) > 0


def _t(x: np.ndarray) -> np.ndarray:
    return x.swapaxes(-1, -2)


def _centred(x: np.ndarray) -> np.ndarray:
    return x - np.add.reduce(x, axis=2, keepdims=True) * (1.0 / x.shape[2])


def _layers(lead: tuple[int, ...], sizes: Sequence[int]) -> list[tuple[int, ...]]:
    """Shapes of the weights ``... out in`` of a perceptron, with a column of biases."""
    return [(*lead, b, a + 1) for a, b in zip(sizes[:-1], sizes[1:])]


class Packed:
    """Losses and gradients of one model's batches, for weights in one vector."""

    def __init__(self, widths: Sequence[int], spec) -> None:
        from . import neural

        self.neural, self.spec, self.views, self.width = neural, spec, len(widths), widths[0]
        v, k, w = self.views, spec.k, self.width
        self.eye, self.off = np.eye(k), 1.0 - np.eye(k)
        self.dim = k if spec.kind == "flow_v" else w
        self.sources = np.zeros((len(neural.sources(spec, v)), v))
        for i, s in enumerate(neural.sources(spec, v)):
            np.add.at(self.sources[i], s, 1.0 / len(s))
        shapes: dict[str, tuple[int, ...]] = {"v": (v, w, k)} if spec.linear else {}
        if spec.flows:
            parts = [neural.coupling_parts(self.dim, i, spec.mask) for i in range(spec.flow_layers)]
            self.parts = [tuple(slice(int(x[0]), int(x[-1]) + 1, int(x[1] - x[0]) if len(x) > 1 else 1) for x in both) for both in parts]
            sizes = [self.dim // 2, spec.flow_hidden, spec.flow_hidden, self.dim]
            self.layers = _layers((spec.flow_layers, v), sizes)
            orders = np.array([[neural.flow_order(self.dim, i, m, spec.seed) for m in range(v)] for i in range(spec.flow_layers - 1)], dtype=int).reshape(-1, v, self.dim)
            self.turns = [((np.arange(v)[:, None], o), (np.arange(v)[:, None], o.argsort(axis=1))) for o in orders]
        else:
            sizes = [k, *spec.hidden[::-1], w]
            self.layers = _layers((v,), sizes)
            shapes |= {f"n{i}": (2, v, b, 1) for i, b in enumerate(sizes[1:-1])}
        shapes |= {f"w{i}": s for i, s in enumerate(self.layers)}
        cuts = np.cumsum([0, *[math.prod(s) for s in shapes.values()]])
        self.size, self.at = int(cuts[-1]), {name: (slice(a, b), s) for (name, s), a, b in zip(shapes.items(), cuts[:-1], cuts[1:])}
        self.room: dict[int, dict[str, np.ndarray]] = {}

    # -- weights by name, and in one vector

    def _seen(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: flat[a].reshape(s) for name, (a, s) in self.at.items()}

    def _named(self, x: Mapping[str, np.ndarray]):
        """Pairs of a weight's name and where it lies, seen as :mod:`.neural` shapes it."""
        for m in range(self.views):
            if self.spec.linear:
                yield f"v{m}", x["v"][m]
            for j in range(len(self.layers)):
                for name, own in [(f"c{m}_{i}", x[f"w{j}"][i, m]) for i in range(self.spec.flow_layers)] if self.spec.flows else [(f"d{m}", x[f"w{j}"][m])]:
                    yield f"{name}.{j}.w", own[:, :-1].T
                    yield f"{name}.{j}.b", own[:, -1:].T
                if f"n{j}" in x:
                    yield f"d{m}.{j}.g", x[f"n{j}"][0, m].T
                    yield f"d{m}.{j}.s", x[f"n{j}"][1, m].T

    def pack(self, params: Mapping[str, np.ndarray]) -> np.ndarray:
        flat = np.zeros(self.size)
        for name, place in self._named(self._seen(flat)):
            place[...] = params[name]
        return flat

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: place.copy() for name, place in self._named(self._seen(flat))}

    # -- a batch

    def gradients(self, flat: np.ndarray, rows: np.ndarray, epoch: int, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """Loss and gradient of a batch; ``rows`` have the views' columns side by side."""
        spec, n = self.spec, len(rows)
        x = np.ascontiguousarray(rows.T).reshape(self.views, self.width, n)
        p, out = self._seen(flat), np.empty(self.size)
        g, total = self._seen(out), 0.0
        h = x
        if spec.linear:
            basis, total = self._first_layers(p["v"], g["v"], epoch)
            h = _t(basis) @ x
        if spec.flows:
            room = self._room(n)
            z, logdet = self._forward(p, h, room)
            latents = z[:, : spec.k]
            total += (0.5 * np.vdot(z, z) + 0.5 * z.size * math.log(2.0 * math.pi) - logdet) * (spec.beta / n)
        else:
            latents = h
        if not np.isfinite(latents).all():
            return math.nan, out
        us, back_to_latents = self._scores(latents, n)
        if spec.flows:
            r = self._inverse(p, us, room)
            recon = basis @ r if spec.linear else r
        else:
            recon, back_to_scores = self._decode(p, g, us, rng)
        off = recon - x
        weight = (spec.gamma if spec.flows else 1.0) / (n * self.width)
        total += weight * np.vdot(off, off)
        off *= 2.0 * weight
        if spec.flows:
            if spec.linear:
                g["v"] += off @ _t(r)
                off = _t(basis) @ off
            at_us = self._inverse_back(p, off, room)[:, : spec.k]
        else:
            at_us = back_to_scores(off)
        at_us = at_us if len(us) == self.views else at_us.sum(axis=0, keepdims=True)
        value, at_latents = self._whole(latents, us, at_us, back_to_latents, epoch, n)
        if spec.flows:
            at_z = z * (spec.beta / n)
            at_z[:, : spec.k] += at_latents
            at_latents = self._forward_back(p, at_z, -spec.beta / n, room)
            self._flow_weights(g, room)
        if spec.linear:
            g["v"] += x @ _t(at_latents)
        return float(total + value), out

    def _first_layers(self, raw: np.ndarray, grad: np.ndarray, epoch: int) -> tuple[np.ndarray, float]:
        """The linear layers of this epoch, and the penalty of those that aren't orthonormal; gradients pass constraints as if these were not there."""
        alpha, weight = self.neural.alpha_at(self.spec, epoch), 0.5 if self.width <= self.spec.k else 0.05
        bound = self._projected(raw)
        both = np.stack([bound, raw])
        size = np.sqrt(np.einsum("bvwk,bvwk->bv", both, both))[:, :, None, None]
        both = np.divide(both, size, out=np.zeros_like(both), where=size >= 1e-10)  # the defects of almost nothing are zero
        among = (_t(both) @ both) * self.off
        np.sum(both @ among, axis=0, out=grad)
        grad *= 4.0 * weight
        return raw if alpha <= 0.0 else raw + alpha * (bound - raw), weight * float(np.vdot(among, among))

    def _projected(self, raw: np.ndarray) -> np.ndarray:
        """:func:`.neural.projected_basis` of all views."""
        if self.width <= self.spec.k or self.spec.quantile > 0 or self.spec.sign == "softplus" or not np.isfinite(raw).all():
            return np.stack([self.neural.projected_basis(v, self.spec) for v in raw])
        u, s, vt = np.linalg.svd(raw, full_matrices=False)
        turned = (u * (s > 1e-10 * s[:, :1])[:, None]) @ vt
        return np.maximum(turned, 0.0) if self.spec.sign in ("positive", "hard") else turned

    # -- scores

    def _scores(self, latents: np.ndarray, n: int):
        """Scores ``score component row`` of a whole batch, and what brings gradients back from them."""
        unit = 1.0 / (np.sqrt(np.einsum("vkn,vkn->v", latents, latents) / n) + 1e-8)
        blend = self.sources * unit
        u0 = (blend @ latents.reshape(self.views, -1)).reshape(-1, *latents.shape[1:])
        newton = self.spec.mixer == "newton"
        if newton:
            small = 1.0 / np.maximum(1.0, np.sqrt(np.einsum("ukn,ukn->u", u0, u0)))
            blend = blend * small[:, None]
            u0 *= small[:, None, None]
            # rounds of (3 - u'u) u / 2 multiply by a function f of the cross-product; f of a matrix (x 1, 0 y) has f(x) and the divided difference of x and y in its first row
            values, axes = np.linalg.eigh(u0 @ _t(u0))
            f, own = np.eye(2), np.zeros((*axes.shape, 2, 2))
            own[..., 0, 0], own[..., 0, 1], own[..., 1, 1] = values[:, :, None], 1.0, values[:, None, :]
            for _ in range(10):
                a = 1.5 * np.eye(2) - 0.5 * own
                f, own = f @ a, own @ (a @ a)
            slopes, f = f[..., 0, 1], f[:, :, 0, 0, 0]
            turn = (axes * f[:, None]) @ _t(axes)
            u1 = turn @ u0
        else:
            u1 = u0
        d = _centred(u1)
        freedom = max(n - 1, 1)
        size = np.sqrt(np.einsum("ukn,ukn->uk", d, d) * (1.0 / freedom) + 1e-12)[:, :, None]
        u = d / (size + 1e-6)

        def back(g: np.ndarray) -> np.ndarray:
            g = (g - d * (np.einsum("ukn,ukn->uk", g, u)[:, :, None] / (freedom * size))) / (size + 1e-6)
            g = _centred(g)
            if newton:
                m = axes @ (slopes * (_t(axes) @ (g @ _t(u0)) @ axes)) @ _t(axes)
                g = turn @ g + (m + _t(m)) @ u0
            return (blend.T @ g.reshape(len(g), -1)).reshape(latents.shape)

        return u, back

    def _whole(self, latents: np.ndarray, us: np.ndarray, at_us: np.ndarray, back, epoch: int, n: int) -> tuple[float, np.ndarray]:
        """Similarity and the penalties of latents and scores, and the gradient at the latents."""
        k, total = self.spec.k, 0.0
        d, c = (_centred(x) for x in (latents, us))
        own, theirs = (np.einsum("vkn,vkn->vk", x, x)[:, :, None] * (1.0 / n) for x in (d, c))
        at_latents = d * self._short(own, n, 1.0)
        total += float(np.maximum(1.0 - np.sqrt(own + 1e-4), 0.0).sum() / k + np.maximum(1.0 - np.sqrt(theirs + 1e-4), 0.0).sum() / (k * len(us)))
        pull = self.eye * self._short(theirs, n, 1.0 / len(us))
        if k > 1:
            among = (c @ _t(c)) * (self.off / (n - 1))
            total += float(np.vdot(among, among)) / (k * (k - 1) * len(us))
            pull = pull + among * (4.0 / (k * (k - 1) * len(us) * (n - 1)))
        at_us = at_us + pull @ c
        if epoch >= self.spec.warmup:
            size = np.sqrt(own + 1e-6)
            y = d / size
            off = y - c / np.sqrt(theirs + 1e-6)
            weight = self.spec.sim_weight / (n * k)
            total += weight * float(np.vdot(off, off))
            off *= 2.0 * weight
            off = (off - y * (np.einsum("vkn,vkn->vk", off, y)[:, :, None] / n)) / size
            at_latents += _centred(off)
        return total, at_latents + back(at_us)

    def _short(self, squares: np.ndarray, n: int, weight: float) -> np.ndarray:
        """The slope of the penalty of deviations below 1, over the deviations from the mean."""
        size = np.sqrt(squares + 1e-4)
        return np.where(size < 1.0, -weight / (self.spec.k * n * size), 0.0)

    # -- decoders

    def _decode(self, p: Mapping[str, np.ndarray], g: dict[str, np.ndarray], us: np.ndarray, rng: np.random.Generator | None):
        n, held, sizes = us.shape[2], [], [s[-2] for s in self.layers[:-1]]
        drop = self.spec.dropout if rng is not None else 0.0
        if drop:  # drawn view after view and layer after layer, rows first
            draws = rng.random(self.views * n * sum(sizes)).reshape(self.views, -1)
            cuts = np.cumsum([0, *[n * b for b in sizes]])
            kept = [_t(draws[:, a:z].reshape(self.views, n, b)) >= drop for a, z, b in zip(cuts[:-1], cuts[1:], sizes)]
        h = np.broadcast_to(us, (self.views, *us.shape[1:]))
        for i, b in enumerate(sizes):
            w = p[f"w{i}"]
            x = w[:, :, :-1] @ h + w[:, :, -1:]
            x -= np.add.reduce(x, axis=1, keepdims=True) * (1.0 / b)
            inverse = 1.0 / np.sqrt(np.einsum("vbn,vbn->vn", x, x)[:, None] * (1.0 / b) + 1e-5)
            x *= inverse
            scale, shift = p[f"n{i}"]
            out = x * scale + shift
            open_ = out > 0
            if drop:
                open_ &= kept[i]
            gain = open_ * (1.0 / (1.0 - drop))
            held.append((h, x, inverse, gain))
            h = out * gain
        last = p[f"w{len(sizes)}"]
        recon = last[:, :, :-1] @ h + last[:, :, -1:]

        def back(at: np.ndarray) -> np.ndarray:
            def weights(i: int, at: np.ndarray, h: np.ndarray) -> np.ndarray:
                own = g[f"w{i}"]
                np.matmul(at, _t(h), out=own[:, :, :-1])
                np.sum(at, axis=2, out=own[:, :, -1])
                return _t(p[f"w{i}"][:, :, :-1]) @ at

            at = weights(len(sizes), at, h)
            for i, (before, x, inverse, gain) in reversed(list(enumerate(held))):
                at *= gain
                own = g[f"n{i}"]
                own[0, :, :, 0] = np.einsum("vbn,vbn->vb", at, x)
                own[1, :, :, 0] = at.sum(axis=2)
                at *= p[f"n{i}"][0]
                at -= np.add.reduce(at, axis=1, keepdims=True) * (1.0 / sizes[i]) + x * (np.einsum("vbn,vbn->vn", at, x)[:, None] * (1.0 / sizes[i]))
                at *= inverse
                at = weights(i, at, before)
            return at

        return recon, back

    # -- flows; index 0 of ``room`` is the way forward, 1 the inverse

    def _room(self, n: int) -> dict[str, np.ndarray]:
        """What coupling layers keep for the way back, with a row of ones below what weights with biases multiply."""
        if n not in self.room:
            layers, v, h, d = self.spec.flow_layers, self.views, self.spec.flow_hidden, self.dim
            shape = lambda b: np.ones((2, layers, v, b, n))
            room = {"kept": shape(d // 2 + 1), "h1": shape(h + 1), "h2": shape(h + 1), "d1": shape(h), "d2": shape(h), "d3": shape(d)}
            self.room = {n: room | {name: shape(d // 2) for name in ("tanh", "grown", "moved")}}
        return self.room[n]

    def _couple(self, p: Mapping[str, np.ndarray], room: Mapping[str, np.ndarray], way: int, i: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scale and shift of a coupling layer."""
        below, h1, h2 = room["kept"][way, i], room["h1"][way, i], room["h2"][way, i]
        below[:, :-1] = kept
        for w, x, y in ((p["w0"][i], below, h1[:, :-1]), (p["w1"][i], h1, h2[:, :-1])):
            np.matmul(w, x, out=y)
            np.maximum(y, 0.0, out=y)
        out, half = p["w2"][i] @ h2, self.dim // 2
        return np.tanh(out[:, :half], out=room["tanh"][way, i]) * self.spec.scale_bound, out[:, half:]

    def _couple_back(self, p: Mapping[str, np.ndarray], room: Mapping[str, np.ndarray], way: int, i: int, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The gradient at what the layer keeps."""
        half, tanh = self.dim // 2, room["tanh"][way, i]
        d1, d2, d3 = (room[x][way, i] for x in ("d1", "d2", "d3"))
        slope = tanh * tanh
        np.subtract(1.0, slope, out=slope)
        slope *= self.spec.scale_bound
        np.multiply(scale, slope, out=d3[:, :half])
        d3[:, half:] = shift
        for w, above, here, h in ((p["w2"][i], d3, d2, room["h2"][way, i]), (p["w1"][i], d2, d1, room["h1"][way, i])):
            np.matmul(_t(w[:, :, :-1]), above, out=here)
            here *= h[:, :-1] > 0
        return _t(p["w0"][i][:, :, :-1]) @ d1

    def _flow_weights(self, g: dict[str, np.ndarray], room: Mapping[str, np.ndarray]) -> None:
        for j, (at, below) in enumerate((("d1", "kept"), ("d2", "h1"), ("d3", "h2"))):
            both = room[at] @ _t(room[below])
            np.add(both[0], both[1], out=g[f"w{j}"])

    def _forward(self, p: Mapping[str, np.ndarray], x: np.ndarray, room: Mapping[str, np.ndarray]) -> tuple[np.ndarray, float]:
        at, logdet = x, 0.0
        for i, (keep, change) in enumerate(self.parts):
            scale, shift = self._couple(p, room, 0, i, at[:, keep])
            logdet += float(scale.sum())
            grown, moved = np.exp(scale, out=room["grown"][0, i]), room["moved"][0, i]
            np.multiply(at[:, change], grown, out=moved)  # times its own gradient this is the scale's
            out = np.empty_like(at)
            out[:, keep] = at[:, keep]
            np.add(moved, shift, out=out[:, change])
            at = out[self.turns[i][0]] if i < len(self.turns) else out
        return at, logdet

    def _forward_back(self, p: Mapping[str, np.ndarray], g: np.ndarray, at_logdet: float, room: Mapping[str, np.ndarray]) -> np.ndarray:
        for i, (keep, change) in reversed(list(enumerate(self.parts))):
            g = g[self.turns[i][1]] if i < len(self.turns) else g.copy()
            own = g[:, change]
            kept = self._couple_back(p, room, 0, i, own * room["moved"][0, i] + at_logdet, own)
            own *= room["grown"][0, i]
            g[:, keep] += kept
        return g

    def _inverse(self, p: Mapping[str, np.ndarray], us: np.ndarray, room: Mapping[str, np.ndarray]) -> np.ndarray:
        at = np.zeros((self.views, self.dim, us.shape[2]))
        at[:, : self.spec.k] = us
        for i, (keep, change) in reversed(list(enumerate(self.parts))):
            at = at[self.turns[i][1]] if i < len(self.turns) else at
            scale, shift = self._couple(p, room, 1, i, at[:, keep])
            shrunk, moved = np.exp(-scale, out=room["grown"][1, i]), room["moved"][1, i]
            np.subtract(at[:, change], shift, out=moved)
            moved *= shrunk
            at[:, change] = moved
        return at

    def _inverse_back(self, p: Mapping[str, np.ndarray], g: np.ndarray, room: Mapping[str, np.ndarray]) -> np.ndarray:
        for i, (keep, change) in enumerate(self.parts):
            own = g[:, change]
            at_change = own * room["grown"][1, i]
            kept = self._couple_back(p, room, 1, i, -own * room["moved"][1, i], -at_change)
            own[...] = at_change
            g[:, keep] += kept
            g = g[self.turns[i][0]] if i < len(self.turns) else g
        return g
