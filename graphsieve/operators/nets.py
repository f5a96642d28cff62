"""Small networks in numpy: an automatic gradient tape over arrays, sparse propagation, Adam. No framework needed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Tensor:
    """An array with a gradient; operations record how to send gradients back."""

    def __init__(self, value, parents: tuple = (), back: Callable | None = None):
        self.value = np.asarray(value, float)
        self.grad = None
        self.parents, self.back = parents, back

    def send(self, g: np.ndarray) -> None:
        # sum over what broadcasting repeated
        while g.ndim > self.value.ndim:
            g = g.sum(0)
        for axis, n in enumerate(self.value.shape):
            if n == 1 and g.shape[axis] != 1:
                g = g.sum(axis, keepdims=True)
        self.grad = g if self.grad is None else self.grad + g

    def backward(self) -> None:
        order, seen = [], set()

        def visit(t: Tensor) -> None:
            stack = [(t, iter(t.parents))]
            seen.add(id(t))
            while stack:
                node, rest = stack[-1]
                for p in rest:
                    if id(p) not in seen:
                        seen.add(id(p))
                        stack.append((p, iter(p.parents)))
                        break
                else:
                    order.append(node)
                    stack.pop()

        visit(self)
        self.grad = np.ones_like(self.value)
        for t in reversed(order):
            if t.back is not None and t.grad is not None:
                t.back(t.grad)

    def __add__(self, o):
        o = wrap(o)
        return Tensor(self.value + o.value, (self, o), lambda g: (self.send(g), o.send(g)))

    def __sub__(self, o):
        return self + wrap(o) * -1.0

    def __mul__(self, o):
        o = wrap(o)
        return Tensor(self.value * o.value, (self, o), lambda g: (self.send(g * o.value), o.send(g * self.value)))

    __radd__, __rmul__ = __add__, __mul__

    def __matmul__(self, o):
        return Tensor(self.value @ o.value, (self, o), lambda g: (self.send(g @ o.value.T), o.send(self.value.T @ g)))

    @property
    def T(self):
        return Tensor(self.value.T, (self,), lambda g: self.send(g.T))

    def sum(self, axis=None):
        return Tensor(self.value.sum(axis), (self,), lambda g: self.send(np.broadcast_to(g if axis is None else np.expand_dims(g, axis), self.value.shape)))

    def mean(self, axis=None):
        n = self.value.size if axis is None else self.value.shape[axis]
        return self.sum(axis) * (1 / max(1, n))

    def apply(self, value: np.ndarray, slope: np.ndarray):
        return Tensor(value, (self,), lambda g: self.send(g * slope))

    def relu(self):
        return self.apply(np.maximum(self.value, 0), (self.value > 0).astype(float))

    def leaky(self, a: float = 0.25):
        return self.apply(np.where(self.value > 0, self.value, a * self.value), np.where(self.value > 0, 1.0, a))

    def sigmoid(self):
        s = 1 / (1 + np.exp(-np.clip(self.value, -40, 40)))
        return self.apply(s, s * (1 - s))

    def log(self):
        v = np.maximum(self.value, 1e-12)
        return self.apply(np.log(v), 1 / v)

    def exp(self):
        e = np.exp(np.clip(self.value, -60, 60))
        return self.apply(e, e)

    def sqrt(self):
        r = np.sqrt(np.maximum(self.value, 1e-12))
        return self.apply(r, 0.5 / r)

    def rows(self, at: np.ndarray):
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            self.send(out)

        return Tensor(self.value[at], (self,), back)

    def length(self):
        """Row lengths, a column."""
        return ((self * self).sum(1) + 1e-12).sqrt().column()

    def column(self):
        return Tensor(self.value[:, None], (self,), lambda g: self.send(g[:, 0]))

    def unit(self):
        n = self.length()
        inverse = n.apply(1 / n.value, -1 / n.value**2)
        return self * inverse


def wrap(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def bce(p: Tensor, label: float) -> Tensor:
    """Mean cross entropy against one label."""
    return (p.log() * -label + (wrap(1.0) - p).log() * -(1 - label)).mean()


class Adjacency:
    """A normalised sparse matrix as edge arrays; ``spread`` multiplies a dense one."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, loops: bool = True, weight: np.ndarray | None = None, norm: str = "both"):
        if loops:
            src, dst = np.concatenate([src, np.arange(n)]), np.concatenate([dst, np.arange(n)])
        w = np.ones(len(src)) if weight is None else weight
        into = np.maximum(np.bincount(dst, w, n), 1e-12)
        if norm == "both":
            w = w / np.sqrt(into[src] * into[dst])
        elif norm == "mean":
            w = w / into[dst]
        self.n, self.src, self.dst, self.w = n, src, dst, w

    def times(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        a, b = (self.dst, self.src) if back else (self.src, self.dst)
        out = np.zeros((self.n, x.shape[1]))
        np.add.at(out, b, x[a] * self.w[:, None])
        return out

    def spread(self, x: Tensor) -> Tensor:
        return Tensor(self.times(x.value), (x,), lambda g: x.send(self.times(g, back=True)))


class Linear:
    def __init__(self, rng: np.random.Generator, n_in: int, n_out: int):
        bound = np.sqrt(6 / (n_in + n_out))
        self.w, self.b = Tensor(rng.uniform(-bound, bound, (n_in, n_out))), Tensor(np.zeros((1, n_out)))

    def __call__(self, x: Tensor) -> Tensor:
        return x @ self.w + self.b

    @property
    def parameters(self) -> list[Tensor]:
        return [self.w, self.b]


class Stack:
    """Layers with propagation (gcn, gin) or without (mlp), attention (gat) over edges, or split by community."""

    def __init__(self, rng: np.random.Generator, kind: str, sizes: list[int], adjacency: Adjacency | None, inside: Adjacency | None = None, across: Adjacency | None = None):
        if kind not in ("gcn", "gin", "mlp", "gat", "community_gcn"):
            raise ValueError(f"no encoder {kind!r}")
        self.kind, self.a, self.inside, self.across = kind, adjacency, inside, across
        factor = 3 if kind == "community_gcn" else 1
        self.layers = [Linear(rng, i * factor, o) for i, o in zip(sizes, sizes[1:], strict=False)]
        self.attend = [(Tensor(rng.normal(0, 0.1, (o, 1))), Tensor(rng.normal(0, 0.1, (o, 1)))) for o in sizes[1:]] if kind == "gat" else []

    def __call__(self, x: Tensor) -> Tensor:
        for i, layer in enumerate(self.layers):
            if self.kind == "gcn":
                x = layer(self.a.spread(x))
            elif self.kind == "gin":
                x = layer(x + self.a.spread(x))
            elif self.kind == "community_gcn":
                parts = [a.spread(x) for a in (self.a, self.inside, self.across)]
                x = layer(concat(parts))
            elif self.kind == "gat":
                x = self.attention(layer(x), *self.attend[i])
            else:
                x = layer(x)
            if i < len(self.layers) - 1:
                x = x.relu()
        return x

    def attention(self, h: Tensor, left: Tensor, right: Tensor) -> Tensor:
        a = self.a
        e = ((h @ left).rows(a.src) + (h @ right).rows(a.dst)).leaky(0.2).exp()
        total = scatter(e, a.dst, a.n)
        inverse = total.apply(1 / np.maximum(total.value, 1e-12), -1 / np.maximum(total.value, 1e-12) ** 2)
        return scatter(h.rows(a.src) * e, a.dst, a.n) * inverse

    @property
    def parameters(self) -> list[Tensor]:
        return [p for x in self.layers for p in x.parameters] + [t for pair in self.attend for t in pair]


def concat(parts: list[Tensor]) -> Tensor:
    ends = np.cumsum([p.value.shape[1] for p in parts])[:-1]
    return Tensor(np.concatenate([p.value for p in parts], 1), tuple(parts), lambda g: [p.send(s) for p, s in zip(parts, np.split(g, ends, 1), strict=True)])


def scatter(x: Tensor, at: np.ndarray, n: int) -> Tensor:
    out = np.zeros((n, x.value.shape[1]))
    np.add.at(out, at, x.value)
    return Tensor(out, (x,), lambda g: x.send(g[at]))


class Adam:
    def __init__(self, parameters: list[Tensor], rate: float, clip: float | None = None):
        self.p, self.rate, self.clip, self.step = parameters, rate, clip, 0
        self.m, self.v = [np.zeros_like(p.value) for p in parameters], [np.zeros_like(p.value) for p in parameters]

    def update(self) -> None:
        self.step += 1
        grads = [np.zeros_like(p.value) if p.grad is None else p.grad for p in self.p]
        if self.clip:
            size = np.sqrt(sum((g**2).sum() for g in grads))
            grads = [g * min(1.0, self.clip / max(size, 1e-12)) for g in grads]
        for i, (p, g) in enumerate(zip(self.p, grads, strict=True)):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            p.value = p.value - self.rate * (self.m[i] / (1 - 0.9**self.step)) / (np.sqrt(self.v[i] / (1 - 0.999**self.step)) + 1e-8)
            p.grad = None
