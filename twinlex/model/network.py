"""An encoder-decoder network in numpy: values with their gradients, attention, layers, and the whole model.

Layers normalize before they act; one matrix embeds both sides and gives the logits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from twinlex.plans.config import ModelConfig

PAD = 0


@dataclass(eq=False)
class Value:
    """An array, what it was made of, and how a gradient goes back from it."""

    data: np.ndarray
    ins: tuple[Value, ...] = ()
    back: Callable[[np.ndarray], tuple[np.ndarray | None, ...]] | None = None
    grad: np.ndarray | None = field(default=None, repr=False)

    def backward(self, gradient: np.ndarray) -> None:
        """Adds the gradient of everything this was made of, latest first."""
        order: list[Value] = []
        seen: set[int] = set()
        stack = [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack.extend((i, False) for i in v.ins)
        self.grad = gradient
        for v in reversed(order):
            if v.back is None or v.grad is None:
                continue
            for i, g in zip(v.ins, v.back(v.grad), strict=True):
                if g is not None:
                    g = _summed_to(g, i.data.shape)
                    i.grad = g if i.grad is None else i.grad + g


def _summed_to(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient of a broadcast array, of the array itself."""
    extra = g.ndim - len(shape)
    g = g.sum(axis=tuple(range(extra))) if extra else g
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(axis=wide, keepdims=True) if wide else g


def add(a: Value, b: Value) -> Value:
    return Value(a.data + b.data, (a, b), lambda g: (g, g))


def linear(x: Value, w: Value, b: Value) -> Value:
    def back(g: np.ndarray):
        flat, into = g.reshape(-1, g.shape[-1]), x.data.reshape(-1, x.data.shape[-1])
        return g @ w.data.T, into.T @ flat, flat.sum(axis=0)

    return Value(x.data @ w.data + b.data, (x, w, b), back)


def activated(x: Value, kind: str) -> Value:
    if kind == "relu":
        return Value(np.maximum(x.data, 0), (x,), lambda g: (g * (x.data > 0),))
    from math import erf

    cdf = 0.5 * (1 + np.vectorize(erf, otypes=[x.data.dtype])(x.data / math.sqrt(2)))
    return Value(x.data * cdf, (x,), lambda g: (g * (cdf + x.data * np.exp(-x.data**2 / 2) / math.sqrt(2 * math.pi)),))


def normalized(x: Value, scale: Value, shift: Value, least: float = 1e-5) -> Value:
    mean = x.data.mean(axis=-1, keepdims=True)
    rate = 1 / np.sqrt(x.data.var(axis=-1, keepdims=True) + least)
    plain = (x.data - mean) * rate

    def back(g: np.ndarray):
        d = g * scale.data
        return rate * (d - d.mean(axis=-1, keepdims=True) - plain * (d * plain).mean(axis=-1, keepdims=True)), (g * plain).reshape(-1, g.shape[-1]).sum(axis=0), g.reshape(-1, g.shape[-1]).sum(axis=0)

    return Value(plain * scale.data + shift.data, (x, scale, shift), back)


def attended(q: Value, k: Value, v: Value, allowed: np.ndarray, heads: int) -> Value:
    """softmax(q k' / root of width) v for each head; allowed [batch, 1, to, from] tells what may be looked at."""
    n, t, d = q.data.shape
    split = lambda x: x.reshape(n, -1, heads, d // heads).transpose(0, 2, 1, 3)
    merge = lambda x: x.transpose(0, 2, 1, 3).reshape(n, -1, d)
    qs, ks, vs, root = split(q.data), split(k.data), split(v.data), 1 / math.sqrt(d // heads)
    p = softmax(np.where(allowed, qs @ ks.transpose(0, 1, 3, 2) * root, np.float32(-1e9)))

    def back(g: np.ndarray):
        g = split(g)
        d_p = g @ vs.transpose(0, 1, 3, 2)
        d_z = p * (d_p - (d_p * p).sum(axis=-1, keepdims=True)) * root
        return merge(d_z @ ks), merge(d_z.transpose(0, 1, 3, 2) @ qs), merge(p.transpose(0, 1, 3, 2) @ g)

    return Value(merge(p @ vs), (q, k, v), back)


def looked_up(table: Value, ids: np.ndarray, factor: float) -> Value:
    def back(g: np.ndarray):
        out = np.zeros_like(table.data)
        np.add.at(out, ids.ravel(), (g * factor).reshape(-1, g.shape[-1]))
        return (out,)

    return Value(table.data[ids] * factor, (table,), back)


def dropped(x: Value, rate: float, rng: np.random.Generator | None) -> Value:
    if rng is None or not rate:
        return x
    keep = (rng.random(x.data.shape) >= rate).astype(x.data.dtype) / (1 - rate)
    return Value(x.data * keep, (x,), lambda g: (g * keep,))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def positions(length: int, width: int) -> np.ndarray:
    at, i = np.arange(length)[:, None], np.arange(width)[None, :]
    angle = at * np.exp(-(i // 2 * 2) * math.log(10_000) / width)
    return np.where(i % 2 == 0, np.sin(angle), np.cos(angle)).astype(np.float32)


class Network:
    """Weights by name, and what they compute."""

    def __init__(self, cfg: ModelConfig, vocabulary: int, weights: dict[str, np.ndarray] | None = None, seed: int = 0) -> None:
        self.cfg, self.size = cfg, vocabulary
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = {n: _first(n, shape, rng) for n, shape in shapes(cfg, vocabulary).items()}
        if lacking := shapes(cfg, vocabulary).keys() - weights.keys():
            raise ValueError(f"weights lack {sorted(lacking)}")
        self.weights = {n: Value(np.asarray(w, np.float32)) for n, w in weights.items()}

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: w.data for n, w in self.weights.items()}

    def count(self) -> int:
        return sum(w.data.size for w in self.weights.values())

    def _linear(self, x: Value, name: str) -> Value:
        return linear(x, self.weights[f"{name}.w"], self.weights[f"{name}.b"])

    def _norm(self, x: Value, name: str) -> Value:
        return normalized(x, self.weights[f"{name}.scale"], self.weights[f"{name}.shift"])

    def _attention(self, x: Value, memory: Value, name: str, allowed: np.ndarray) -> Value:
        q, k, v = (self._linear(of, f"{name}.{part}") for part, of in (("q", x), ("k", memory), ("v", memory)))
        return self._linear(attended(q, k, v, allowed, self.cfg.n_heads), f"{name}.o")

    def _feed(self, x: Value, name: str, rng) -> Value:
        return self._linear(dropped(activated(self._linear(x, f"{name}.in"), self.cfg.activation), self.cfg.dropout, rng), f"{name}.out")

    def _embedded(self, ids: np.ndarray, rng) -> Value:
        x = looked_up(self.weights["embedding"], ids, math.sqrt(self.cfg.d_model))
        return dropped(add(x, Value(positions(ids.shape[1], self.cfg.d_model))), self.cfg.dropout, rng)

    def encode(self, src: np.ndarray, rng=None) -> Value:
        """Memory of padded sources [batch, length]."""
        allowed, x = (src != PAD)[:, None, None, :], self._embedded(src, rng)
        for i in range(self.cfg.n_encoder_layers):
            inner = self._norm(x, f"encoder.{i}.norm0")
            x = add(x, dropped(self._attention(inner, inner, f"encoder.{i}.self", allowed), self.cfg.dropout, rng))
            x = add(x, dropped(self._feed(self._norm(x, f"encoder.{i}.norm1"), f"encoder.{i}.feed", rng), self.cfg.dropout, rng))
        return self._norm(x, "encoder.norm")

    def decode(self, tgt: np.ndarray, memory: Value, src: np.ndarray, rng=None) -> Value:
        """Hidden states of padded targets; none sees what comes later."""
        length = tgt.shape[1]
        own = np.tril(np.ones((length, length), bool))[None, None] & (tgt != PAD)[:, None, None, :]
        across, x = (src != PAD)[:, None, None, :], self._embedded(tgt, rng)
        for i in range(self.cfg.n_decoder_layers):
            inner = self._norm(x, f"decoder.{i}.norm0")
            x = add(x, dropped(self._attention(inner, inner, f"decoder.{i}.self", own), self.cfg.dropout, rng))
            x = add(x, dropped(self._attention(self._norm(x, f"decoder.{i}.norm1"), memory, f"decoder.{i}.cross", across), self.cfg.dropout, rng))
            x = add(x, dropped(self._feed(self._norm(x, f"decoder.{i}.norm2"), f"decoder.{i}.feed", rng), self.cfg.dropout, rng))
        return self._norm(x, "decoder.norm")

    def logits(self, hidden: Value) -> Value:
        table = self.weights["embedding"]

        def back(g: np.ndarray):
            flat = g.reshape(-1, g.shape[-1])
            return g @ table.data, flat.T @ hidden.data.reshape(-1, hidden.data.shape[-1])

        return Value(hidden.data @ table.data.T, (hidden, table), back)

    def __call__(self, src: np.ndarray, tgt: np.ndarray, rng=None) -> Value:
        return self.logits(self.decode(tgt, self.encode(src, rng), src, rng))

    def greedy(self, src: np.ndarray, first: int, end: int, most: int) -> np.ndarray:
        """The likeliest token again and again, for all rows at once; PAD behind an end."""
        memory, out = self.encode(src), np.full((len(src), 1), first, np.int64)
        done = np.zeros(len(src), bool)
        for _ in range(most):
            best = self.logits(Value(self.decode(out, memory, src).data[:, -1])).data.argmax(axis=-1)
            best = np.where(done, PAD, best)
            out = np.concatenate([out, best[:, None]], axis=1)
            done |= best == end
            if done.all():
                break
        return out[:, 1:]


def shapes(cfg: ModelConfig, vocabulary: int) -> dict[str, tuple[int, ...]]:
    """Every weight's name and shape."""
    d, out = cfg.d_model, {"embedding": (vocabulary, cfg.d_model)}

    def put(name: str, rows: int, columns: int) -> None:
        out.update({f"{name}.w": (rows, columns), f"{name}.b": (columns,)})

    def norm(name: str) -> None:
        out.update({f"{name}.scale": (d,), f"{name}.shift": (d,)})

    for side, layers, attentions in (("encoder", cfg.n_encoder_layers, ("self",)), ("decoder", cfg.n_decoder_layers, ("self", "cross"))):
        for i in range(layers):
            for a in attentions:
                for part in "qkvo":
                    put(f"{side}.{i}.{a}.{part}", d, d)
            put(f"{side}.{i}.feed.in", d, cfg.d_ff)
            put(f"{side}.{i}.feed.out", cfg.d_ff, d)
            for n in range(len(attentions) + 1):
                norm(f"{side}.{i}.norm{n}")
        norm(f"{side}.norm")
    return out


def _first(name: str, shape: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    if name == "embedding":
        return rng.normal(0, shape[1] ** -0.5, shape)
    if name.endswith(".w"):
        bound = math.sqrt(6 / sum(shape))
        return rng.uniform(-bound, bound, shape)
    return np.ones(shape) if name.endswith(".scale") else np.zeros(shape)


def smoothed_loss(logits: Value, target: np.ndarray, smoothing: float) -> tuple[float, float, int, np.ndarray]:
    """Sums of the smoothed loss and of the negative log-likelihood over what isn't padding, how much that is, and the loss's gradient by the logits."""
    z = logits.data.astype(np.float64)
    log_p = z - z.max(axis=-1, keepdims=True)
    log_p -= np.log(np.exp(log_p).sum(axis=-1, keepdims=True))
    on = (target != PAD).astype(np.float64)
    nll = -np.take_along_axis(log_p, target[..., None], axis=-1)[..., 0]
    loss = (1 - smoothing) * nll - smoothing * log_p.mean(axis=-1)
    g = np.exp(log_p) - smoothing / z.shape[-1]
    np.put_along_axis(g, target[..., None], np.take_along_axis(g, target[..., None], axis=-1) - (1 - smoothing), axis=-1)
    return float((loss * on).sum()), float((nll * on).sum()), int(on.sum()), (g * on[..., None]).astype(np.float32)


def padded(rows: list[list[int]]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=1) or 1), PAD, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out
