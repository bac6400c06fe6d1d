"""A small causal self-attention model in numpy: training by back-propagation, and batched scoring.

Tokens are slots 0 .. CLASSES * MEMBERS - 1.  A token is predicted in two
steps, its class and then itself within the class.  Both start from a table that
the token before looks up, the logarithms of smoothed counts of neighbours; the
layers above it learn what attention to the tokens further back adds to that.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Width, hidden width, context, classes and members of a class.
WIDTH, HIDDEN, CONTEXT, CLASSES, MEMBERS = 16, 32, 32, 32, 32
HALF = CONTEXT // 2
SLOTS = CLASSES * MEMBERS
BEGIN = 0  # a text's end, and what stands before its first token
#: Embedding, query, key, weight of a distance, value, then the ways to the hidden layer of the token and of the one before, and out of it.
SHAPES = {
    "e": (SLOTS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "a": (CONTEXT,), "v": (WIDTH, HIDDEN), "u": (WIDTH, HIDDEN),
    "w": (WIDTH, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "m": (CLASSES, HIDDEN, MEMBERS),
}
SCALE = 1 / math.sqrt(WIDTH)
#: Place of a key minus that of a query, as a distance; what a query can't see.
AGO = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
LATER = AGO < 0
BACK = np.maximum(AGO, 0).ravel()


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial() -> np.ndarray:
    """Random weights, small on the way out."""
    rng = np.random.default_rng(3)
    size = {"e": 0.3, "a": 0.0, "b": 0.0, "c": 0.1 / math.sqrt(HIDDEN), "m": 0.1 / math.sqrt(HIDDEN)}
    return np.concatenate([(rng.standard_normal(int(np.prod(s))) * size.get(n, SCALE)).ravel() for n, s in SHAPES.items()]).astype(np.float32)


class Table:
    """Logarithms of the chances of classes after each token, and of members within them (tokens x CLASSES x MEMBERS), from counts of neighbours."""

    def __init__(self, pairs: np.ndarray):
        pairs = pairs.astype(np.float64)
        share = pairs.sum(axis=0) + 0.5
        smooth = (1 + (pairs >= 1).sum(axis=1, keepdims=True)) * (share / share.sum())
        total = (pairs + smooth).sum(axis=1, keepdims=True)
        chance = (pairs + smooth) / total
        kind = chance.reshape(SLOTS, CLASSES, MEMBERS).sum(axis=2)
        self.kind, self.member = np.log(kind).astype(np.float32), (np.log(chance.reshape(SLOTS, CLASSES, MEMBERS)) - np.log(kind)[:, :, None]).astype(np.float32)
        # As if a pair itself had not been counted: what training goes by.
        less = (np.maximum(pairs - 1, 0) + smooth) / total
        gone = chance - less
        rest = np.maximum(kind[:, :, None] - gone.reshape(SLOTS, CLASSES, MEMBERS), 1e-30)
        self.kind_less = np.log(rest).reshape(SLOTS, SLOTS).astype(np.float32)
        self.member_less = (np.log(less) - np.log(rest).reshape(SLOTS, SLOTS)).astype(np.float32)

    @functools.cached_property
    def less(self) -> np.ndarray:
        """What to add to the logarithms of a target's class and of the target, side by side, for each pair (last token, target)."""
        return np.stack((self.kind_less - np.repeat(self.kind, MEMBERS, axis=1), self.member_less - self.member.reshape(SLOTS, SLOTS)), axis=2).reshape(-1, 2)


def _exp(z: np.ndarray, low: float, high: float) -> np.ndarray:
    """Exponents of ``z`` in place, up to a factor of each row where they would be too large or small: what is not masked lies from ``low`` to ``high``."""
    if low < -60 or high > 60:
        z -= z.max(axis=-1, keepdims=True)
    return np.exp(z, out=z)


def gradient(p: dict[str, np.ndarray], table: Table, x: np.ndarray, y: np.ndarray, g: dict[str, np.ndarray]) -> float:
    """Mean loss over windows x -> y (both B x CONTEXT; -1: no token); its gradient is written to ``g``."""
    flat = lambda z: z.reshape(-1, z.shape[-1])
    there = x >= 0
    gap = np.flatnonzero((there[:, 1:] > there[:, :-1]).any(axis=1))  # what follows the last token concerns nothing
    there = there[gap][:, :, None].astype(p["e"].dtype)
    # Queries, keys and the ways to the hidden layer depend on one token alone: made once for each different one.
    x0 = np.maximum(x, 0)
    order = np.argsort(x0.ravel().astype(np.int16), kind="stable")
    seen = x0.ravel().take(order)
    edge = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1])))
    some = seen[edge]
    place = np.zeros(SLOTS, np.intp)
    place[some] = np.arange(len(some))
    place = place.take(x0)
    before = np.full_like(place, len(some))  # none
    before[:, 1:] = place[:, :-1]
    before[gap, 1:] = np.where(there[:, :-1, 0] > 0, before[gap, 1:], len(some))
    own = p["e"].take(some, axis=0)
    look = np.concatenate((p["q"] * SCALE, p["k"]), axis=1)
    all_ = np.concatenate((own, np.ones((len(own), 1), own.dtype), own @ look), axis=1)
    most = math.sqrt(float((all_[:, -2 * WIDTH : -WIDTH] ** 2).sum(axis=1).max(initial=0) * (all_[:, -WIDTH:] ** 2).sum(axis=1).max(initial=0)))
    all_ = all_.take(place, axis=0)
    e, e1, q, k = all_[:, :, :WIDTH], all_[:, :, : WIDTH + 1], all_[:, :, -2 * WIDTH : -WIDTH], all_[:, :, -WIDTH:]
    a = q @ k.transpose(0, 2, 1)
    a += np.where(LATER, -1e9, p["a"].take(BACK).reshape(AGO.shape)).astype(a.dtype)
    a[gap] += 1e9 * (there - 1).transpose(0, 2, 1)
    a = _exp(a, float(p["a"].min()) - most, float(p["a"].max()) + most)
    mixed = a @ e1  # not yet divided by the sums of rows, which stand last; nor are ``a``
    part = 1 / np.where(mixed[:, :, WIDTH:] > 0, mixed[:, :, WIDTH:], 1)
    mixed = mixed[:, :, :WIDTH] * part
    # Class by class from here on.
    known = np.flatnonzero(y.ravel() >= 0)
    target = y.ravel().take(known).astype(np.intp)
    sort = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")
    known, target = known.take(sort), target.take(sort)
    last, kind, n = x0.ravel().take(known).astype(np.intp), target // MEMBERS, max(1, len(target))
    cut = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    here, back = place.ravel().take(known), before.ravel().take(known)
    of, rows = flat(mixed).take(known, axis=0), np.arange(len(target))
    r = of @ p["v"]
    r += (own @ p["u"] + p["b"]).take(here, axis=0)
    own = np.concatenate((own, np.zeros((1, WIDTH), own.dtype)))
    r += (own @ p["w"]).take(back, axis=0)
    np.maximum(r, 0, out=r)
    less, loss = table.less.take(last * SLOTS + target, axis=0), 0.0

    def soft(z: np.ndarray, at: np.ndarray, less: np.ndarray) -> np.ndarray:
        """Slope of the loss, from the exponents z; at: places of the targets in them."""
        nonlocal loss
        f = z.reshape(-1)
        f[at] += less
        z = _exp(z, float(z.min(initial=0)), float(z.max(initial=0)))
        total = z @ np.ones(z.shape[1], z.dtype)
        loss -= float(np.log(np.maximum(f.take(at) / total, 1e-20)).sum())
        z *= (1 / (n * total))[:, None]
        f[at] -= 1 / n
        return z

    z = r @ p["c"]
    z += table.kind.take(last, axis=0)
    d = soft(z, rows * CLASSES + kind, less[:, 0])
    np.matmul(r.T, d, out=g["c"])
    dr, z = d @ p["c"].T, np.empty((len(target), MEMBERS), r.dtype)
    own_ = [(c, slice(cut[c], cut[c + 1])) for c in range(CLASSES) if cut[c] < cut[c + 1]]
    for c, at in own_:
        np.matmul(r[at], p["m"][c], out=z[at])
    z += table.member.reshape(-1, MEMBERS).take(last * CLASSES + kind, axis=0)
    d = soft(z, rows * MEMBERS + target % MEMBERS, less[:, 1])
    g["m"][:] = 0
    more = np.empty_like(dr)
    for c, at in own_:
        np.matmul(r[at].T, d[at], out=g["m"][c])
        np.matmul(d[at], p["m"][c].T, out=more[at])
    dr += more
    dr *= r > 0
    g["b"][:] = np.ones(len(dr), dr.dtype) @ dr
    g["v"][:], g["u"][:], g["w"][:] = of.T @ dr, own.take(here, axis=0).T @ dr, own.take(back, axis=0).T @ dr
    # Back to what was mixed, to the token and to the one before.
    dr = dr @ np.concatenate((p["v"], p["u"], p["w"])).T
    dm, de = np.zeros((*x.shape, WIDTH), dr.dtype), np.zeros((*x.shape, WIDTH), dr.dtype)
    flat(de)[known - 1] = dr[:, 2 * WIDTH :]
    de[:, -1] = 0
    flat(de)[known] += dr[:, WIDTH : 2 * WIDTH]
    flat(dm)[known] = dr[:, :WIDTH]
    dm *= part
    da = dm @ e.transpose(0, 2, 1)
    da -= ((dm * mixed) @ np.ones(WIDTH, dm.dtype))[:, :, None]
    da *= a
    g["a"][:] = np.bincount(BACK, np.ones(len(x), da.dtype) @ da.reshape(len(x), -1), CONTEXT)
    both = np.empty((*x.shape, 2 * WIDTH), dr.dtype)
    both[:, :, :WIDTH], both[:, :, WIDTH:] = da @ k, da.transpose(0, 2, 1) @ q
    ways = flat(e).T @ flat(both)
    g["q"][:], g["k"][:] = ways[:, :WIDTH] * SCALE, ways[:, WIDTH:]
    de += a.transpose(0, 2, 1) @ dm
    de += (flat(both) @ look.T).reshape(de.shape)
    de[gap] *= there
    g["e"][:] = 0
    g["e"][some] = np.add.reduceat(flat(de).take(order, axis=0), edge, axis=0)
    return loss / n


def train(flat: np.ndarray, table: Table, x: np.ndarray, y: np.ndarray, steps: int, rate: float, seed: int, batch: int = 64) -> np.ndarray:
    """Weights after Adam steps on the windows."""
    flat, g = flat.copy(), np.zeros_like(flat)
    p, gp = unpack(flat), unpack(g)
    m, v, s, rng = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.random.default_rng(seed)
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate((order, rng.permutation(len(x))))
        at, order = order[:batch], order[batch:]
        gradient(p, table, x.take(at, axis=0), y.take(at, axis=0), gp)
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g *= 1 / norm
        # m += 0.1 * (g - m); v += 0.01 * (g * g - v)
        m *= 0.9
        m += np.multiply(g, 0.1, out=s)
        v *= 0.99
        g *= g
        v += np.multiply(g, 0.01, out=g)
        np.sqrt(np.multiply(v, 1 / (1 - 0.99**t), out=s), out=s)
        s += 1e-8
        np.divide(m, s, out=s)
        flat -= np.multiply(s, rate * (1 - 0.9 * t / steps) / (1 - 0.9**t), out=s)
    return flat


class Scorer:
    """Natural log probabilities of tokens; what depends on one token alone is tabled."""

    def __init__(self, flat: np.ndarray, table: Table):
        p = unpack(flat.astype(np.float32))
        q, k = p["e"] @ (p["q"] * SCALE), p["e"] @ p["k"]
        self.q, self.seen = q, np.concatenate((k, p["e"]), axis=1)
        # The last row is for what has no token before it.
        self.u, self.w = p["e"] @ p["u"] + p["b"], np.concatenate((p["e"] @ p["w"], np.zeros((1, HIDDEN), np.float32)))
        self.v, self.c, self.m = p["v"], p["c"], p["m"]
        self.kind, self.member = table.kind, table.member.reshape(SLOTS * CLASSES, MEMBERS)
        ago = HALF + np.arange(HALF)[:, None] - np.arange(CONTEXT)[None, :]
        self.near = np.where(ago >= 0, p["a"][np.maximum(ago, 0)], -1e9).astype(np.float32)
        # Exponents are shifted so that none can be too large; a shift changes no share.
        most = math.sqrt(float((q**2).sum(axis=1).max() * (k**2).sum(axis=1).max())) + float(p["a"].max())
        self.near -= max(0.0, most - 60)

    def score(self, tokens: np.ndarray, offsets: np.ndarray, blocks: int = 512) -> np.ndarray:
        """Of each token of each text (offsets: where texts begin, and the end).

        Every window of CONTEXT tokens scores its last half, and overlaps the
        one before by half; so each token is scored once, with HALF tokens
        before it at least, or all there are.
        """
        size = np.diff(offsets)
        out = np.empty(len(tokens), np.float32)
        if not len(tokens):
            return out
        # Texts lie in blocks of HALF tokens, with an empty one before each: a window is two blocks in a row.
        per = -(-size // HALF)
        begin = np.cumsum(per + 1) - per
        place = np.arange(len(tokens)) + np.repeat(HALF * begin - offsets[:-1], size)
        n = int(begin[-1] + per[-1])
        last, known, head = np.zeros(n * HALF, np.int64), np.zeros(n * HALF, bool), np.zeros(n, bool)
        last[place[1:]] = tokens[:-1]
        some = begin[size > 0]
        last[HALF * some] = BEGIN
        known[place], head[some] = True, True
        done = 0
        for a in range(1, n, blocks):
            b = min(n, a + blocks)
            seq = last[HALF * (a - 1) : HALF * b]
            cur, first = seq[HALF:], head[a:b]
            seen = self.seen.take(seq, axis=0)
            k, e = (np.lib.stride_tricks.as_strided(x, (b - a, CONTEXT, WIDTH), (HALF * x.strides[0], *x.strides)) for x in (seen[:, :WIDTH], seen[:, WIDTH:]))
            s = self.q.take(cur, axis=0).reshape(b - a, HALF, WIDTH) @ k.transpose(0, 2, 1)
            s += self.near
            s[first, :, :HALF] = -1e9
            np.exp(s, out=s)
            mixed = (s @ e).reshape(-1, WIDTH)
            total = s.reshape(-1, CONTEXT) @ np.ones(CONTEXT, s.dtype)
            back = seq[HALF - 1 : -1].copy()
            back[::HALF][first] = SLOTS
            valid = np.flatnonzero(known[HALF * a : HALF * b])
            out[done : done + len(valid)] = self._tail(mixed, total, cur, back, valid, tokens[done : done + len(valid)])
            done += len(valid)
        return out

    def _tail(self, mixed: np.ndarray, total: np.ndarray, last: np.ndarray, back: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probabilities of the targets, which follow the places ``at`` of what was mixed (its shares add up to ``total``), of ``last`` and of what is before that."""
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")  # class by class
        at, target = at[order], target[order].astype(np.intp)
        last, kind, n = last[at], target // MEMBERS, len(target)
        mixed = mixed.take(at, axis=0)
        mixed /= np.maximum(total[at], 1e-30)[:, None]
        r = mixed @ self.v
        r += self.u.take(last, axis=0)
        r += self.w.take(back[at], axis=0)
        np.maximum(r, 0, out=r)
        z = r @ self.c
        z += self.kind.take(last, axis=0)
        found, total = self._chance(z, np.arange(0, n * CLASSES, CLASSES) + kind)
        cut = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        z = np.empty((n, MEMBERS), r.dtype)
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if a < b:
                np.matmul(r[a:b], self.m[c], out=z[a:b])
        z += self.member.take(last * CLASSES + kind, axis=0)
        more, rest = self._chance(z, np.arange(0, n * MEMBERS, MEMBERS) + target % MEMBERS)
        found += more
        total *= rest
        found -= np.log(total)
        out = np.empty_like(found)
        out[order] = found
        return out

    @staticmethod
    def _chance(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponents at the places ``at`` of ``z``, and sums of powers of its rows; ``z`` is overwritten."""
        if float(z.max(initial=0)) > 60:
            np.minimum(z, 60, out=z)
        found = z.reshape(-1).take(at)
        return found, np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype)
