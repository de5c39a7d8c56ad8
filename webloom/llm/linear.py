"""Hashed n-gram indicators of texts, and a naive-Bayes-scaled linear model on them.

Features of a text, as cells of a table of 2**BITS: its words (lower-case), its word pairs, the
shapes of its words (runs of lower-case letters, capitals and digits collapsed) and shape pairs,
and whether a word equals the one before. Present or absent, however often.
"""

from __future__ import annotations

import numpy as np

from . import common as C

BITS = 18
CELLS = 1 << BITS

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = ord("a")
SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
_SALT = C.powers(8, np.uint64(0xA24BAED4963EE407))


def _shape_hashes(raw, starts, ends):
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    total = int(lens.sum())
    s = SHAPE[raw[np.arange(total) + np.repeat(starts - at, lens)]]
    first = np.zeros(total, dtype=bool)
    first[at] = True
    keep = first.copy()
    keep[1:] |= s[1:] != s[:-1]
    top = np.cumsum(keep)
    begin = top[at] - 1
    s = s[keep]
    n = np.diff(np.append(begin, len(s)))
    within = np.arange(len(s)) - np.repeat(begin, n)
    return C.mixed(np.add.reduceat(C.BYTE_VALUE[s] * C.powers(int(n.max()))[within], begin) + n.astype(np.uint64))


def _pairs(h, salt):
    return (h[:-1] * C.PLACE_BASE) ^ (h[1:] + salt)


def cell_lists(raw: np.ndarray, off: np.ndarray, pairs: bool = True):
    """Of each text the distinct cells of its features; and the words per text."""
    starts, ends, per = C.word_spans(raw, off)
    w = C.word_hashes(raw, starts, ends)
    s = _shape_hashes(raw, starts, ends)
    cell = lambda x: (C.mixed(x) >> np.uint64(64 - BITS)).astype(np.int32)
    sp = cell(_pairs(s, _SALT[4]))
    same = w[1:] == w[:-1]
    sp[same] = 1
    kinds = [cell(w + _SALT[1]), cell(s + _SALT[2])]
    twos = [sp] + ([cell(_pairs(w, _SALT[3]))] if pairs else [])
    stamp = np.zeros(CELLS, dtype=np.int32)
    out, top = [], np.cumsum(per)
    for a, b in zip((top - per).tolist(), top.tolist()):
        c = np.concatenate([k[a:b] for k in kinds] + [t[a : b - 1] if b > a else t[:0] for t in twos])
        rank = np.arange(len(c), dtype=np.int32)
        stamp[c] = rank
        out.append(c[stamp[c] == rank])
    return out, per


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0, least: int = 2) -> np.ndarray:
    """Class log-count ratios of the cells; 0 where fewer than ``least`` rows have the cell."""
    pos, neg = np.zeros(CELLS), np.zeros(CELLS)
    for c, label in zip(rows, y):
        (pos if label > 0 else neg)[c] += 1
    seen = pos + neg >= least
    # rates per row of the class, so that what is missing everywhere says nothing
    p = (pos + smooth) / (max((y > 0).sum(), 1) + 2 * smooth)
    q = (neg + smooth) / (max((y <= 0).sum(), 1) + 2 * smooth)
    return np.where(seen, np.log(p / q), 0.0)


def scaled(c: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row as (cells, values): log ratios at unit length."""
    v = ratio[c]
    use = v != 0
    c, v = c[use], v[use]
    norm = np.sqrt((v * v).sum())
    return c, v / norm if norm > 0 else v


def dual_descent(rows, y, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + cost * sum of hinge losses, one dual variable at a time.

    ``cost`` is shared out so that both classes weigh the same.
    """
    w, bias, alpha = np.zeros(CELLS), 0.0, np.zeros(len(rows))
    per = {s: cost * len(rows) / (2 * max((y == s).sum(), 1)) for s in (1, -1)}
    rng = np.random.Generator(np.random.PCG64(seed))
    square = [float((v * v).sum()) + 1.0 for _, v in rows]
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            c, v = rows[i]
            g = y[i] * (w[c] @ v + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), per[int(y[i])])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[c] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a m + b))) fits smoothed labels."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        d = p * (1 - p) + 1e-9
        h = np.array([[(d * m * m).sum() + 1e-3, (d * m).sum()], [(d * m).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    """ratio and weights over cells, a bias, and the sigmoid's (a, b)."""

    def __init__(self, ratio, weight, bias, a, b):
        self.ratio, self.weight, self.bias, self.a, self.b = ratio.astype(np.float32), (ratio * weight).astype(np.float32), bias, a, b

    def score(self, c: np.ndarray) -> float:
        v = self.ratio[c]
        norm = float(np.sqrt((v * v).sum()))
        m = float(self.weight[c].sum()) / norm + self.bias if norm > 0 else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30))))


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """The sigmoid comes from margins of rows left out of a first fit; then all rows are fitted."""
    y = np.where(y > 0, 1, -1)
    if len(rows) == 0 or len(set(y.tolist())) < 2:
        p = (np.sum(y > 0) + 1) / (len(y) + 2)
        return Model(np.zeros(CELLS), np.zeros(CELLS), 0.0, 1.0, float(np.log(p / (1 - p))))
    out = np.arange(len(rows)) % 4 == 3
    if len(set(y[~out].tolist())) == 2 and out.any():
        part = [r for r, o in zip(rows, out) if not o]
        ratio = log_ratios(part, y[~out])
        w, bias = dual_descent([scaled(c, ratio) for c in part], y[~out])
        m = np.array([(w[c] @ v) + bias for c, v in (scaled(r, ratio) for r, o in zip(rows, out) if o)])
        a, b = sigmoid_fit(m, y[out])
    else:
        a, b = 1.0, 0.0
    ratio = log_ratios(rows, y)
    w, bias = dual_descent([scaled(c, ratio) for c in rows], y)
    return Model(ratio, w, bias, a, b)
