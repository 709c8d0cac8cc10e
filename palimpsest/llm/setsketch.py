"""SetSketch registers: exponentially spaced truncated minima, their bands and their joint likelihood.

Register i of a set holds max(0, min(q + 1, floor(1 - log_b(min of Exp(a) over elements)))). The exponential values of
an element are the points of one Poisson process of rate a * m, each dealt to a register at random; dealing splits it
into m independent processes of rate a, whose first points are the wanted values. Points come in rising order, so an
element stops once its point cannot raise the lowest register of its set. Registers of a union are the maxima of
the registers (mergeable), and two sets agree in a register with a probability near their Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

from palimpsest.llm.textops import U, mix

#: Registers of a sketch, base and rate of the spacing, largest register.
M, BASE, RATE, TOP = 256, 1.001, 20.0, 65535
#: Registers of a band and bands. A pair at similarity 0.8 misses all bands with a probability of about 1e-5.
ROWS, BANDS = 8, 80
_LOG = math.log(BASE)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def sketches(value: np.ndarray, doc: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """Registers (docs x m, uint16) of the sets whose elements are given as (hash, document)."""
    regs = np.zeros((docs, m), np.uint16)
    flat = regs.reshape(-1)
    seed, at = mix(value), doc.astype(np.int64)
    x = np.zeros(len(value))
    step, wide = 0, 1
    while len(seed):
        j = np.arange(step + 1, step + wide + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        state = mix(seed[:, None] + j[None, :]) if wide > 1 else mix(seed + j[0])[:, None]
        gap = -np.log((state >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (RATE * m)
        gap[:, 0] += x
        point = np.cumsum(gap, axis=1) if wide > 1 else gap
        rank = np.clip(np.floor(1 - np.log(point) / _LOG), 0, TOP).astype(np.uint16)
        np.maximum.at(flat, ((at * m)[:, None] + (state & U(m - 1)).astype(np.int64)).reshape(-1), rank.reshape(-1))
        low = regs.min(axis=1) if len(seed) > docs else None
        live = rank[:, -1] > (low[at] if low is not None else regs[at].min(axis=1))
        seed, at, x = seed[live], at[live], point[live, -1]
        step += wide
        wide = max(1, min(64, 20_000 // max(1, len(seed)))) if step >= 4 else 1
    return regs


def _choices(rows: int, bands: int, m: int) -> np.ndarray:
    pick = np.random.default_rng(20240229)
    return np.array([pick.choice(m, rows, replace=False) for _ in range(bands)])


_PICKS = _choices(ROWS, BANDS, M)


def band_keys(regs: np.ndarray, lo: int = 0, hi: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band from lo to hi (docs x bands); a band is a fixed random choice of registers."""
    out = np.empty((len(regs), hi - lo), np.uint64)
    for b in range(lo, hi):
        h = np.full(len(regs), b + 1, np.uint64)
        for c in _PICKS[b]:
            h = mix(h ^ regs[:, c].astype(np.uint64))
        out[:, b - lo] = h
    return out


def _terms(j, u, v):
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return np.log(np.maximum(up, tiny)), np.log(np.maximum(down, tiny)), np.log(np.maximum(1 - up - down, tiny))


def likelihood(j, above, below, same, u, v):
    """Log likelihood of similarity j, given how many registers of the first set are above, below, the same."""
    a, b, c = _terms(j, u, v)
    return above * a + below * b + same * c


def estimate(above, below, same, n1, n2, steps: int = 40):
    """The similarity of the greatest likelihood, with the sizes known; by golden-section search (it is concave)."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(c, above, below, same, u, v) > likelihood(d, above, below, same, u, v)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


#: Similarities that stand against the threshold in plausible(), as shares of it.
GRID = (0.1, 0.3, 0.5, 0.65, 0.75, 0.85, 0.92)


def plausible(above, below, same, n1, n2, threshold: float, ratio: float = 50.0) -> np.ndarray:
    """False where the sizes forbid the threshold, or where some lower similarity of a grid is so much likelier that twice the
    log likelihood ratio is over ``ratio`` (a true pair is lost with a probability below 1e-11)."""
    n1, n2 = n1.astype(float), n2.astype(float)
    out = np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9
    i = np.flatnonzero(out & (same < threshold * (above + below + same)))
    if len(i):
        above, below, same, n1, n2 = (x[i] for x in (above, below, same, n1, n2))
        u, v = n1 / (n1 + n2), n2 / (n1 + n2)
        at = likelihood(np.minimum(threshold, np.minimum(u / v, v / u)), above, below, same, u, v)
        ok = np.ones(len(i), bool)
        for g in GRID:
            ok &= 2 * (likelihood(g * threshold, above, below, same, u, v) - at) <= ratio
        out[i] = ok
    return out


def compare(regs: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers of row i that are above, below, the same, against every later row."""
    rest = regs[i + 1 :]
    above = (regs[i] > rest).sum(axis=1)
    below = (regs[i] < rest).sum(axis=1)
    return above, below, regs.shape[1] - above - below
