"""Matrices with columns A, C, G, T, and what is computed from one of them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

#: The bases each IUPAC letter stands for. A gap-free window scores N as 0.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "M": "AC", "K": "GT", "W": "AT", "S": "CG", "Y": "CT", "R": "AG"}
LETTERS = "ACGTNVHDBMKWSYR"
#: Pseudo-probabilities for zeros: one for scores, another for score distributions.
SCORE_PSEUDO, CDF_PSEUDO = 1e-4, 1e-3
UNIFORM = (0.25, 0.25, 0.25, 0.25)
_CODE = np.full(256, -1, dtype=np.int8)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i


@dataclass
class Motif:
    """A named k x 4 matrix; ``n_sites`` is the number of sites it was made from, if known."""

    name: str
    mat: np.ndarray
    n_sites: int | None = None
    weights: list[int] = field(default_factory=list)


def sub_matrix(m: np.ndarray, i: int, n: int) -> np.ndarray:
    """``n`` rows from row i on."""
    return m[i : i + n]


def reverse_complement(m: np.ndarray) -> np.ndarray:
    """The matrix read from the other strand."""
    return m[::-1, ::-1].copy()


def gc_content(m: np.ndarray) -> float:
    """Mean of C + G over the rows."""
    return float(m[:, 1:3].sum() / len(m))


def consensus(m: np.ndarray) -> str:
    """Consensus by Cavener's rule: one letter above 1/2 and twice the next, two above 3/4, else N."""
    two = {v: k for k, v in IUPAC.items() if len(v) == 2}
    out = []
    for row in m:
        a, b = np.argsort(-row, kind="stable")[:2]
        if row[a] > 0.5 and row[a] > 2 * row[b]:
            out.append("ACGT"[a])
        elif row[a] + row[b] > 0.75:
            out.append(two["".join(sorted("ACGT"[a] + "ACGT"[b]))])
        else:
            out.append("N")
    return "".join(out)


def encode(seq: str) -> np.ndarray:
    """Letter codes of a sequence; other letters raise."""
    c = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]
    if (c < 0).any():
        raise ValueError("invalid nucleotide")
    return c


def log_odds(m: np.ndarray, bg=UNIFORM) -> np.ndarray:
    """k x 15 table: score of each IUPAC letter at each row."""
    p, b = np.where(m == 0, SCORE_PSEUDO, m), np.asarray(bg, dtype=float)
    out = np.zeros((len(m), len(LETTERS)))
    for j, c in enumerate(LETTERS):
        if c != "N":
            at = ["ACGT".index(x) for x in IUPAC[c]]
            out[:, j] = np.log(p[:, at].sum(1) / b[at].sum())
    return out


def window_scores(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Score of every window of the table's length."""
    k, n = len(table), len(codes) - len(table) + 1
    if n <= 0:
        return np.zeros(0)
    s = np.zeros(n)
    for j in range(k):
        s += table[j, codes[j : j + n]]
    return s


def score(m: np.ndarray, seq: str, bg=UNIFORM) -> float:
    """Score of one word as long as the matrix."""
    return float(window_scores(log_odds(m, bg), encode(seq)).sum())


def scores(m: np.ndarray, seq: str, bg=UNIFORM) -> np.ndarray:
    """Score of every window of a sequence."""
    return window_scores(log_odds(m, bg), encode(seq))


def _best(m: np.ndarray, bg) -> np.ndarray:
    """Log-odds of the most probable letter of each row; of equal ones the last."""
    i = 3 - np.argmax(m[:, ::-1], axis=1)
    return np.log(m[np.arange(len(m)), i] / np.asarray(bg)[i])


def optimal_score(m: np.ndarray, bg=UNIFORM) -> float:
    """Score of the best word."""
    return float(_best(m, bg).sum())


def optimal_suffix_scores(m: np.ndarray, bg=UNIFORM) -> np.ndarray:
    """Best score still to be had after each row."""
    b = _best(m, bg)
    return np.append(np.cumsum(b[::-1])[::-1][1:], 0.0)


def background_probability(word: str, bg=UNIFORM) -> float:
    """Chance of a word under the background."""
    return math.prod(bg["ACGT".index(c)] for c in word)


def find_hits(m: np.ndarray, seq: str, threshold: float, bg=UNIFORM, *, skip: bool = True, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and scores of forward windows at or above the threshold; ``skip`` leaves out windows with ambiguous letters."""
    codes = encode(seq)
    s = window_scores(log_odds(m, bg) if table is None else table, codes)
    ok = s >= threshold
    if skip and len(s):
        amb = np.concatenate([[0], np.cumsum(codes > 3)])
        ok &= amb[len(m) :] == amb[: len(amb) - len(m)]
    at = np.flatnonzero(ok)
    return at, s[at]


def max_match(m: np.ndarray, seq: str, bg=UNIFORM) -> float:
    """Largest window score; minus infinity for a sequence that is too short."""
    s = scores(m, seq, bg)
    return float(s.max()) if len(s) else -math.inf


# --- score distribution --------------------------------------------------------------------------
# Fixed values of the score grid: the finest bin, and the most bins.
GRID_STEP, GRID_BINS = 1e-5, 200_000


def score_cdf(m: np.ndarray, bg=UNIFORM, *, precision: float = GRID_STEP, max_bins: int = GRID_BINS) -> tuple[np.ndarray, np.ndarray]:
    """Distribution of scores under the background: values and P(X <= value).

    The score of a word is a sum of independent rows, so its density is the convolution of theirs, taken
    on a grid of at most ``max_bins`` bins of ``precision`` or more and read at their centres. Rows in
    which all letters score alike shift nothing. Only the two ends of flat stretches are kept.
    """
    weights = np.asarray(bg, dtype=float)
    rows = np.log(np.where(m == 0, CDF_PSEUDO, m)) - np.log(weights)
    value, mass = np.zeros(1), np.ones(1)  # scores that occur, and their probability
    ends = np.zeros(1)
    for row in rows:
        low, high = value[0] + row.min(), value[-1] + row.max()
        if low >= high:
            continue
        bins = min(max_bins, math.ceil((high - low) / precision))
        step = (high - low) / bins
        slot = np.minimum(((np.add.outer(row, value) - low) / step).astype(np.int64), bins - 1)
        dense = np.bincount(slot.ravel(), np.multiply.outer(weights, mass).ravel(), bins)
        centre = (np.arange(bins) + 0.5) * step + low
        used = dense > 0
        value, mass, ends = centre[used], dense[used], centre[[0, -1]]
    below = np.cumsum(mass)
    if not len(rows) or len(ends) == 1:
        return value, below
    # A jump is drawn from the end of the flat stretch before it, one bin earlier, unless that bin jumps too.
    step = (ends[1] - ends[0]) / max(1, bins - 1)
    before = value - step
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = before[1:] - value[:-1] > step / 2
    fresh[0] = before[0] > ends[0] - step / 2
    x = np.concatenate([before[fresh], value, ends])
    y = np.concatenate([np.concatenate([[0.0], below])[:-1][fresh], below, [below[0] if value[0] <= ends[0] + step / 2 else 0.0, below[-1]]])
    order = np.unique(np.round((x - ends[0]) / step).astype(np.int64), return_index=True)[1]
    return x[order], y[order]


def cdf(d: tuple[np.ndarray, np.ndarray], x: float) -> float:
    """P(X <= x), linear between points, 0 below the first."""
    v, p = d
    i = int(np.searchsorted(v, x))
    if i >= len(v):
        return float(p[-1])
    if i == 0:
        return float(p[0]) if x == v[0] else 0.0
    w = (x - v[i - 1]) / (v[i] - v[i - 1])
    return float((1 - w) * p[i - 1] + w * p[i])


def cdf_inverse(d: tuple[np.ndarray, np.ndarray], q: float) -> float:
    """Value with P(X <= value) = q; infinity above the last point; q below the first or outside [0, 1] raises."""
    v, p = d
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    i = int(np.searchsorted(p, q))
    if i >= len(v):
        return math.inf
    if i == 0:
        if q == p[0]:
            return float(v[0])
        raise ValueError("q lies below the distribution")
    w = (q - p[i - 1]) / (p[i] - p[i - 1])
    return float((1 - w) * v[i - 1] + w * v[i])


def truncate_cdf(d: tuple[np.ndarray, np.ndarray], q: float) -> tuple[np.ndarray, np.ndarray]:
    """The points with P >= q."""
    keep = d[1] >= q
    return d[0][keep], d[1][keep]


def p_value_to_score(p: float, m: np.ndarray, bg=UNIFORM) -> float:
    """Least score whose p-value is below ``p``, from the distribution."""
    return cdf_inverse(score_cdf(m, bg), 1 - p)


def p_value_to_score_exact(p: float, m: np.ndarray, bg=UNIFORM, *, limit: int = 10) -> float:
    """The same by listing all words; only for matrices of at most ``limit`` rows."""
    if len(m) > limit:
        raise ValueError("too many words")
    s, pb = np.zeros(1), np.ones(1)
    for row in log_odds(m, bg)[:, :4]:  # every word so far, followed by every letter
        s, pb = np.add.outer(s, row).ravel(), np.multiply.outer(pb, np.asarray(bg)).ravel()
    order = np.argsort(-s, kind="stable")
    i = int(np.searchsorted(np.cumsum(pb[order]), p, side="right"))
    return float(s[order][min(i, len(s) - 1)])


def trim(m: np.ndarray, cutoff: float, bg=UNIFORM) -> np.ndarray:
    """Without the outer rows whose divergence from the background (bits) is below the cutoff."""
    b = np.asarray(bg, dtype=float)
    safe = np.where(m > 0, m, 1.0)
    kl = np.where(m > 0, m * (np.log2(safe) - np.log2(b)), 0.0).sum(1)
    keep = np.flatnonzero(kl >= cutoff)
    return m[keep[0] : keep[-1] + 1] if len(keep) else m[:0]
