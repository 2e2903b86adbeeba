"""Dynamic programs over many string pairs at once.

Strings are matrices of code points, one row per pair, padded to the longest of their sub-batch; a step of
the program is one numpy operation over all pairs. Pairs are sorted by length first, so that padding is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Cells of one layer of a program that are held at once.
CELLS = 1 << 21
#: Pairs of a sub-batch at most.
LANES = 4096
_BIG = np.int64(1) << 40


def encode(strings: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): code points of each string in a row, padded."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.full((len(strings), int(lengths.max(initial=0))), pad, np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    return codes, lengths


def batched(kernel: Callable, a: Sequence[str], b: Sequence[str], dtype=np.int64) -> np.ndarray:
    """kernel(codes_a, codes_b, lengths_a, lengths_b) over sub-batches of pairs with like lengths."""
    out = np.zeros(len(a), dtype)
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # As many pairs as fit, when all are as long as the last of them.
        k = max(1, min(LANES, CELLS // (int(size[order[min(at + LANES, len(order)) - 1]]) + 1)))
        part = order[at : at + k]
        at += k
        x, m = encode([a[i] for i in part], -1)
        y, n = encode([b[i] for i in part], -2)
        out[part] = kernel(x, y, m, n)
    return out


def _rows(x, y, m, n, substitute: int, transpose: bool) -> np.ndarray:
    lanes, width = np.arange(len(x)), y.shape[1]
    column = np.arange(width + 1)
    row = np.broadcast_to(column, (len(x), width + 1)).astype(np.int64)
    above = None
    out = np.where(m == 0, n, 0)
    for i in range(1, x.shape[1] + 1):
        differ = x[:, i - 1 : i] != y
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, :-1] + np.where(differ, substitute, 0), row[:, 1:] + 1, out=new[:, 1:])
        if transpose and i > 1 and width > 1:
            swapped = (x[:, i - 1 : i] == y[:, :-1]) & (x[:, i - 2 : i - 1] == y[:, 1:])
            new[:, 2:] = np.where(swapped, np.minimum(new[:, 2:], above[:, :-2] + 1), new[:, 2:])
        # Insertions run along the row: the least of what stands before, with a step for each column between.
        new = np.minimum.accumulate(new - column, axis=1) + column
        done = m == i
        out[done] = new[lanes[done], n[done]]
        above, row = row, new
    return out


def _columns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each place of y, which places of x hold its symbol, as bits: one unsigned number a lane. x has 64 columns at most."""
    bits = np.zeros((y.shape[1], len(x), 8), np.uint8)
    packed = np.packbits(x[None] == y.T[:, :, None], axis=2, bitorder="little")
    bits[:, :, : packed.shape[2]] = packed
    return bits.view("<u8")[:, :, 0]


def _bits_edits(x, y, m, n, transpose: bool) -> np.ndarray:
    """Edit distances by vertical differences held in the bits of one number a lane."""
    zero, one = np.uint64(0), np.uint64(1)
    up, down = np.full(len(x), ~zero), np.full(len(x), zero)
    top = np.where(m > 0, m - 1, 0).astype(np.uint64)
    score, out = m.copy(), np.where(n == 0, m, 0)
    before_eq = diagonal = np.full(len(x), zero)
    for j, eq in enumerate(_columns(x, y)):
        swap = (((~diagonal) & eq) << one) & before_eq if transpose else zero
        diagonal = (((eq & up) + up) ^ up) | eq | down | swap
        right = down | ~(diagonal | up)
        left = diagonal & up
        score += ((right >> top) & one).astype(np.int64) - ((left >> top) & one).astype(np.int64)
        right = (right << one) | one
        up, down, before_eq = (left << one) | ~(diagonal | right), right & diagonal, eq
        done = n == j + 1
        out[done] = score[done]
    return np.where(m == 0, n, out)


def _bits_common(x, y, m, n) -> np.ndarray:
    """Indel distances: what is cleared in a lane's bits counts its longest common subsequence."""
    state = np.full(len(x), ~np.uint64(0))
    out = np.where(n == 0, state, 0)
    for j, eq in enumerate(_columns(x, y)):
        met = state & eq
        state = (state + met) | (state - met)
        done = n == j + 1
        out[done] = state[done]
    inside = np.where(m >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(m, 63).astype(np.uint64)) - np.uint64(1))
    return m + n - 2 * np.bitwise_count(~out & inside).astype(np.int64)


def _by_bits(short: Callable, long: Callable) -> Callable:
    """short for pairs of which one string has 64 symbols at most, the other way round if need be; long for the rest."""

    def run(a, b) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        m, n = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
        fits = np.flatnonzero(np.minimum(m, n) <= 64)
        if len(fits):
            x = [a[i] if m[i] <= n[i] else b[i] for i in fits]
            y = [b[i] if m[i] <= n[i] else a[i] for i in fits]
            out[fits] = batched(short, x, y)
        rest = np.flatnonzero(np.minimum(m, n) > 64)
        if len(rest):
            out[rest] = batched(long, [a[i] for i in rest], [b[i] for i in rest])
        return out

    return run


_levenshtein = _by_bits(lambda x, y, m, n: _bits_edits(x, y, m, n, False), lambda x, y, m, n: _rows(x, y, m, n, 1, False))
_osa = _by_bits(lambda x, y, m, n: _bits_edits(x, y, m, n, True), lambda x, y, m, n: _rows(x, y, m, n, 1, True))
_indel = _by_bits(_bits_common, lambda x, y, m, n: _rows(x, y, m, n, 2, False))


def levenshtein(a, b) -> np.ndarray:
    return _levenshtein(a, b)


def osa(a, b) -> np.ndarray:
    """Edits and swaps of neighbours, no substring edited twice: ("ca", "abc") -> 3."""
    return _osa(a, b)


def indel(a, b) -> np.ndarray:
    """Insertions and deletions alone: len(a) + len(b) - 2 * LCS."""
    return _indel(a, b)


def lcs_length(a, b) -> np.ndarray:
    return (np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) - indel(a, b)) // 2


def _damerau(x, y, m, n) -> np.ndarray:
    lanes, rows, width = np.arange(len(x)), x.shape[1], y.shape[1]
    h = np.full((len(x), rows + 2, width + 2), _BIG)
    h[:, 1:, 1] = np.arange(rows + 1)
    h[:, 1, 1:] = np.arange(width + 1)
    last_row = np.zeros((len(x), width), np.int64)  # where each of y's symbols stood in x last
    for i in range(1, rows + 1):
        last_column = np.zeros(len(x), np.int64)
        for j in range(1, width + 1):
            i1, j1 = last_row[:, j - 1], last_column
            same = x[:, i - 1] == y[:, j - 1]
            cost = np.minimum(h[:, i, j] + ~same, np.minimum(h[:, i + 1, j], h[:, i, j + 1]) + 1)
            swap = h[lanes, i1, j1] + (i - i1 - 1) + 1 + (j - j1 - 1)
            h[:, i + 1, j + 1] = np.minimum(cost, np.where((i1 > 0) & (j1 > 0), swap, _BIG))
            last_column = np.where(same, j, last_column)
        last_row = np.where(x[:, i - 1 : i] == y, i, last_row)
    return h[lanes, m + 1, n + 1]


def true_damerau_levenshtein(a, b) -> np.ndarray:
    """Edits and swaps, however far apart: ("ca", "abc") -> 2."""
    out = np.zeros(len(a), np.int64)
    size = [(len(x) + 2) * (len(y) + 2) for x, y in zip(a, b)]
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(1024, CELLS // size[order[min(at + 1023, len(order) - 1)]]))
        part = order[at : at + n]
        at += n
        x, m = encode([a[i] for i in part], -1)
        y, k = encode([b[i] for i in part], -2)
        out[part] = _damerau(x, y, m, k)
    return out


def hamming(a, b, on_length_mismatch: str = "error") -> np.ndarray:
    """Places that differ. Unequal lengths: an error, -1 ("skip"), or their difference on top ("pad")."""
    out = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        if len(x) != len(y) and on_length_mismatch == "error":
            raise ValueError(f"Hamming distance of strings of {len(x)} and {len(y)} code points")
        out[i] = -1 if len(x) != len(y) and on_length_mismatch == "skip" else sum(map(str.__ne__, x, y)) + abs(len(x) - len(y))
    return out


def _jaro(x, y, m, n) -> np.ndarray:
    lanes, width = np.arange(len(x)), y.shape[1]
    if not width or not x.shape[1]:
        return ((m == 0) & (n == 0)).astype(float)
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    column = np.arange(width)
    used, met = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        open_ = (x[:, i : i + 1] == y) & ~used & (column >= (i - reach)[:, None]) & (column <= (i + reach)[:, None])
        first = open_.argmax(axis=1)
        hit = open_[lanes, first]
        met[hit, i] = True
        used[lanes[hit], first[hit]] = True
    matches = met.sum(axis=1)
    pick = lambda codes, mask: np.take_along_axis(codes, np.argsort(~mask, axis=1, kind="stable"), axis=1)
    k = min(x.shape[1], width)
    moved = (pick(x, met)[:, :k] != pick(y, used)[:, :k]) & (np.arange(k) < matches[:, None])
    t = moved.sum(axis=1) // 2
    c = matches.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (c / m + c / n + (c - t) / c) / 3.0
    return np.where((m == 0) & (n == 0), 1.0, np.where(matches == 0, 0.0, score))


def jaro(a, b) -> np.ndarray:
    return batched(_jaro, a, b, np.float64)


def jaro_winkler(a, b, weight: float = 0.1, threshold: float = 0.7, cap: int = 4) -> np.ndarray:
    """A bonus for a common prefix of up to ``cap`` code points where Jaro reaches ``threshold``."""
    if not (np.isfinite(weight) and weight >= 0 and 0 <= threshold <= 1 and cap >= 0):
        raise ValueError("prefix weight and cap must not be negative, and the threshold must be within [0, 1]")
    out = jaro(a, b)
    for i in np.flatnonzero(out >= threshold):
        prefix = 0
        for p, q in zip(a[i][:cap], b[i][:cap]):
            if p != q:
                break
            prefix += 1
        out[i] += prefix * weight * (1.0 - out[i])
    return out


def _substring(x, y, m, n) -> np.ndarray:
    row = np.zeros((len(x), y.shape[1] + 1), np.int64)
    best, end = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i in range(x.shape[1]):
        new = np.zeros_like(row)
        new[:, 1:] = np.where(x[:, i : i + 1] == y, row[:, :-1] + 1, 0)
        most = new.max(axis=1)
        end = np.where(most > best, i + 1, end)
        best = np.maximum(best, most)
        row = new
    return best << 32 | end


def lcs_substring(a, b) -> list[str]:
    """Longest common run of code points; of several, the one that ends first in a."""
    found = batched(_substring, a, b)
    return [x[(e := int(f & 0xFFFFFFFF)) - int(f >> 32) : e] for x, f in zip(a, found)]


def alignment(a, b, local: bool, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, match: int = 2, mismatch: int = -1, gap_open: int = -1, gap_extend: int | None = None) -> np.ndarray:
    """Smith-Waterman (local) or Needleman-Wunsch scores; a gap of n costs gap_open + (n - 1) * gap_extend.

    score(codes_a, codes_b) gives substitution scores of broadcast code arrays; without it match and mismatch do.
    """
    extend = gap_open if gap_extend is None else gap_extend
    step = max(gap_open, extend)  # a run may as well be several gaps of one

    def kernel(x, y, m, n):
        lanes, column = np.arange(len(x)), np.arange(y.shape[1] + 1)
        border = np.where(column > 0, gap_open + (column - 1) * step, 0)
        row = np.broadcast_to(np.zeros_like(border) if local else border, (len(x), len(column))).astype(np.int64)
        down = np.full_like(row, -_BIG)
        inside_b = column[1:] <= n[:, None]
        best = np.zeros(len(x), np.int64)
        out = np.where(m == 0, row[lanes, n], 0)
        for i in range(1, x.shape[1] + 1):
            s = score(x[:, i - 1 : i], y) if score else np.where(x[:, i - 1 : i] == y, match, mismatch)
            down = np.maximum(row + gap_open, down + extend)
            new = np.empty_like(row)
            new[:, 0] = 0 if local else gap_open + (i - 1) * step
            np.maximum(row[:, :-1] + s, down[:, 1:], out=new[:, 1:])
            if local:
                np.maximum(new, 0, out=new)
            across = np.maximum.accumulate(new - column * step, axis=1)
            new[:, 1:] = np.maximum(new[:, 1:], across[:, :-1] + gap_open + (column[1:] - 1) * step)
            row = new
            if local:
                best = np.maximum(best, np.where(inside_b & (i <= m)[:, None], new[:, 1:], 0).max(axis=1, initial=0))
            else:
                done = m == i
                out[done] = new[lanes[done], n[done]]
        return best if local else out

    return batched(kernel, a, b)
