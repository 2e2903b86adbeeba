"""Alignments with their operations, for one pair at a time.

Operations: = match, X mismatch, D a code point of the query alone, I one of the target alone.
"""

from __future__ import annotations

from itertools import groupby

PATH_SCHEMA = (
    "struct<score: bigint, query_start: bigint, query_end: bigint, target_start: bigint, target_end: bigint, operations: string, cigar: string, matches: bigint, mismatches: bigint, "
    "insertions: bigint, deletions: bigint, aligned_length: bigint, aligned_query: string, aligned_target: string>"
)
_LOW = -(1 << 60)


def cigar(operations: str) -> str:
    return "".join(f"{len(list(run))}{op}" for op, run in groupby(operations))


def align(query: str, target: str, local: bool, match: int = 2, mismatch: int = -1, gap_open: int = -1, gap_extend: int | None = None, score=None, same=None) -> dict:
    """The path as a dict of PATH_SCHEMA's fields.

    Of equally good ways a cell takes the diagonal before the one from above (D) before the one from the left (I); the
    end of a local alignment is the first best cell, row by row. score(p, q) and same(p, q) stand in for match and equality.
    """
    extend = gap_open if gap_extend is None else gap_extend
    m, n = len(query), len(target)
    score = score or (lambda p, q: match if p == q else mismatch)
    same = same or (lambda p, q: p == q)
    h = [[0] * (n + 1) for _ in range(m + 1)]
    up = [[_LOW] * (n + 1) for _ in range(m + 1)]
    left = [[_LOW] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        up[i][0] = max(h[i - 1][0] + gap_open, up[i - 1][0] + extend)
        h[i][0] = 0 if local else up[i][0]
    for j in range(1, n + 1):
        left[0][j] = max(h[0][j - 1] + gap_open, left[0][j - 1] + extend)
        h[0][j] = 0 if local else left[0][j]
    best, end = 0, (0, 0)
    for i in range(1, m + 1):
        row, above, u, v, l_ = h[i], h[i - 1], up[i], up[i - 1], left[i]
        for j in range(1, n + 1):
            u[j] = max(above[j] + gap_open, v[j] + extend)
            l_[j] = max(row[j - 1] + gap_open, l_[j - 1] + extend)
            row[j] = max(above[j - 1] + score(query[i - 1], target[j - 1]), u[j], l_[j], 0 if local else _LOW)
            if local and row[j] > best:
                best, end = row[j], (i, j)
    i, j = end if local else (m, n)
    stop_i, stop_j = i, j
    ops, state = [], "h"
    while (h[i][j] > 0 or state != "h") if local else (i or j):
        if state == "h":
            if i and j and h[i][j] == h[i - 1][j - 1] + score(query[i - 1], target[j - 1]):
                ops.append("=" if same(query[i - 1], target[j - 1]) else "X")
                i, j = i - 1, j - 1
                continue
            state = "up" if i and h[i][j] == up[i][j] else "left"
        if state == "up":
            ops.append("D")
            state = "h" if up[i][j] == h[i - 1][j] + gap_open else "up"
            i -= 1
        else:
            ops.append("I")
            state = "h" if left[i][j] == h[i][j - 1] + gap_open else "left"
            j -= 1
    operations = "".join(reversed(ops))
    p, q, x, y = i, j, [], []
    for op in operations:
        x.append("-" if op == "I" else query[p])
        y.append("-" if op == "D" else target[q])
        p, q = p + (op != "I"), q + (op != "D")
    return {
        "score": best if local else h[m][n], "query_start": i, "query_end": stop_i, "target_start": j, "target_end": stop_j, "operations": operations, "cigar": cigar(operations),
        "matches": operations.count("="), "mismatches": operations.count("X"), "insertions": operations.count("I"), "deletions": operations.count("D"), "aligned_length": len(operations),
        "aligned_query": "".join(x), "aligned_target": "".join(y),
    }
