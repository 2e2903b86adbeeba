"""Alignments with positive gap penalties and a matrix: sw, nw and sg, each plain, with a trace, or with statistics.

sg gives what sw gives: there are no semi-global alignments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from nearspan.functions import matrices


_CODES = "MIDNSHP=X"


@dataclass(frozen=True)
class Cigar:
    """Runs of operations, and where they begin: D is a symbol of the query alone, I one of the reference alone."""

    decode: str
    beg_query: int
    beg_ref: int

    @property
    def packed(self) -> list[int]:
        """length << 4 | code of each run."""
        return [int(n) << 4 | _CODES.index(op) for n, op in re.findall(r"(\d+)(\D)", self.decode)]


@dataclass(frozen=True)
class Traceback:
    """Three lines of one length: | where both are alike, . where they differ, blank at gaps."""

    query: str
    comp: str
    ref: str


@dataclass(frozen=True)
class Result:
    score: int
    end_query: int  # the last symbol, itself included
    end_ref: int
    cigar: Cigar | None = None
    query: str | None = None
    comp: str | None = None
    ref: str | None = None
    matches: int | None = None
    similar: int | None = None
    length: int | None = None

    @property
    def traceback(self) -> Traceback | None:
        """Of alignments with a trace alone."""
        return None if self.comp is None else Traceback(self.query, self.comp, self.ref)


def _no_instructions() -> bool:
    """Kernels here run on numpy and the JVM, whatever vector instructions there are."""
    return False


can_use_sse2 = can_use_sse41 = can_use_avx2 = can_use_altivec = can_use_neon = _no_instructions


def matrix_create(alphabet: str, match: int, mismatch: int, case_sensitive: bool = False) -> matrices.Matrix:
    """match and mismatch over an alphabet; any other symbol, shown as *, scores 0."""
    alphabet = alphabet if case_sensitive else alphabet.upper()
    n = len(alphabet)
    grid = [[(match if i == j else mismatch) for j in range(n)] + [0] for i in range(n)] + [[0] * (n + 1)]
    return matrices.Matrix("custom" if case_sensitive else "custom, upper case", alphabet + "*", grid, "*")


def _align(s1: str, s2: str, open: int, extend: int, matrix: matrices.Matrix, local: bool, what: str) -> Result:
    if open <= 0 or extend <= 0:
        raise ValueError("gap penalties are positive here")
    if matrix.alphabet == matrix.alphabet.upper():
        s1, s2 = s1.upper(), s2.upper()
    last = lambda begin, end: end - 1 if end > begin else -1
    if what == "score" and not local:
        return Result(int(matrix.scores_of([s1], [s2], local, -open, -extend)[0]), last(0, len(s1)), last(0, len(s2)))
    p = matrix.path(s1, s2, local, -open, -extend)
    end = {"score": p["score"], "end_query": last(p["query_start"], p["query_end"]), "end_ref": last(p["target_start"], p["target_end"])}
    if what == "score":
        return Result(**end)
    pairs = [(a, b) for a, b in zip(p["aligned_query"], p["aligned_target"])]
    if what == "stats":
        same = [a == b for a, b in pairs]
        near = [op in "=X" and matrix.scores[matrix.encode(a)[0], matrix.encode(b)[0]] > 0 for (a, b), op in zip(pairs, p["operations"])]
        return Result(**end, matches=sum(same), similar=sum(x or y for x, y in zip(same, near)), length=len(pairs))
    comp = "".join(" " if "-" in (a, b) else "|" if a == b else "." for a, b in pairs)
    return Result(**end, cigar=Cigar(p["cigar"], p["query_start"], p["target_start"]), query=p["aligned_query"], comp=comp, ref=p["aligned_target"])


def sw(s1: str, s2: str, open: int, extend: int, matrix: matrices.Matrix) -> Result:
    return _align(s1, s2, open, extend, matrix, True, "score")


def sw_trace(s1: str, s2: str, open: int, extend: int, matrix: matrices.Matrix) -> Result:
    return _align(s1, s2, open, extend, matrix, True, "trace")


def sw_stats(s1: str, s2: str, open: int, extend: int, matrix: matrices.Matrix) -> Result:
    return _align(s1, s2, open, extend, matrix, True, "stats")


def nw(s1: str, s2: str, open: int, extend: int, matrix: matrices.Matrix) -> Result:
    return _align(s1, s2, open, extend, matrix, False, "score")


def nw_trace(s1: str, s2: str, open: int, extend: int, matrix: matrices.Matrix) -> Result:
    return _align(s1, s2, open, extend, matrix, False, "trace")


def nw_stats(s1: str, s2: str, open: int, extend: int, matrix: matrices.Matrix) -> Result:
    return _align(s1, s2, open, extend, matrix, False, "stats")


sg, sg_trace, sg_stats = sw, sw_trace, sw_stats
