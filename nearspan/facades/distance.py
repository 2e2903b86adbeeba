"""Metrics with four methods each, and edit operations."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from nearspan.functions import batch, paths, text


class Metric:
    """distance and similarity are whole numbers or fractions of ``most``; the normalised ones lie between 0 and 1."""

    def __init__(self, distance: Callable[[str, str], float], most: Callable[[str, str], float]):
        self._distance, self._most = distance, most

    def _ready(self, s1, s2, processor):
        return (processor(s1), processor(s2)) if processor else (s1, s2)

    def distance(self, s1: str, s2: str, processor: Callable | None = None, score_cutoff: float | None = None):
        """Above the cutoff: cutoff + 1."""
        d = self._distance(*self._ready(s1, s2, processor))
        return d if score_cutoff is None or d <= score_cutoff else score_cutoff + 1

    def similarity(self, s1: str, s2: str, processor: Callable | None = None, score_cutoff: float | None = None):
        """Below the cutoff: 0."""
        a, b = self._ready(s1, s2, processor)
        s = self._most(a, b) - self._distance(a, b)
        return s if score_cutoff is None or s >= score_cutoff else 0

    def normalized_distance(self, s1: str, s2: str, processor: Callable | None = None, score_cutoff: float | None = None) -> float:
        """Above the cutoff: 1."""
        a, b = self._ready(s1, s2, processor)
        most = self._most(a, b)
        d = self._distance(a, b) / most if most else 0.0
        return d if score_cutoff is None or d <= score_cutoff else 1.0

    def normalized_similarity(self, s1: str, s2: str, processor: Callable | None = None, score_cutoff: float | None = None) -> float:
        s = 1.0 - self.normalized_distance(s1, s2, processor)
        return s if score_cutoff is None or s >= score_cutoff else 0.0


_longest = lambda a, b: max(len(a), len(b))
_one = lambda kernel, *o: lambda a, b: int(kernel([a], [b], *o)[0])

Levenshtein = Metric(_one(batch.levenshtein), _longest)
Indel = Metric(lambda a, b: len(a) + len(b) - 2 * text.lcs_bits(a, b), lambda a, b: len(a) + len(b))
Hamming = Metric(_one(batch.hamming, "pad"), _longest)
Jaro = Metric(lambda a, b: 1.0 - float(batch.jaro([a], [b])[0]), lambda a, b: 1.0)
JaroWinkler = Metric(lambda a, b: 1.0 - float(batch.jaro_winkler([a], [b])[0]), lambda a, b: 1.0)
DamerauLevenshtein = Metric(_one(batch.true_damerau_levenshtein), _longest)
OSA = Metric(_one(batch.osa), _longest)
LCSseq = Metric(lambda a, b: max(len(a), len(b)) - text.lcs_bits(a, b), _longest)

_TAGS = {"=": "equal", "X": "replace", "I": "insert", "D": "delete"}


def _operations(s1: str, s2: str) -> str:
    return paths.align(s1, s2, False, match=0, mismatch=-1, gap_open=-1)["operations"]


def editops(s1: str, s2: str) -> list[tuple[str, int, int]]:
    """(tag, place in s1, place in s2) of each replacement, insertion and deletion of a shortest edit script."""
    out, i, j = [], 0, 0
    for op in _operations(s1, s2):
        if op != "=":
            out.append((_TAGS[op], i, j))
        i, j = i + (op != "I"), j + (op != "D")
    return out


def opcodes(s1: str, s2: str) -> list[tuple[str, int, int, int, int]]:
    """(tag, begin and end in s1, begin and end in s2) of each run of one operation."""
    out, i, j = [], 0, 0
    for op, run in groupby(_operations(s1, s2)):
        n = len(list(run))
        m, k = i + n * (op != "I"), j + n * (op != "D")
        out.append((_TAGS[op], i, m, j, k))
        i, j = m, k
    return out
