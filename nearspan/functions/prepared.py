"""A query that is scored against many targets: prepared once, for lists and for columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearspan.functions.scorers import Options, Scorer, scorer


@dataclass(frozen=True)
class LevenshteinScorer:
    """The normalised forms are similarities: 1 is the query itself. Cutoffs: see the functions of one pair."""

    query: str

    def distances(self, targets: Sequence[str], cutoff: int | None = None) -> np.ndarray:
        found = scorer("levenshtein").pairs([self.query] * len(targets), list(targets))
        return found if cutoff is None else np.minimum(found, cutoff + 1)

    def normalized_distances(self, targets: Sequence[str], cutoff: float | None = None) -> np.ndarray:
        found = scorer("levenshtein_normalized").pairs([self.query] * len(targets), list(targets))
        return found if cutoff is None else np.where(found >= cutoff, found, 0.0)

    def distance(self, target: str, cutoff: int | None = None) -> int:
        return int(self.distances([target], cutoff)[0])

    def normalized_distance(self, target: str, cutoff: float | None = None) -> float:
        return float(self.normalized_distances([target], cutoff)[0])

    def column(self, targets: Column, normalized: bool = False) -> Column:
        return scorer("levenshtein_normalized" if normalized else "levenshtein").column(F.lit(self.query), targets)


#: Names of the variants that Scores takes.
_VARIANTS = {"sw": "smith_waterman", "local": "smith_waterman", "farrar": "smith_waterman", "nw": "needleman_wunsch", "global": "needleman_wunsch"}


class Scores:
    """Alignment scores of one query: compare(targets) for lists, column(targets) for columns."""

    def __init__(self, query: str, variant: str = "sw", match: int = 2, mismatch: int = -1, gap_open: int = -1, gap_extend: int | None = None):
        self.query, self.options = query, Options(match=match, mismatch=mismatch, gap_open=gap_open, gap_extend=gap_extend)
        self.scorer: Scorer = scorer(_VARIANTS.get(variant.lower(), variant))

    def compare(self, targets: Sequence[str]) -> np.ndarray:
        return self.scorer.pairs([self.query] * len(targets), list(targets), self.options)

    def column(self, targets: Column) -> Column:
        return self.scorer.column(F.lit(self.query), targets, self.options)
