"""Ratios from 0 to 100, as two families of fuzzy-matching libraries give them.

Functions here score one pair; column() makes any of them a column function, and the joins take them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearspan.functions import text
from nearspan.functions.arrow import pairwise


def default_process(s: str) -> str:
    """Each character but ASCII letters and digits becomes a space; lower case, stripped."""
    return re.sub("[^A-Za-z0-9]", " ", s).lower().strip()


def full_process(s: str, force_ascii: bool = False) -> str:
    """Letters and digits of any script stay; force_ascii deletes U+0080 to U+00FF first."""
    s = re.sub("[\x80-\xff]", "", s) if force_ascii else s
    return "".join(c if c.isalnum() else " " for c in s).lower().strip()


def process_column(c: Column) -> Column:
    """default_process by built-in functions."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", " ")), "^ +| +$", "")


def _scaled(raw: Callable[[str, str], float], empty: float | None = None) -> Callable:
    def ratio(s1: str | None, s2: str | None, processor: Callable[[str], str] | None = None, score_cutoff: float = 0) -> float:
        if s1 is None or s2 is None:
            return 0.0
        a, b = (processor(s1), processor(s2)) if processor else (s1, s2)
        score = 100.0 * (empty if empty is not None and not (a and b) else raw(a, b))
        return score if score >= (score_cutoff or 0) else 0.0

    return ratio


ratio = _scaled(text.indel_ratio)
partial_ratio = _scaled(text.partial_ratio)
token_sort_ratio = _scaled(text.token_sort_ratio)
token_set_ratio = _scaled(text.token_set_ratio)
partial_token_sort_ratio = _scaled(text.partial_token_sort_ratio)
partial_token_set_ratio = _scaled(text.partial_token_set_ratio)
token_ratio = _scaled(lambda a, b: max(text.token_sort_ratio(a, b), text.token_set_ratio(a, b)))
partial_token_ratio = _scaled(lambda a, b: max(text.partial_token_sort_ratio(a, b), text.partial_token_set_ratio(a, b)))
q_ratio = _scaled(text.indel_ratio, 0.0)
w_ratio = _scaled(text.fuzz_wratio)

SCORERS = {
    "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "partial_token_sort_ratio": partial_token_sort_ratio,
    "partial_token_set_ratio": partial_token_set_ratio, "token_ratio": token_ratio, "partial_token_ratio": partial_token_ratio, "QRatio": q_ratio, "WRatio": w_ratio,
}


def rounded(function: Callable[[str, str], float], force_ascii: bool = True, process: bool = True) -> Callable[[str | None, str | None], int]:
    """A ratio as a whole number, halves to even; null or, once processed, empty strings score 0."""

    def score(s1: str | None, s2: str | None) -> int:
        if s1 is None or s2 is None:
            return 0
        a, b = (full_process(s1, force_ascii), full_process(s2, force_ascii)) if process else (s1, s2)
        if process and not (a and b):
            return 0
        return int(round(function(a, b)))

    return score


def column(function: Callable[[str, str], float], a: Column, b: Column, returns: str = "double") -> Column:
    kind = int if returns in ("int", "long") else float
    return pairwise(lambda x, y: [kind(function(p, q)) for p, q in zip(x, y)], returns)(a, b)
