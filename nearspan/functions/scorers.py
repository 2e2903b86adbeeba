"""The scorers by name and number: how each scores many pairs, how large a score two lengths allow, and as a column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearspan.functions import batch
from nearspan.functions.arrow import pairwise


@dataclass(frozen=True)
class Options:
    match: int = 2
    mismatch: int = -1
    gap_open: int = -1
    gap_extend: int | None = None
    weight: float = 0.1
    threshold: float = 0.7
    cap: int = 4
    on_length_mismatch: str = "error"

    @property
    def affine(self) -> dict:
        return {"match": self.match, "mismatch": self.mismatch, "gap_open": self.gap_open, "gap_extend": self.gap_extend}

    @property
    def prefix(self) -> tuple:
        return self.weight, self.threshold, self.cap


def lengths(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)


def similar(distance: np.ndarray, most: np.ndarray) -> np.ndarray:
    """1 - distance / most; 1 where both are empty."""
    return np.where(most > 0, 1.0 - distance / np.maximum(most, 1), 1.0)


def _by_longest(kernel: Callable) -> Callable:
    return lambda a, b, o: similar(kernel(a, b, o), np.maximum(*lengths(a, b)))


def _hamming_similarity(a, b, o: Options) -> np.ndarray:
    d = batch.hamming(a, b, o.on_length_mismatch)
    return np.where(d < 0, np.nan, similar(d, np.maximum(*lengths(a, b))))


def _aligned(local: bool, whole: bool) -> Callable:
    def score(a, b, o: Options) -> np.ndarray:
        raw = batch.alignment(a, b, local, **o.affine)
        if whole:
            return raw
        if o.match <= 0:
            raise ValueError("match must be positive for a normalised alignment score")
        m, n = lengths(a, b)
        size = np.minimum(m, n) if local else np.maximum(m, n)
        return np.where(np.maximum(m, n) == 0, 1.0, np.where(size == 0, 0.0, np.clip(raw / (np.maximum(size, 1) * float(o.match)), 0.0, 1.0)))

    return score


def _shorter_over_longer(m: Column, n: Column, o: Options) -> Column:
    return F.when(F.greatest(m, n) == 0, 1.0).otherwise(F.least(m, n) / F.greatest(m, n, F.lit(1)))


def _indel_bound(m: Column, n: Column, o: Options) -> Column:
    return F.when(m + n == 0, 1.0).otherwise(2.0 * F.least(m, n) / F.greatest(m + n, F.lit(1)))


def _jaro_bound(m: Column, n: Column, o: Options) -> Column:
    some = (2.0 + F.least(m, n) / F.greatest(m, n, F.lit(1))) / 3.0
    return F.when(F.greatest(m, n) == 0, 1.0).when(F.least(m, n) == 0, 0.0).otherwise(some)


def _jaro_winkler_bound(m: Column, n: Column, o: Options) -> Column:
    j = _jaro_bound(m, n, o)
    return F.when(j >= o.threshold, j + F.least(F.lit(float(o.cap)), F.least(m, n)) * o.weight * (1.0 - j)).otherwise(j)


def _equal_lengths(m: Column, n: Column, o: Options) -> Column:
    return F.when(m == n, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class Scorer:
    number: int
    name: str
    kernel: Callable  # (list, list, Options) -> array
    similarity: bool  # larger is nearer
    bound: Callable | None = None  # largest score of two lengths
    normalized: bool = False

    def pairs(self, a: Sequence[str], b: Sequence[str], options: Options = Options()) -> np.ndarray:
        return self.kernel(a, b, options)

    def column(self, a: Column, b: Column, options: Options = Options()) -> Column:
        """The score as a column: built-in expressions where Spark has them, else one Arrow call."""
        if self.name == "levenshtein":
            return F.levenshtein(a, b).cast("long")
        if self.name == "levenshtein_normalized":
            most = F.greatest(F.length(a), F.length(b))
            return F.when(most == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / most)
        kernel = lambda x, y: self.kernel(x, y, options)
        return pairwise(kernel, "double" if self.similarity and self.normalized else "long")(a, b)

    def length_bound(self, m: Column, n: Column, options: Options = Options()) -> Column | None:
        return self.bound(m, n, options) if self.bound else None


def _scorers() -> list[Scorer]:
    distances = {
        "levenshtein": lambda a, b, o: batch.levenshtein(a, b), "damerau_levenshtein": lambda a, b, o: batch.osa(a, b),
        "true_damerau_levenshtein": lambda a, b, o: batch.true_damerau_levenshtein(a, b), "indel": lambda a, b, o: batch.indel(a, b),
        "hamming": lambda a, b, o: batch.hamming(a, b, o.on_length_mismatch),
    }
    ratio = lambda name: _by_longest(distances[name])
    return [
        Scorer(0, "levenshtein", distances["levenshtein"], False),
        Scorer(1, "levenshtein_normalized", ratio("levenshtein"), True, _shorter_over_longer, True),
        Scorer(2, "damerau_levenshtein", distances["damerau_levenshtein"], False),
        Scorer(3, "damerau_levenshtein_normalized", ratio("damerau_levenshtein"), True, _shorter_over_longer, True),
        Scorer(4, "hamming", distances["hamming"], False),
        Scorer(5, "hamming_normalized", _hamming_similarity, True, _equal_lengths, True),
        Scorer(6, "jaro", lambda a, b, o: batch.jaro(a, b), True, _jaro_bound, True),
        Scorer(7, "jaro_winkler", lambda a, b, o: batch.jaro_winkler(a, b, *o.prefix), True, _jaro_winkler_bound, True),
        Scorer(8, "indel", distances["indel"], False),
        Scorer(9, "indel_normalized", lambda a, b, o: similar(batch.indel(a, b), sum(lengths(a, b))), True, _indel_bound, True),
        Scorer(10, "true_damerau_levenshtein", distances["true_damerau_levenshtein"], False),
        Scorer(11, "true_damerau_levenshtein_normalized", ratio("true_damerau_levenshtein"), True, _shorter_over_longer, True),
        Scorer(12, "smith_waterman", _aligned(True, True), True),
        Scorer(13, "smith_waterman_normalized", _aligned(True, False), True, None, True),
        Scorer(14, "needleman_wunsch", _aligned(False, True), True),
        Scorer(15, "needleman_wunsch_normalized", _aligned(False, False), True, None, True),
    ]


SCORERS = {s.name: s for s in _scorers()}
_ALIASES = {"osa": "damerau_levenshtein", "osa_normalized": "damerau_levenshtein_normalized"}


def scorer(name: str | int | Scorer) -> Scorer:
    """By name (case, hyphens and a _score, _similarity or _distance ending don't matter), or by number."""
    if isinstance(name, Scorer):
        return name
    key = str(name).strip().lower().replace("-", "_").rpartition(".")[2].rpartition(":")[2]
    if key.isdigit():
        found = next((s for s in SCORERS.values() if s.number == int(key)), None)
    else:
        short = key
        for ending in ("_score", "_similarity", "_distance"):
            short = short.removesuffix(ending)
        found = next((SCORERS[n] for k in (key, short) if (n := _ALIASES.get(k, k)) in SCORERS), None)
    if found is None:
        raise ValueError(f"no scorer {name!r}; there are {', '.join(SCORERS)}")
    return found


def score(name: str | int | Scorer, a: Column, b: Column, **options) -> Column:
    return scorer(name).column(a, b, Options(**options))


def vector(name: str | int | Scorer, query: Column, targets: Column, **options) -> Column:
    """Scores of a query and each string of an array; null elements have null scores."""
    found, chosen = scorer(name), Options(**options)
    if found.name == "levenshtein":
        return F.when(query.isNotNull(), F.transform(targets, lambda t: F.levenshtein(query, t).cast("long")))
    from nearspan.functions.arrow import one_to_many

    kind = "double" if found.normalized else "long"
    return one_to_many(lambda x, y: found.kernel(x, y, chosen), kind)(query, targets)


def ranked(query: Column, targets: Column, scores: Column, similarity: bool, k: int = 5) -> Column:
    """Array of struct(target, score, index): the k nearest, ties to the smaller index; null scores are not there."""
    if k < 0:
        raise ValueError("k must not be negative")
    sign = -1 if similarity else 1
    rows = F.transform(scores, lambda s, i: F.struct((s * sign).alias("order"), i.cast("long").alias("index"), F.get(targets, i).alias("target"), s.alias("score")))
    best = F.slice(F.array_sort(F.filter(rows, lambda x: x["score"].isNotNull())), 1, k) if k else F.slice(rows, 1, 0)
    return F.transform(best, lambda x: F.struct(x["target"].alias("target"), x["score"].alias("score"), x["index"].alias("index")))


def top_k(name: str | int | Scorer, query: Column, targets: Column, k: int = 5, **options) -> Column:
    return ranked(query, targets, vector(name, query, targets, **options), scorer(name).similarity, k)


def best(name: str | int | Scorer, query: Column, targets: Column, **options) -> Column:
    """The nearest target as struct(target, score, index); null if there is none."""
    return F.get(top_k(name, query, targets, 1, **options), F.lit(0))


def as_arrow(values, kind: str) -> pa.Array:
    return pa.array(values, {"long": pa.int64(), "double": pa.float64()}[kind])
