"""Extraction and grids over Python lists or mappings, run as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.facades import fuzz
from nearspan.functions.arrow import pairwise
from nearspan.operators.joins import dedupe as _dedupe
from nearspan.functions.scorers import Options, scorer as named_scorer


def _frame(spark: SparkSession, choices) -> tuple[DataFrame, list]:
    keys = list(choices) if isinstance(choices, Mapping) else list(range(len(choices)))
    values = [choices[k] for k in keys]
    return spark.createDataFrame(list(enumerate(values)), "i long, choice string"), keys


def _scored(spark: SparkSession, query: str, choices, scorer, processor, score_cutoff) -> tuple[DataFrame, list, bool]:
    frame, keys = _frame(spark, choices)
    found = scorer if callable(scorer) else fuzz.SCORERS.get(scorer) or named_scorer(scorer)
    up = getattr(found, "similarity", True)
    ready = processor or (lambda s: s)
    if callable(found):
        score = pairwise(lambda a, b: [float(found(ready(x), ready(y))) for x, y in zip(a, b)], "double")
    else:
        score = pairwise(lambda a, b: np.asarray(found.pairs([ready(x) for x in a], [ready(x) for x in b], Options()), float), "double")
    rows = frame.where("choice is not null").withColumn("score", score(F.lit(query), F.col("choice")))
    if score_cutoff is not None:
        rows = rows.where(F.col("score") >= float(score_cutoff) if up else F.col("score") <= float(score_cutoff))
    return rows, keys, up


def extract(spark: SparkSession, query: str | None, choices: Sequence | Mapping, scorer: Callable | str = fuzz.w_ratio, processor: Callable[[str], str] | None = None, limit: int | None = 5, score_cutoff: float | None = None) -> list[tuple]:
    """(choice, score, key) of the best choices, best first, ties in their order; null choices are skipped."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    if query is None:
        return []
    rows, keys, up = _scored(spark, query, choices, scorer, processor, score_cutoff)
    rows = rows.orderBy(F.desc("score") if up else F.asc("score"), "i")
    return [(r["choice"], r["score"], keys[r["i"]]) for r in (rows if limit is None else rows.limit(limit)).collect()]


def extract_one(spark: SparkSession, query: str | None, choices, **how) -> tuple | None:
    return next(iter(extract(spark, query, choices, limit=1, **how)), None)


def extract_iter(spark: SparkSession, query: str, choices, scorer: Callable | str = fuzz.w_ratio, processor=None, score_cutoff: float | None = None) -> Iterator[tuple]:
    """(choice, score, key) in the order of the choices, a partition ahead at most."""
    rows, keys, _ = _scored(spark, query, choices, scorer, processor, score_cutoff)
    for r in rows.orderBy("i").toLocalIterator(prefetchPartitions=True):
        yield r["choice"], r["score"], keys[r["i"]]


def extract_rounded(spark: SparkSession, query: str | None, choices, scorer: Callable = fuzz.w_ratio, limit: int | None = 5, score_cutoff: int = 0, force_ascii: bool = True) -> list[tuple]:
    """As extract, ranked by the exact score of processed strings and reported in whole numbers, halves to even."""
    process = lambda s: fuzz.full_process(s, force_ascii)
    found = extract(spark, query, choices, scorer, process, limit)
    rounded = [(c, int(round(s)), k) for c, s, k in found]
    return [r for r in rounded if r[1] >= score_cutoff]


def cdist(spark: SparkSession, queries: Sequence, choices: Sequence, scorer: Callable | str = fuzz.ratio, processor=None, score_cutoff: float | None = None, score_multiplier: float = 1, dtype=np.float64) -> np.ndarray:
    """The grid of scores as an array; below the cutoff 0, null strings 0."""
    found = scorer if callable(scorer) else fuzz.SCORERS.get(scorer) or named_scorer(scorer)
    ready = processor or (lambda s: s)
    q = spark.createDataFrame(list(enumerate(queries)), "qi long, q string").where("q is not null")
    c = spark.createDataFrame(list(enumerate(choices)), "ci long, c string").where("c is not null")
    call = (lambda a, b: [float(found(ready(x), ready(y))) for x, y in zip(a, b)]) if callable(found) else (lambda a, b: np.asarray(found.pairs([ready(x) for x in a], [ready(x) for x in b]), float))
    rows = q.crossJoin(c).select("qi", "ci", pairwise(call, "double")(F.col("q"), F.col("c")).alias("s"))
    out = np.zeros((len(queries), len(choices)), dtype)
    for r in rows.toLocalIterator(prefetchPartitions=True):
        s = r["s"] if score_cutoff is None or r["s"] >= score_cutoff else 0.0
        out[r["qi"], r["ci"]] = round(s * score_multiplier) if np.issubdtype(dtype, np.integer) else s * score_multiplier
    return out


def dedupe(spark: SparkSession, items: Sequence[str], threshold: float = 70, scorer: Callable[[str, str], float] = fuzz.rounded(fuzz.token_set_ratio)) -> list[str]:
    """For each item the longest of those alike; the items as they were if nothing collapses."""
    frame = spark.createDataFrame([(s,) for s in items], "item string")
    kept = {r[0] for r in _dedupe(frame, "item", scorer, threshold).collect()}
    return list(items) if len(kept) == len(items) else sorted(kept)
