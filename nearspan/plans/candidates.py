"""Candidate pairs of strings for a similarity of at least t, as equi-joins.

By segments: d edits leave one of d + 1 segments of a string as it is, so two strings that are near share a segment. It
is looked for only where it can lie if, of the segments before it, each took an edit, and so each after it; some segment
that is shared lies so. By lengths: the lengths of two strings bound their similarity, so each length meets those that it
can be similar to. Both are complete: no pair that reaches t is missed. Where many strings share their segments, more
pairs would meet by these than by their lengths; the counts of both are compared first.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearspan.functions.scorers import Options, Scorer

#: Edits of Levenshtein's kind that one unit of a scorer's distance may stand for; absent: no such bound.
_EDITS = {"levenshtein_normalized": 1, "damerau_levenshtein_normalized": 2, "true_damerau_levenshtein_normalized": 2, "indel_normalized": 1}
#: Below this similarity segments are too short to tell strings apart.
LEAST_FOR_SEGMENTS = 0.6
_SLACK = 1e-9
#: Pairs of a join by blocks that take the time of a key of a segment, and of a meeting of two keys.
BOUNDS_A_KEY, BOUNDS_A_MEETING = 100, 500


def by_segments(scorer: Scorer, t: float) -> bool:
    return scorer.name in _EDITS and t >= LEAST_FOR_SEGMENTS


def _edits(n: Column, scorer: Scorer, t: float) -> Column:
    """Most edits between a string of length n and any that reaches t with it."""
    if scorer.name == "indel_normalized":
        most = n * (2 * (1 - t) / t)
    else:
        most = F.floor(n / t + _SLACK) * (1 - t)
    return (F.floor(most + 1e-6) * _EDITS[scorer.name]).cast("int")


def _partners(m: Column, scorer: Scorer, t: float) -> tuple[Column, Column]:
    """Shortest and longest string that can reach t with one of length m."""
    if scorer.name == "indel_normalized":
        return F.ceil(m * (t / (2 - t)) - 1e-6).cast("int"), F.floor(m * ((2 - t) / t) + 1e-6).cast("int")
    return F.ceil(m * t - 1e-6).cast("int"), F.floor(m / t + 1e-6).cast("int")


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def _segments(n: Column, k: Column) -> tuple:
    """Length of the i-th of k segments of n characters, and its place from 1: the last n % k have one more."""
    base, more = F.floor(n / k).cast("int"), n % k
    size = lambda i: base + (i >= k - more).cast("int")
    start = lambda i: i * base + F.greatest(F.lit(0), i - (k - more)) + 1
    return size, start


def _key(n: Column, i: Column, s: Column) -> Column:
    return F.xxhash64(n.cast("int"), i.cast("int"), s)


def _target_keys(s: Column, scorer: Scorer, t: float) -> Column:
    n = F.length(s)
    k = _edits(n, scorer, t) + 1
    size, start = _segments(n, k)
    keys = F.transform(_range(F.lit(0), k - 1), lambda i: _key(n, i, F.substr(s, start(i), size(i))))
    return F.when(k > n, F.array(_key(n, F.lit(-1), F.lit("")))).otherwise(F.array_distinct(keys))


def _query_keys(s: Column, scorer: Scorer, t: float) -> Column:
    m = F.length(s)
    low, high = _partners(m, scorer, t)

    def of_length(n: Column) -> Column:
        d = _edits(n, scorer, t)
        k = d + 1
        size, start = _segments(n, k)

        def of_segment(i: Column) -> Column:
            shift = m - n
            low_at = F.greatest(F.lit(1), start(i) - i, start(i) + shift - (d - i))
            at = _range(low_at, F.least(m - size(i) + 1, start(i) + i, start(i) + shift + (d - i)))
            return F.transform(at, lambda p: _key(n, i, F.substr(s, p, size(i))))

        keys = F.flatten(F.transform(_range(F.lit(0), k - 1), of_segment))
        return F.when(k > n, F.array(_key(n, F.lit(-1), F.lit("")))).otherwise(keys)

    return F.array_distinct(F.flatten(F.transform(_range(low, high), of_length)))


def _meetings(a: DataFrame, b: DataFrame) -> float:
    """Rows of the join of keys, which counts of each key tell."""
    x, y = a.groupBy("key").agg(F.count("*").alias("x")), b.groupBy("key").agg(F.count("*").alias("y"))
    return x.join(y, "key").agg(F.sum(F.col("x").cast("double") * F.col("y"))).first()[0] or 0.0


def _pairs_of_lengths(queries: DataFrame, targets: DataFrame, scorer: Scorer, t: float, options: Options) -> float:
    """Pairs whose lengths alone let them reach t."""
    a, b = queries.groupBy(F.length("query").alias("m")).agg(F.count("*").alias("x")), targets.groupBy(F.length("target").alias("n")).agg(F.count("*").alias("y"))
    both = a.crossJoin(b).where(scorer.length_bound(F.col("m"), F.col("n"), options) >= t - _SLACK)
    return both.agg(F.sum(F.col("x").cast("double") * F.col("y"))).first()[0] or 0.0


def _keys(queries: DataFrame, targets: DataFrame, scorer: Scorer, t: float) -> tuple[DataFrame, DataFrame]:
    a = queries.select("query", F.explode(_query_keys(F.col("query"), scorer, t)).alias("key"))
    return a, targets.select("target", F.explode(_target_keys(F.col("target"), scorer, t)).alias("key"))


def blocks_cost_less(queries: DataFrame, targets: DataFrame, size: tuple[int, int, int], scorer: Scorer, t: float, options: Options = Options()) -> bool:
    """Whether a look at all pairs by bounds (plans.blocks) is cheaper than segments. size: numbers of both, and the longest string."""
    if not by_segments(scorer, t):
        return True
    # A string has about so many keys, each of which costs as much as some hundred bounds: few targets are looked at sooner.
    d = (1.0 - t) * size[2] / t
    if size[1] <= BOUNDS_A_KEY * 2 * (d + 1) ** 3:
        return True
    return _meetings(*_keys(queries, targets, scorer, t)) * BOUNDS_A_MEETING > _pairs_of_lengths(queries, targets, scorer, t, options)


def candidates(queries: DataFrame, targets: DataFrame, scorer: Scorer, t: float, options: Options = Options(), compare: bool = True) -> DataFrame:
    """Distinct (query) and (target) strings -> distinct (query, target) pairs that include all that reach t.

    Without compare segments are taken where there are any, and not compared with lengths.
    """
    if t <= 0:
        return queries.crossJoin(targets)
    if by_segments(scorer, t):
        a, b = _keys(queries, targets, scorer, t)
        if not compare or _meetings(a, b) <= _pairs_of_lengths(queries, targets, scorer, t, options):
            pairs = a.join(b, "key").select("query", "target")
            bound = scorer.length_bound(F.length("query"), F.length("target"), options)
            return pairs.where(bound >= t - _SLACK).distinct()
    bound = scorer.length_bound(F.col("m"), F.col("n"), options)
    if bound is None:
        return queries.crossJoin(targets)
    a, b = queries.withColumn("m", F.length("query")), targets.withColumn("n", F.length("target"))
    # As many rows as there are pairs of lengths.
    lengths = a.select("m").distinct().crossJoin(b.select("n").distinct()).where(bound >= t - _SLACK)
    pairs = a.join(lengths, "m").join(b, "n").select("query", "target")
    if scorer.name in ("jaro", "jaro_winkler"):
        most = _shared_bound(F.col("query"), F.col("target"))
        if scorer.name == "jaro_winkler":
            most = F.when(most >= options.threshold, most + options.cap * options.weight * (1.0 - most)).otherwise(most)
        pairs = pairs.where(most >= t - _SLACK)
    return pairs


def _shared_bound(a: Column, b: Column) -> Column:
    """Jaro's score if every character that both have were a match in place."""
    met = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    c = F.least(met(a, b), met(b, a))
    m, n = F.length(a), F.length(b)
    return F.when((m == 0) & (n == 0), 1.0).when(c == 0, 0.0).otherwise((c / m + c / n + 1.0) / 3.0)


def distance_cutoff(t: float, most: int) -> int:
    """Largest distance that leaves a similarity of t, of ``most`` at most."""
    return most if t <= 0 else 0 if t >= 1 else floor((1 - t) * most + _SLACK)
