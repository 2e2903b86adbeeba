"""What each SQL function does to lists of values. Optional arguments come after the lists, one value for all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from nearspan.functions import batch, dtw, matrices, paths, phonetic, text
from nearspan.functions.arrow import flattened
from nearspan.functions.beider_morse import beider_morse
from nearspan.functions.scorers import Options, Scorer, scorer

MATCH = "struct<target: string, score: {}, index: bigint>"
PAIR = "struct<score: double, query: string, target: string, query_index: bigint, target_index: bigint>"
PER_QUERY = "struct<query: string, query_index: bigint, matches: array<struct<score: double, target: string, target_index: bigint>>>"


def options_of(found: Scorer, values: Sequence) -> Options:
    """Positional options: match, mismatch, gap_open[, gap_extend] of alignments; weight, threshold, cap of Jaro-Winkler."""
    names = ("weight", "threshold", "cap") if found.name == "jaro_winkler" else ("match", "mismatch", "gap_open", "gap_extend")
    return Options(**dict(zip(names, values)))


def pair(name: str):
    found = scorer(name)
    return lambda a, b, *o: found.pairs(a, b, options_of(found, o))


def pair_with_cutoff(name: str):
    """Distances above the cutoff are cutoff + 1; similarities below it 0."""
    found = scorer(name)

    def run(a, b, cutoff=None):
        out = found.pairs(a, b)
        if cutoff is None:
            return out
        return np.where(out >= cutoff, out, 0.0) if found.similarity else np.minimum(out, int(cutoff) + 1)

    return run


def affine(local: bool):
    return lambda a, b, match=2, mismatch=-1, gap_open=-2, gap_extend=-1: batch.alignment(a, b, local, None, match, mismatch, gap_open, gap_extend)


def many(kernel):
    """The one-to-many form of a kernel."""
    return lambda queries, targets, *o: flattened(kernel, queries, targets, *o)


def scores(queries, targets, name):
    return many(lambda a, b: scorer(name).pairs(a, b).astype(float))(queries, targets)


def extract(queries, targets, name, k=5):
    sign = -1 if scorer(name).similarity else 1
    out = []
    for ts, row in zip(targets, scores(queries, targets, name)):
        order = sorted((sign * s, i) for i, s in enumerate(row) if s is not None)[:k]
        out.append([{"target": ts[i], "score": row[i], "index": i} for _, i in order])
    return out


def extract_best(queries, targets, name):
    return [next(iter(x), None) for x in extract(queries, targets, name, 1)]


def grid(kernel, queries: list, targets: list) -> list[list]:
    """Of one row: kernel over all pairs; null elements give nulls."""
    rows = flattened(kernel, [q for q in queries if q is not None], [targets] * sum(q is not None for q in queries))
    it = iter(rows)
    return [[None] * len(targets) if q is None else next(it) for q in queries]


def _pairs(kernel, queries, targets):
    table = grid(kernel, queries, targets)
    return [{"score": float(s), "query": queries[i], "target": targets[j], "query_index": i, "target_index": j} for i, row in enumerate(table) for j, s in enumerate(row) if s is not None]


def cdist(queries, targets, name, *o):
    found = scorer(name)
    kernel = lambda a, b: found.pairs(a, b, options_of(found, o)).astype(float)
    return [grid(kernel, q, t) for q, t in zip(queries, targets)]


def cdist_above_threshold(queries, targets, name, threshold, *o):
    found = scorer(name)
    if not found.normalized or not 0 <= threshold <= 1:
        raise ValueError("a threshold within [0, 1] and a normalised scorer are needed")
    kernel = lambda a, b: found.pairs(a, b, options_of(found, o))
    return [[p for p in _pairs(kernel, q, t) if p["score"] >= threshold] for q, t in zip(queries, targets)]


def cdist_top_k(queries, targets, name, k, reject_duplicates=False, *o):
    found = scorer(name)
    sign = -1 if found.similarity else 1
    kernel = lambda a, b: found.pairs(a, b, options_of(found, o))
    out = []
    for q, t in zip(queries, targets):
        rows = [p for p in _pairs(kernel, q, t) if not (reject_duplicates and p["query"] == p["target"])]
        out.append(sorted(rows, key=lambda p: (sign * p["score"], p["query_index"], p["target_index"]))[:k])
    return out


def cdist_top_k_per_query(queries, targets, name, k=5, pruning=True, *o):
    found = scorer(name)
    sign, chosen = -1 if found.similarity else 1, options_of(found, o)
    if found.name.startswith("hamming"):
        chosen = Options(on_length_mismatch="skip")
    out = []
    for qs, ts in zip(queries, targets):
        table = grid(lambda a, b: found.pairs(a, b, chosen).astype(float), qs, ts)
        keep = lambda s: s is not None and not (chosen.on_length_mismatch == "skip" and s < 0)
        nearest = [sorted((sign * s, j) for j, s in enumerate(row) if keep(s))[:k] for row in table]
        out.append([{"query": q, "query_index": i, "matches": [{"score": sign * s, "target": ts[j], "target_index": j} for s, j in row]} for i, (q, row) in enumerate(zip(qs, nearest))])
    return out


def each(function):
    """A kernel of two strings, pair by pair."""
    return lambda a, b, *o: [function(x, y, *o) for x, y in zip(a, b)]


def alone(function):
    """A kernel of one string; repeats are computed once."""

    def run(a, *o):
        found = {x: function(x, *o) for x in set(a)}
        return [found[x] for x in a]

    return run


def ngram(metric: str):
    return each(lambda a, b, n=2: text.ngram_similarity(a, b, n, metric))


def equal(code):
    """Codes are the same, and not empty."""

    def run(a, b, *o):
        return [bool(c) and c == code(y, *o) for c, y in ((code(x, *o), y) for x, y in zip(a, b))]

    return run


def path(local: bool, field: str | None = None):
    def one(a, b, match=2, mismatch=-1, gap_open=-1, gap_extend=None):
        found = paths.align(a, b, local, match, mismatch, gap_open, gap_extend)
        return found[field] if field else found

    return each(one)


@lru_cache(maxsize=64)
def _named(name: str, directory: str | None) -> matrices.Matrix:
    return matrices.load(name, directory)


def matrix_of(value, directory: str | None = None) -> matrices.Matrix:
    return value if isinstance(value, matrices.Matrix) else _named(value, directory) if isinstance(value, str) else matrices.Matrix.of(value)


def matrix_score(local: bool, directory: str | None):
    return lambda a, b, m, gap_open=-1, gap_extend=None: matrix_of(m, directory).scores_of(a, b, local, gap_open, gap_extend)


def matrix_path(local: bool, directory: str | None, field: str | None = None):
    def run(a, b, m, gap_open=-1, gap_extend=None):
        found = [matrix_of(m, directory).path(x, y, local, gap_open, gap_extend) for x, y in zip(a, b)]
        return [f[field] for f in found] if field else found

    return run


def matrix_grid(local: bool, directory: str | None):
    score = matrix_score(local, directory)
    return lambda queries, targets, m, *gaps: [grid(lambda a, b: score(a, b, m, *gaps), q, t) for q, t in zip(queries, targets)]


def matrix_above_threshold(directory: str | None):
    def run(queries, targets, m, local, threshold, *gaps):
        score = matrix_score(local, directory)
        return [[p for p in _pairs(lambda a, b: score(a, b, m, *gaps), q, t) if p["score"] >= threshold] for q, t in zip(queries, targets)]

    return run


def matrix_top_k(directory: str | None):
    def run(queries, targets, m, local, k, *gaps):
        score = matrix_score(local, directory)
        order = lambda p: (-p["score"], p["query_index"], p["target_index"])
        return [sorted(_pairs(lambda a, b: score(a, b, m, *gaps), q, t), key=order)[:k] for q, t in zip(queries, targets)]

    return run


def built(function):
    """A kernel that gives matrices as rows."""
    return lambda a, *o: [function(x, *o).row() for x in a]


def substitution_matrix(name, alphabet, grid, gap_score=-4, wildcard=None, gap_open=None, gap_extend=None):
    wildcard = wildcard or ("X" if "X" in alphabet else alphabet[-1])
    return matrices.Matrix(name, alphabet, grid, wildcard, gap_score, gap_open, gap_extend)


def double_metaphone(s, max_length=64, variant=0):
    return dict(zip(("primary", "alternate"), phonetic.double_metaphone(s, max_length, variant)))


def beider(directory: str | None):
    def run(s, rule_type=0, concat=True, max_phonemes=20):
        if not directory:
            raise ValueError("no rule files: pass the directory that has them when functions are registered")
        return beider_morse(s, directory, rule_type, concat, max_phonemes)

    return alone(run)


def dtw_pairs(queries, targets, window=None, distance=None, cutoff=None):
    """window: a whole number is a radius, a fraction below 1 a share of the longer series."""
    share = window is not None and 0 < window < 1
    return dtw.dtw(queries, targets, None if share or window is None else int(window), distance or "l2_squared", cutoff, window if share else None)


def dtw_many(queries, targets, *o):
    return many(dtw_pairs)(queries, targets, *o)
