"""Joins by blocks against every pair's distance."""

import random

import numpy as np
import pytest
from nearspan.functions import batch
from nearspan.operators import joins
from nearspan.plans import blocks

HOW = {"query": "s", "target": "s", "query_index": "k", "target_index": "k"}


def strings(alphabet, low, high, n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.fixture(scope="module")
def urls():
    """Of few parts, so that segments of all are alike."""
    rng = random.Random(7)
    made = [f"https://{rng.choice(['m.', 'blog.', ''])}{rng.choice(['thing', 'thon'])}.example.{rng.choice(['com', 'org'])}/en/{rng.randint(0, 9999)}{rng.choice(['', '.html', '#top'])}" for _ in range(150)]
    odd = ["", "é", "a😀b", "a😀c", "x" * 63, "x" * 64, "x" * 65 + "y", "x" * 130, "x" * 129 + "z", None]
    return list(enumerate(made + odd + made[:3]))


def scored(rows):
    pairs = [(i, j, a, b) for i, a in rows for j, b in rows if a is not None and b is not None]
    d = batch.levenshtein([p[2] for p in pairs], [p[3] for p in pairs])
    return [(i, j, 1.0 - x / most if (most := max(len(a), len(b))) else 1.0) for (i, j, a, b), x in zip(pairs, d.tolist())]


@pytest.mark.parametrize("alphabet,low,high", [("ab", 0, 9), ("abcdeé😀", 0, 70), ("abc", 60, 200), ("".join(map(chr, range(300, 500))), 0, 40)])
def test_distances_and_bounds(alphabet, low, high):
    a, b = strings(alphabet, low, high, 40), strings(alphabet, low, high, 30, 4)
    b += a[:5] + [x[1:] + "a" for x in a[5:10]]
    pair = blocks.Pair(a, b)
    i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    want = batch.levenshtein([a[pair.q.order[x]] for x in i], [b[pair.t.order[y]] for y in j])
    assert pair.distances(i, j).tolist() == want.tolist()
    assert (np.concatenate([pair.bounds(x, 0, len(b)) for x in range(len(a))]) <= want).all()


@pytest.mark.parametrize("t", [0.3, 0.85, 1.0])
def test_threshold_needs_no_keys(spark, urls, monkeypatch, t):
    """URLs have more keys of segments than there are pairs of them."""
    def no_keys(*_):
        raise AssertionError("keys of segments")

    monkeypatch.setattr("nearspan.plans.candidates._query_keys", no_keys)
    for name, most in (("QUERIES", 50), ("TARGETS", 60)):
        monkeypatch.setattr(blocks, name, most)
    frame = spark.createDataFrame(urls, "k long, s string")
    got = joins.above_threshold(frame, frame, "levenshtein_normalized", t, **HOW)
    assert sorted((r.query_index, r.target_index, r.score) for r in got.collect()) == sorted(x for x in scored(urls) if x[2] >= t)


@pytest.mark.parametrize("k", [1, 4, 500])
def test_nearest_look_at_no_cross_join(spark, urls, monkeypatch, k):
    for name, most in (("QUERIES", 50), ("TARGETS", 60), ("BOUNDS", 200)):
        monkeypatch.setattr(blocks, name, most)
    frame = spark.createDataFrame(urls, "k long, s string")
    got = joins.top_k_per_query(frame, frame, "levenshtein_normalized", k, **HOW)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    want = {}
    for i, j, score in sorted(scored(urls), key=lambda x: (x[0], -x[2], x[1])):
        want.setdefault(i, []).append((j, score))
    assert sorted((r.query_index, r["rank"], r.target_index, r.score) for r in got.collect()) == sorted((i, rank, j, s) for i, found in want.items() for rank, (j, s) in enumerate(found[:k], 1))


def test_no_rows(spark):
    frame = spark.createDataFrame([(1, "a")], "k long, s string")
    none = frame.limit(0)
    for a, b in ((none, frame), (frame, none), (none, none)):
        assert joins.above_threshold(a, b, "levenshtein_normalized", 0.5, **HOW).count() == 0
        assert joins.top_k_per_query(a, b, "levenshtein_normalized", 2, **HOW).count() == 0


def test_many_targets_still_meet_by_segments(spark, urls, monkeypatch):
    monkeypatch.setattr("nearspan.plans.candidates.BOUNDS_A_KEY", 0)
    monkeypatch.setattr("nearspan.plans.candidates.BOUNDS_A_MEETING", 0)
    frame = spark.createDataFrame(urls[:40] + urls[150:], "k long, s string")
    got = joins.above_threshold(frame, frame, "levenshtein_normalized", 0.9, **HOW)
    assert sorted((r.query_index, r.target_index, r.score) for r in got.collect()) == sorted(x for x in scored(urls[:40] + urls[150:]) if x[2] >= 0.9)
