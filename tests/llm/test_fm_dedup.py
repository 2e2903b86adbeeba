import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from nearspan.llm import fm_dedup
from nearspan.llm.fm_dedup import OP9_SQL, op9_substring_dedup, without_repeats
from nearspan.llm.fm_index import FMIndex

from .conftest import rows_of

SCHEMA = "doc_id long, text string, extra int, spans int"


def brute(texts, window=35):
    """{row: (n_words, n_removed, sha256)} by counting all windows."""
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, window=35):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in without_repeats(df, window).collect())
    want = sorted((i or 0, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], window)))
    assert got == want


def words(rng, n, vocabulary=10**6):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_passages_copies_nulls_and_ties(spark):
    rng = random.Random(3)
    passage, long = words(rng, 60), words(rng, 5000)
    rows = [(i, " ".join(words(rng, 100) + (passage if i % 3 == 0 else []) + words(rng, 50))) for i in range(30)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, " ".join(passage)), (104, " ".join(long)), (105, " ".join(long[1000:])), (106, " ".join(passage[:34])), (107, "a " * 500), (107, "a " * 500), (108, "é " * 40), (None, " ".join(words(rng, 90)))]
    rows += [(109, " ".join(["x"] * 35)), (110, " ".join(["x"] * 34)), (111, " ".join(passage[:35])), (112, " ".join(["p", *passage[5:45], "q"]))]
    check(spark, rows)


def test_small_vocabulary_and_window(spark):
    rng = random.Random(5)
    check(spark, [(i, " ".join(words(rng, rng.randrange(0, 120), 2))) for i in range(25)], 12)


def test_hot_anchor_is_dealt_out(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(fm_dedup, "HOT", 4)
    passage = words(rng, 45)
    check(spark, [(i, " ".join(words(rng, 20) + passage + words(rng, 20))) for i in range(40)])


def test_texts_meet_their_segments_once(spark, monkeypatch):
    rng, plans, cut = random.Random(8), [], fm_dedup.cut
    monkeypatch.setattr(fm_dedup, "HOT", 4)
    monkeypatch.setattr(fm_dedup, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    often, twice = words(rng, 45), words(rng, 80)
    rows = [(i, " ".join(words(rng, 20) + often + words(rng, 20) + (twice if i < 2 else []))) for i in range(20)]
    check(spark, rows + [(None, rows[0][1]), (3, rows[3][1])])
    assert sum("collect_list" in p for p in plans) == 1 and any("again" in p for p in plans)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf_dir, oracle):
    assert rows_of(op9_substring_dedup(spark, sf_dir)) == oracle(OP9_SQL)


def test_index_counts():
    rng = np.random.default_rng(1)
    segments = [rng.integers(0, 4, rng.integers(1, 60)).astype(np.uint64) for _ in range(50)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    index = FMIndex(np.concatenate(segments), starts)
    text = index.ids
    begin, end = starts[:-1], starts[1:] - 1
    first = index.leftmost(text, end.copy(), begin.copy())
    for k, s in enumerate(segments):
        def met(a):
            p = s[a:].tolist()
            return sum(t[i : i + len(p)].tolist() == p for t in segments for i in range(len(t) - len(p) + 1)) >= 2

        want = next((a for a in range(len(s)) if met(a)), len(s))
        assert first[k] - begin[k] == want


def test_long_segments_are_refused():
    with pytest.raises(ValueError):
        FMIndex(np.arange(64, dtype=np.uint64), np.array([0, 64]))


def test_weights_count_as_occurrences():
    rng = np.random.default_rng(4)
    segments = [rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint64) for _ in range(30)]
    weights = rng.integers(1, 3, 30)
    join = lambda parts: (np.concatenate(parts), np.concatenate([[0], np.cumsum([len(s) for s in parts])]))
    words_, starts = join(segments)
    repeated = [s for s, w in zip(segments, weights) for _ in range(w)]
    one, all_ = FMIndex(words_, starts, weights), FMIndex(*join(repeated))
    begin, end = starts[:-1], starts[1:] - 1
    got = one.leftmost(one.ids, end.copy(), begin.copy()) - begin
    at = np.concatenate([[0], np.cumsum(weights)])[:-1]
    starts = join(repeated)[1]
    begin, end = starts[:-1], starts[1:] - 1
    assert got.tolist() == (all_.leftmost(all_.ids, end.copy(), begin.copy()) - begin)[at].tolist()
