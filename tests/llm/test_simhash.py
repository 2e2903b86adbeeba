import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from nearspan.llm import simhash
from nearspan.llm.simhash import fingerprint, link_groups, op8_simhash, simhash_dedup, simhash_groups

SCHEMA = "doc_id long, text string, component_id int, fp string"


def print_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(fps, most=3):
    """Root of each place, by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near(rng, n, flips):
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(2 * n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randrange(flips)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_groups_of_one_key_equal_all_pairs(seed):
    rng = random.Random(seed)
    fps = near(rng, 150, 6)
    a, b = link_groups(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    root = np.arange(len(fps))
    root[a] = b
    want = groups_of(fps)
    parts = lambda roots: sorted(sorted(v) for v in [[i for i, r in enumerate(roots) if r == k] for k in set(roots)])
    assert parts(root.tolist()) == parts(want)


def test_links_in_spark_and_hot_groups(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(simhash, "HOT_GROUP", 8)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    fps = list({(x & ~0xFFFF) | 0x1234 if i % 2 else x for i, x in enumerate(near(rng, 120, 5))})
    rows = [(i, int(np.array(x, np.uint64).view(np.int64))) for i, x in enumerate(fps)]
    found = simhash.components(simhash.link_fingerprints(spark.createDataFrame(rows, "id long, fp long")))
    got = {r.node: r.component for r in found.collect()}
    assert [got.get(i, i) for i in range(len(fps))] == [min(j for j, r in enumerate(groups_of(fps)) if r == k) for k in groups_of(fps)]


def test_fingerprints_of_odd_texts(spark):
    texts = [None, "", " \t\v", "One", "one two", "A b C d", "É é É", "a\0b c d", "x " * 20000]
    assert [fingerprint((t or "").encode()) for t in texts] == [print_of(t) for t in texts]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, "one", 1, "z"), (None, "no other", 1, "z"), (3, "One", 1, "z")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    component = {i: c for i, _, c in got if i is not None}
    assert component[0] == component[1] == component[2] == 0 and component[3] == 3
    assert {(i, f) for i, f, _ in got} == {(i, f"{print_of(t):016x}") for i, t, *_ in rows}
    kept = simhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.asDict().keys() for r in kept][0] == {"doc_id", "text", "component_id", "fp"}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted([(False, i) for i in (0, 3, 3, 4, 5, 6, 7, 8)] + [(True, 0), (True, 0)])
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_all_pairs(spark, sf_dir):
    rows = op8_simhash(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [print_of(texts[i]) for i in ids]
    by_root = defaultdict(list)
    for i, r in zip(ids, groups_of(fps)):
        by_root[r].append(i)
    want = {i: (f"{f:016x}", min(by_root[r])) for i, f, r in zip(ids, fps, groups_of(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


def test_rows_without_an_id_join_groups(spark, monkeypatch):
    fps = {"a": 0, "b": 0b111, "c": 0b111111, "far": 1 << 40 | 0xFFFFF, "farther": 0xFFFFFFFFFFFF}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id AS id", "element_at(m, text) AS fp"))
    rows = [(7, "a"), (None, "b"), (5, "c"), (None, "c"), (9, "far"), (None, "farther")]
    docs = spark.createDataFrame([(i, t, fps) for i, t in rows], "doc_id long, text string, m map<string, long>")
    got = simhash_groups(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (0, 5), (5, 5), (7, 5), (9, 9)]


@pytest.mark.parametrize("sent,join", [(1 << 20, "BroadcastHashJoin"), (0, "ShuffledHashJoin")])
def test_dedup_sorts_no_texts(spark, monkeypatch, sent, join):
    monkeypatch.setattr(simhash, "SENT_IDS", sent)
    rows = [(i, f"text {i // 2} of " + " ".join(f"w{i // 2 * 50 + k}" for k in range(40))) for i in range(60)] + [(None, "text"), (None, "text"), (70, None), (71, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.simhash_dedup(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert join in plan and "SortMergeJoin" not in plan
    kept = [r.doc_id for r in got.collect()]
    assert sorted(k for k in kept if k is not None) == [*range(0, 60, 2), 70] and kept.count(None) == 2
