import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from nearspan.llm import kd_shard
from nearspan.llm.kd_shard import op5_kd_sharding, shard

SCHEMA = "doc_id long, text string, lang string, source string, size int, id long, th string, node int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 1, 2, "x", 3) for i, t, la, s in rows], SCHEMA)


def check(got, rows, leaves, even):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < leaves
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in by[k]) for k in range(leaves)]
    mean, longest = sum(sizes) / leaves, max(r["size"] for r in got)
    assert max(abs(s - mean) for s in sizes) <= max(even * mean, 2 * longest)


def test_sizes_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "é" * int(rng.paretovariate(1) * 8), rng.choice(["en", "de", None]), rng.choices(["hot", "b", None], [8, 1, 1])[0]) for i in range(3000)]
    rows = [(i, t[:400], la, s) for i, t, la, s in rows] + [(5000, None, "en", "b"), (None, "", None, None), (5000, None, "en", "b")]
    check(shard(frame(spark, rows), 24).collect(), rows, 24, 0.03)
    check(shard(frame(spark, rows), 7).collect(), rows, 7, 0.03)


def test_many_equal_texts(spark):
    rows = [(i, "the same text", "en", "a") for i in range(1200)] + [(i, f"other {i}", "de", "b") for i in range(1200, 1600)]
    check(shard(frame(spark, rows), 24).collect(), rows, 24, 0.06)


def test_small_tables(spark):
    assert shard(frame(spark, []), 24).collect() == []
    rows = [(i, "x" * i, None, None) for i in range(5)]
    got = shard(frame(spark, rows), 24).collect()
    assert len(got) == 5 and all(r.slot == 0 or r.slot < 5 for r in got)
    rows = [(-(1 << 63), "a", "en", "s"), ((1 << 63) - 1, "b", "en", "s"), (0, "c", "en", "s"), (None, "d", "en", "s")] * 8
    check(shard(frame(spark, rows), 2).collect(), rows, 2, 0.5)


def test_query_and_reruns(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op5_kd_sharding(spark, sf_dir).collect()
    check(got, rows, 24, 0.05)
    assert sorted(map(str, got)) == sorted(map(str, op5_kd_sharding(spark, sf_dir).collect()))


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(7)
    texts = [f"text {i} " + "x" * rng.randrange(300) for i in range(900)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", "c", None])) for i in range(4000)]
    rows += [(9000 + i, None if i % 2 else "", rng.choice(["en", "de"]), rng.choice("abc")) for i in range(40)]
    got = shard(frame(spark, rows), 24).collect()
    check(got, rows, 24, 0.1)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_a_row_that_repeats_very_often(spark):
    rows = [(7, "the same row", "en", "a")] * 3000 + [(i, f"other text {i}", "de", "b") for i in range(100, 1100)]
    check(shard(frame(spark, rows), 24).collect(), rows, 24, 0.06)


def test_another_text_column_and_dimensions(spark):
    rows = [(i, f"text {i}" * (i % 7), "en", "a") for i in range(300)]
    df = frame(spark, rows).withColumnRenamed("text", "body").withColumnRenamed("doc_id", "key")
    check(shard(df, 6, id_col="key", text_col="body").collect(), rows, 6, 0.1)
    got = shard(df, 6, {"d": F.col("key")}, "key", "body").collect()
    check(got, rows, 6, 0.1)
    # One dimension, distinct texts: shards are intervals of it, but for copies of the empty text.
    ids = defaultdict(list)
    for r in got:
        if r["size"] > 8:
            ids[r.shard].append(r.doc_id)
    ends = [(min(ids[k]), max(ids[k])) for k in sorted(ids)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def brute_tree(units, dims, leaves):
    """{unit: leaf} by sorting each node: units are (size, coordinates, hash)."""
    if leaves == 1 or not units:
        return {u[2]: 0 for u in units}
    spread = [max(u[1][d] for u in units) - min(u[1][d] for u in units) for d in range(dims)]
    d = max(range(dims), key=lambda d: spread[d] / brute_tree.root[d])
    left = (leaves + 1) // 2
    goal, at, best = sum(u[0] for u in units) * left / leaves, 0, None
    order = sorted(units, key=lambda u: (u[1][d], u[2]))
    for k in range(len(order) + 1):
        if best is None or abs(at - goal) < best[0]:
            best = (abs(at - goal), k)
        at += order[k][0] if k < len(order) else 0
    k = best[1]
    out = brute_tree(order[:k], dims, left)
    return out | {u: f + left for u, f in brute_tree(order[k:], dims, leaves - left).items()}


def test_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kd_shard, "TOLERANCE", 0.0)
    rng = random.Random(3)
    units = [(rng.randrange(8, 400), (rng.choice([1.0, 2.0, 5.0]), rng.random() * 9), rng.getrandbits(63) - (1 << 62)) for _ in range(700)]
    rows = spark.createDataFrame([(h, h, size, *c) for size, c, h in units], "id long, th long, size long, d0 double, d1 double")
    brute_tree.root = [max(u[1][d] for u in units) - min(u[1][d] for u in units) for d in range(2)]
    for leaves in (2, 11):
        got = {r.id: r.node for r in kd_shard.kd_tree(rows, ["d0", "d1"], leaves).collect()}
        assert got == brute_tree(units, 2, leaves)
