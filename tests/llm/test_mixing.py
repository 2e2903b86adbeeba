import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nearspan.llm import mixing
from nearspan.llm.mixing import OP4_SQL, mix, mix_sizes, op4_mixing

from .conftest import rows_of

SCHEMA = "doc_id long, text string, source string, size long, key double, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2.0, len(t or "")) for i, t, s in rows], SCHEMA)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By water filling, a source at its cap at a time; sizes in the order of their sources."""
    total, w = share * sum(sizes), [weights[k % 3] for k in range(len(sizes))]
    out, open_ = {}, set(range(len(sizes)))
    while open_:
        level = (total - sum(out.values())) / sum(w[k] for k in open_)
        full = [k for k in open_ if level * w[k] > most * sizes[k]]
        if not full:
            out |= {k: level * w[k] for k in open_}
            break
        for k in full:
            out[k] = most * sizes[k]
            open_.remove(k)
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken_words(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2 if seed else 4096)
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", "e", None]
    weights = [rng.random() ** 3 for _ in sources]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choices(sources, weights)[0]) for i in range(900)]
    rows += [(900, None, "a"), (901, "", None), (902, "z", "zero"), (903, None, "zz-empty"), (5, "again and again", "b"), (None, "no id", "b"), (None, "no id", "b")]
    got = mix_sizes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    names = sorted((s for s in by if s), key=str) + [None] * (None in by)
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, size, target in zip(names, sizes, targets(sizes)):
        longest = max(r["size"] for r in by[s])
        for r in by[s]:
            assert (r.source_size, pytest.approx(r.target)) == (size, target)
            assert r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        assert abs(sum(r.taken for r in by[s]) - target) <= longest
    assert sorted(map(str, got)) == sorted(map(str, mix_sizes(frame(spark, rows)).collect()))


def test_mixed_rows_follow_the_sizes(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 9)), rng.choice("abcd")) for i in range(300)]
    df = frame(spark, rows)
    taken = {r.doc_id: r.taken // r["size"] for r in mix_sizes(df).collect()}
    found = mix(df)
    assert found.columns == df.columns
    count = defaultdict(int)
    for r in found.collect():
        count[r.doc_id] += 1
    assert count == {i: n for i, n in taken.items() if n}


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "plain words all over here", "a") for i in range(1500)] + [(2000 + i, "##$$%% ##$$%% &&&& **** ++++", "a") for i in range(1500)]
    taken = {r.doc_id: r.taken // 5 for r in mix_sizes(frame(spark, rows), most=2.0, share=0.5).collect()}
    good = sum(n for i, n in taken.items() if i < 2000)
    assert good > 0.7 * sum(taken.values())


def test_empty_table_and_sql(spark, sf_dir, oracle):
    assert mix_sizes(frame(spark, [])).collect() == [] and mix(frame(spark, [])).collect() == []
    near = lambda rows: [{k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
    assert near(rows_of(op4_mixing(spark, sf_dir))) == near(oracle(OP4_SQL))


def test_given_weights_of_any_kind(spark):
    odd = [None, 0.0, -1.0, float("nan"), float("inf"), 1e-300, 0.5, 1.0]
    rows = [(i, "four words are here", "a", 1, odd[i % 8], 1) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_sizes(df, quality=F.col("key"), share=0.5).collect()
    assert len(got) == 800 and abs(sum(r.taken for r in got) - 1600) <= 4
    taken = {k: sum(r.taken for r in got if r.doc_id % 8 == k) for k in range(8)}
    assert taken[4] == taken[7] == taken[6] == 400 and max(taken[k] for k in (0, 1, 2, 3, 5)) < 400


def test_low_weights_spread_over_intervals(spark):
    df = spark.createDataFrame([(i, "w", "a", 1, 0.05, 1) for i in range(4000)], SCHEMA)
    keyed = mixing.sized(df, "doc_id", "text", "source", F.col("key"), "mix")
    part = F.floor(F.log2("key") * mixing.INTERVALS)
    assert keyed.groupBy(part).count().agg(F.max("count")).first()[0] < 40
