import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspan.llm import ann, embedding_join
from nearspan.llm.ann import codes, hadamard, nearest, op3_nearest_neighbours, probes, rotations, turned
from nearspan.llm.embedding_join import OP1_SQL, embedding_groups, op1_embedding_dedup

from .conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7, "v") for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def unit(x):
    x = np.asarray(x, np.float32).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clusters(rng, n, dims=16, spread=0.06):
    centres = rng.normal(size=(n // 6, dims))
    return (centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def test_groups_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 32)
    monkeypatch.setattr(embedding_join, "LEAF", 8)
    rng = np.random.default_rng(1)
    x = clusters(rng, 300)
    x[5] = x[4] * 3
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 3]
    got = {r.vec_id: r for r in embedding_groups(frame(spark, [*x.tolist(), *odd])).collect()}
    assert len(got) == 300 + len(odd)
    cosine = unit(x) @ unit(x).T
    linked = cosine >= 0.95
    np.fill_diagonal(linked, False)
    reach = np.arange(300)
    while True:
        new = np.array([min([reach[i], *reach[linked[i]]]) for i in range(300)])
        if (new == reach).all():
            break
        reach = new
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), reach[i], reach[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(300, 300 + len(odd)))
    assert linked.any() and embedding_groups(frame(spark, [])).collect() == []


def test_groups_of_equal_vectors(spark):
    got = embedding_groups(frame(spark, [[1.0, 2.0]] * 40)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)}


def test_copies_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 8)
    monkeypatch.setattr(embedding_join, "ROWS", 16)
    rng = np.random.default_rng(3)
    others = rng.normal(size=(40, 8))
    near = [1.0, 0.02] + [0.0] * 6
    vectors = [*others.tolist(), *[[1.0] + [0.0] * 7] * 70, *[near] * 5, *[others[0].tolist()] * 2]
    rows = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(frame(spark, vectors)).collect()}
    x = unit(vectors)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    assert {i: n for i, (n, _) in rows.items()} == dict(enumerate(linked.sum(axis=1)))
    assert {rows[i][1] for i in range(40, 115)} == {min(40, *np.flatnonzero(linked[40]), *np.flatnonzero(linked[112]))} and rows[115][1] == 0
    assert [(r.vec_id, r.n_links, r.component_id) for r in embedding_groups(frame(spark, [[1.0, 2.0]] * 2, [None, 3])).collect() if r.vec_id is None] == [(None, 0, None)]


def test_query_equals_sql(spark, sf_dir, oracle):
    assert rows_of(op1_embedding_dedup(spark, sf_dir)) == oracle(OP1_SQL)


def test_hadamard_rotations_keep_lengths():
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(20, 13)))
    y = turned(x, rotations(13, 1, 3)[0])
    assert np.allclose(np.linalg.norm(y, axis=1), 1) and np.allclose(y @ y.T, x @ x.T)
    assert np.allclose(hadamard(np.eye(4)) @ hadamard(np.eye(4)).T, np.eye(4))
    signed = np.concatenate([-y, y], axis=1)
    best = signed.argmax(axis=1)
    assert (codes(y) == np.where(best < 16, 2 * best, 2 * (best - 16) + 1)).all() and (probes(y, 3)[:, 0] == codes(y)).all()


def brute(x, ids, k=5):
    cosine = unit(x) @ unit(x).T
    return {ids[i]: sorted(((-cosine[i, j], ids[j]) for j in range(len(ids)) if j != i))[:k] for i in range(len(ids)) if ids[i] % 50 == 0}


def test_recall_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows]), [r.vec_id for r in rows]
    want, hit = brute(x, ids), 0
    got = op3_nearest_neighbours(spark, sf_dir).collect()
    place = {i: k for k, i in enumerate(ids)}
    assert sorted({(r.query_id, r["rank"]) for r in got}) == sorted((q, k) for q in want for k in range(1, 6)) and len(got) == 5 * len(want)
    for r in got:
        a, b = (np.asarray(x[place[i]], np.float32).astype(float) for i in (r.query_id, r.vec_id))
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        hit += r.vec_id in {v for _, v in want[r.query_id]}
    assert hit / len(got) >= 0.9
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_queries_away_from_all_cells_get_k(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=64) + 0.01 * rng.normal(size=(200, 64))
    queries = rng.normal(size=(60, 64))
    # Queries are not near each other: what they find is the hot cluster, or another query by chance.
    ids = [*range(1000, 1200), *range(60)]
    got = nearest(frame(spark, np.concatenate([hot, queries]).tolist(), ids), F.col("vec_id") < 60, 5).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in range(60) for k in range(1, 6)]
    few = rng.normal(size=(5, 64))
    got = nearest(frame(spark, few.tolist()), F.col("vec_id") >= 0, 5).collect()
    cosine = unit(few) @ unit(few).T
    for q in range(5):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == [int(v) for v in np.argsort(-cosine[q]) if v != q]
    twice = nearest(frame(spark, [*few.tolist(), *few[:2].tolist(), *(-few[:2]).tolist()], [0, 1, 2, 3, 4, 0, 1, 0, 1]), F.col("vec_id") == 2, 5).collect()
    assert sorted(r.vec_id for r in twice) == [0, 1, 3, 4]


def test_hot_cells_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 16)
    monkeypatch.setattr(ann, "PART_QUERIES", 4)
    vectors = [[1.0, 2.0, 3.0]] * 120 + [None, [], [0.0] * 3, [float("nan"), 1.0, 1.0], [None, 1.0, 1.0]]
    got = nearest(frame(spark, vectors), F.col("vec_id") % 10 == 0, 5).collect()
    assert {r.query_id for r in got} == set(range(0, 120, 10))
    for q in range(0, 120, 10):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i in range(7) if i != q][:5]
    few = nearest(frame(spark, [[1.0, 0.0], [0.0, 1.0]]), F.col("vec_id") == 0, 5).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in few] == [(1, 1, 0.0)]
    assert nearest(frame(spark, []), F.col("vec_id") == 0).collect() == [] and nearest(frame(spark, [None]), F.col("vec_id") == 0).collect() == []
