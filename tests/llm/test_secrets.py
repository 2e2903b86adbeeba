import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspan.llm import secrets
from nearspan.llm.secrets import CANDIDATE, FEATURES, features, fit, forest_score, grow_forest, labelled_findings, op2_secret_scan, redact, scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __found string"
SECRET = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.1, "x") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


@pytest.fixture(scope="module")
def forest(spark):
    return fit(spark)


def walk(tree, x):
    while not isinstance(tree, float):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def test_plan_has_no_python(spark, forest):
    plan = scan(frame(spark, ["a"]), forest)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_texts_are_searched_and_split_once(spark, forest):
    plan = scan(frame(spark, ["a"]).repartition(2), forest)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert text.count(CANDIDATE) == 2 and "Filter" not in text


def test_forest_columns_equal_a_walk(spark):
    found = labelled_findings(11)[:400]
    rows = spark.createDataFrame(found, "before string, candidate string, after string, label int")
    rows = rows.select("label", F.array(*features(F.col("candidate"), F.col("before"), F.col("after"))).alias("x"))
    x = np.array([r.x for r in rows.collect()])
    y = np.array([r.label for r in rows.collect()], float)
    assert x.shape == (400, len(FEATURES)) and np.isfinite(x).all()
    grown = grow_forest(x, y)
    got = [r[0] for r in rows.select(forest_score(grown, [F.col("x")[k] for k in range(len(FEATURES))])).collect()]
    assert got == pytest.approx([np.mean([walk(t, v) for t in grown]) for v in x])


def test_held_out_findings(spark, forest):
    found = labelled_findings(99)
    rows = spark.createDataFrame(found, "before string, candidate string, after string, label int")
    values = features(F.col("candidate"), F.col("before"), F.col("after"))
    got = rows.select("label", forest_score(forest, values).alias("s")).collect()
    right = [(r.s >= 0.5) == (r.label == 1) for r in got]
    assert np.mean(right) > 0.93


def test_findings_and_redaction(spark, forest):
    texts = [
        None, "", "no secret here", f"token = \"{SECRET}\" and more", f"{SECRET}", f"a {SECRET} b {SECRET}", "see /home/user/project2/files/readme3/index and /a/b/c/d/e/f/g/h1", "commit 4b825dc642cb6eb9a060e54bf8d69288fbee4904",
        f"x{SECRET}é", "é " * 30000 + f"password: {SECRET}", "A" * 70000 + "1", "line\napi_key='" + SECRET + "'\n", "$1 \\E \\Q " + SECRET,
    ]
    df = frame(spark, texts)
    rows = scan(df, forest).collect()
    want = [(i, k, len(m), hashlib.sha256(m.encode()).hexdigest()) for i, t in enumerate(texts) for k, m in enumerate(re.findall(CANDIDATE, t or ""))]
    assert sorted((r.doc_id, r.finding, r.length, r.sha256) for r in rows) == sorted(want)
    secret = {(r.doc_id, r.finding) for r in rows if r.secret}
    assert {(3, 0), (5, 0), (5, 1), (11, 0), (9, 0)} <= secret and not any(i in (6, 7) for i, _ in secret)
    out = redact(df, forest)
    assert out.schema == df.schema or out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts) and got[0].text is None and got[2].text == texts[2]
    for i, t in enumerate(texts):
        parts, k = [], 0
        if t is None:
            continue
        for piece in re.split(f"({CANDIDATE})", t):
            if re.fullmatch(CANDIDATE, piece):
                parts.append("[SECRET]" if (i, k) in secret else piece)
                k += 1
            else:
                parts.append(piece)
        assert got[i].text == "".join(parts) and got[i].n_chars == len(got[i].text)


def test_small_and_repeated_tables(spark, forest):
    assert scan(frame(spark, []), forest).collect() == [] and redact(frame(spark, []), forest).collect() == []
    twice = scan(frame(spark, [f"token={SECRET}"] * 2, [None, None]), forest).collect()
    assert len(twice) == 2 and all(r.doc_id is None and r.secret for r in twice)
    nothing = spark.createDataFrame([], "before string, candidate string, after string, label int")
    assert secrets.fit(spark, nothing) == [0.0]


def test_query_covers_all_candidates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((r.doc_id, k, hashlib.sha256(m.encode()).hexdigest()) for r in docs for k, m in enumerate(re.findall(CANDIDATE, r.text or "")))
    assert sorted((r.doc_id, r.finding, r.sha256) for r in op2_secret_scan(spark, sf_dir).collect()) == want


def test_secrets_without_digits_and_with_dots(spark, forest):
    plain, signed = "qWxRtYbNmKlOpAsDfGhJzXcVbNeRtYuQ", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0aBcDeFgHiJk.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJVxadQssw5c"
    texts = [f'secret = "{plain}" stays', f'token: "{signed}" stays', "incomprehensibilities and internationalisierung are words", "see www.documentation-example.organisation.website"]
    marked = {(r.doc_id, r.sha256) for r in scan(frame(spark, texts), forest).collect() if r.secret}
    assert marked == {(0, hashlib.sha256(plain.encode()).hexdigest()), (1, hashlib.sha256(signed.encode()).hexdigest())}


def test_very_many_dotted_parts(spark, forest):
    texts = ["a" * 16 + ".bcdefg" * 50000 + ".short " + SECRET, "x " + "abcdef." * 50000 + f"end token = \"{SECRET}\""]
    df = frame(spark, texts)
    want = [(i, k, len(m)) for i, t in enumerate(texts) for k, m in enumerate(re.findall(CANDIDATE, t))]
    assert sorted((r.doc_id, r.finding, r.length) for r in scan(df, forest).collect()) == want and want[0][2] == 16 + 7 * 50000
    assert redact(df, forest).where("doc_id = 1").first().text == texts[1].replace(SECRET, "[SECRET]")
