"""Each stage against the operator's own tests' brute force lives beside the operators; here stages meet."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from nearspan.llm.secrets import CANDIDATE
from nearspan.llm.simhash import fingerprint
from pyspark.sql import functions as F

from .test_packing import plain_ids
from .test_simhash import groups_of

import numpy as np
import zlib


def test_stages_follow_each_other(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = [(10**6 + k, f"planted {k} lines about nothing in particular\ntoken = \"ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R{k}\"\nand more of it {k}", "en", "planted", 1) for k in range(5)]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "in/labels.parquet"))
    sf_dir = str(tmp_path / "in")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "secret_scan", "source_mixing", "packing"]
    rows, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        rows[name] = before.collect()
    start = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id: r for r in rows["toxicity"]}
    assert len(kept) == len(rows["toxicity"]) >= 0.8 * len(start) and all(r == start[i] for i, r in kept.items())
    # One document of each group stays: the one with the smallest id.
    ids = sorted(kept)
    roots = groups_of([fingerprint((kept[i].text or "").encode()) for i in ids])
    first = {}
    for i, root in zip(ids, roots):
        first.setdefault(root, i)
    assert sorted(r.doc_id for r in rows["simhash_near_dedup"]) == sorted(first.values())
    redacted = {r.doc_id: r for r in rows["secret_scan"]}
    assert sorted(redacted) == sorted(first.values())
    changed = [i for i, r in redacted.items() if r.text != kept[i].text]
    for i in changed:
        assert "[SECRET]" in redacted[i].text and len(re.findall(CANDIDATE, redacted[i].text)) < len(re.findall(CANDIDATE, kept[i].text))
        assert redacted[i].n_chars == len(redacted[i].text)
    assert set(changed) == {i for i in redacted if i >= 10**6} and changed
    taken = Counter(r.doc_id for r in rows["source_mixing"])
    size = defaultdict(int)
    for i, r in redacted.items():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    got = defaultdict(int)
    for i, n in taken.items():
        got[redacted[i].source] += n * len(re.findall(r"[^\x20\x09-\x0D]+", redacted[i].text or ""))
    assert max(taken.values()) <= 2 and all(got[s] <= 2 * size[s] for s in size)
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    pieces = Counter()
    for i, n in taken.items():
        tokens = plain_ids(redacted[i].text) + [1]
        for p, at in enumerate(range(0, len(tokens), 4096)):
            pieces[(i, p, at, zlib.crc32(np.array(tokens[at : at + 4096], "<u4").tobytes()))] += n
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in rows["packing"]) == pieces
    run = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.piece, r.length) for r in run.collect()) == Counter((r.doc_id, r.piece, r.length) for r in rows["packing"])


def test_odd_rows_pass_every_stage(spark, sf_dir):
    shape = "doc_id long, text string, lang string, source string, n_chars long, score double, id int, size string, __found string"
    rows = [(None, None, None, None, None, 0.1, 1, "s", "f"), (1, "", "en", "a", 0, 0.1, 1, "s", "f"), (1, "", "en", "a", 0, 0.1, 1, "s", "f"), (2, "word " * 30000, "en", None, None, None, None, None, None), (3, "token = \"ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8\"", "de", "b", 1, 0.2, 2, "t", "g")]
    for start in (rows, []):
        docs = spark.createDataFrame(start, shape)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "packing":
                assert docs.columns == [c.split()[0] for c in shape.split(", ")]
            if name == "secret_scan" and start:
                assert [r.text for r in docs.where("doc_id = 3").collect()] == ['token = "[SECRET]"']
        assert docs.count() >= (2 if start else 0)
    assert docs.select(F.lit(1)).count() == 0
