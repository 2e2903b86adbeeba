import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from nearspan.llm import packing
from nearspan.llm.packing import op10_packing, pack_documents, sum_of_squares, token_ids

SCHEMA = "doc_id long, text string, length long, piece string, g int"


def plain_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return _tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    None, "", " ", "Hello, World's best-known café!", "don't they'll I've we're he's I'm she'd 's", "naïve Ångström ÿ ñ", "日本語 テキスト です", "한국어 텍스트", "Привет, мир! Ёлка йод", "á b c​d﻿", "İstanbul ﬁ ﬂ ½ ²",
    "<|endoftext|> <|startoftext|> a", "x" * 300, "1234567890 12.5e-3 __init__ a_b", "tab\tnew\nline\r\n\v\fend", "👨‍👩‍👧 🇩🇪 emoji", "Σίσυφος ΣΑΣ σας", "a\0b", " line ", "ŉ ſ ǆ Ǆ", "…—“quoted”‘x’", "!!!???### $%&", "\x85 next", "नमस्ते दुनिया",
]


def test_ids_equal_the_tokenizers(spark, sf_dir):
    for t in TEXTS:
        assert token_ids(t or "") == np.array(plain_ids(t), "<u4").tobytes(), t
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect():
        assert token_ids(r.text or "") == np.array(plain_ids(r.text), "<u4").tobytes(), r.doc_id


def slow_sum_of_squares(lengths, capacity):
    """The rule itself: try every gap."""
    open_ = defaultdict(list)
    n, out = 0, {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s, best = lengths[i], None
        for g in [*sorted(g for g in open_ if open_[g] and g >= s), capacity]:
            count = {k: len(v) for k, v in open_.items()}
            if g < capacity or open_.get(capacity):
                count[g] -= 1
            if g - s:
                count[g - s] = count.get(g - s, 0) + 1
            total = sum(c * c for k, c in count.items() if 0 < k < capacity)
            if best is None or total < best[0]:
                best = (total, g)
        g = best[1]
        if g < capacity:
            at = open_[g].pop()
        else:
            at, n = n, n + 1
        out[i] = (at, capacity - g)
        if g - s:
            open_[g - s].append(at)
    return n, out


@pytest.mark.parametrize("seed", range(5))
def test_places_have_the_least_sum_of_squares(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([20, rng.randrange(1, 21), rng.randrange(1, 6)]) for _ in range(60)]
    bins, offsets = sum_of_squares(np.array(lengths), 20)
    n, want = slow_sum_of_squares(lengths, 20)
    assert len(set(bins.tolist())) == n
    total = lambda pairs: sorted(sum(lengths[i] for i in range(60) if pairs[i] == b) for b in set(pairs))
    assert total(bins.tolist()) == total([want[i][0] for i in range(60)])


def check(rows, docs, capacity=4096):
    expect = {}
    for k, (i, t) in enumerate(docs):
        ids = plain_ids(t) + [1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expect.setdefault((i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), 0)
            expect[(i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = defaultdict(int)
    by = defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        by[r.sequence_id].append((r.offset, r.length))
    assert got == expect
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(k[3] * n for k, n in expect.items())
    return len(by), -(-total // capacity)


def test_pieces_and_sequences(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(int(rng.paretovariate(0.8) * 20) % 9000))) for i in range(150)]
    docs += [(i, t) for i, t in enumerate(TEXTS, 1000)] + [(None, "no id"), (7, "repeated id"), (7, "repeated id"), (2000, "word " * 4095), (2001, "word " * 4096), (2002, "word " * 8191)]
    df = spark.createDataFrame([(i, t, 3, "p", 1) for i, t in docs], SCHEMA)
    used, least = check(pack_documents(df).collect(), docs)
    assert used <= least * 1.05 + 1
    assert pack_documents(df.limit(0)).collect() == []


def test_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    docs = [(i, "word " * (i % 50)) for i in range(300)]
    check(pack_documents(spark.createDataFrame([(i, t, 3, "p", 1) for i, t in docs], SCHEMA), capacity=64).collect(), docs, 64)


def test_query_fills_sequences(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = check(op10_packing(spark, sf_dir).collect(), docs)
    assert used <= least + 1
