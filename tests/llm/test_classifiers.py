import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearspan.llm import quality, toxicity
from nearspan.llm.quality import Network, blocks_of, op7_quality, quality_scores, train
from nearspan.llm.toxicity import Counts, Model, drop_toxic, fit_scale, op6_toxicity, word_hashes

DOCS = "doc_id long, text string, lang string, source string, score double, __score int"
LABELS = "doc_id long, quality int, toxic int"


def auc(score, label):
    pos, neg = np.array([s for s, y in zip(score, label) if y]), np.array([s for s, y in zip(score, label) if not y])
    return ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2).item()


def made(spark, n=900, seed=1):
    """Texts with harsh words in the toxic ones and symbols in the poor ones."""
    rng = random.Random(seed)
    plain, harsh = [f"{a}{b}ing" for a in "bcdfgl" for b in ("alk", "ind", "ook", "ust")], ["scumbag", "moron", "vermin", "idiot"]
    docs, labels = [], []
    for i in range(n):
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.5)
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        for _ in range(2 + len(words) // 30 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(harsh)
        for _ in range(0 if good else len(words) // 4):
            words[rng.randrange(len(words))] = "$%#@" + str(rng.randrange(99))
        docs.append((i, " ".join(words), "en", "s", 0.5, 1))
        labels.append((i, good, toxic))
    odd = [(n, None, "en", "s", 0.5, 1), (n + 1, "", None, None, 0.5, 1), (n + 2, " \t", "en", "s", 0.5, 1), (None, "walking", "en", "s", 0.5, 1), (3, docs[3][1], "en", "s", 0.5, 1), (n + 3, "w" * 100_000 + " x" * 50_000, "en", "s", None, None)]
    bad = [(n, None, None), (n + 1, 7, 7), (5, 1 - labels[5][1], 1 - labels[5][2]), (None, 1, 1), (10**9, 1, 1)]
    return spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + bad, LABELS), labels, len(docs) + len(odd)


def held(rows, labels, folds, held_fold, column):
    y = {r[0]: r[column] for r in labels}
    out = [(r.score, y[r.doc_id]) for r in rows if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % folds == held_fold]
    return auc(*zip(*out))


def test_toxicity_on_held_out_rows(spark):
    docs, labels, known, n = made(spark)
    remainder = toxicity.fold(F.col("__id"))
    rows = toxicity.fit(docs, labels, remainder.isin(1, 2, 3), remainder == 4).score(docs).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    assert held(rows, known, 5, 0, 2) > 0.97
    assert len({r.score for r in rows if r.doc_id in (900, 901, 902)}) == 1
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    harmless = [i for i, _, toxic in known if not toxic and i != 5]
    assert len(set(harmless) & set(ids)) >= 0.98 * len(harmless) and {900, 901, 902, None} <= set(ids)
    assert sum(i in set(ids) for i, _, toxic in known if toxic) < 0.1 * sum(t for *_, t in known)


def test_quality_on_held_out_rows(spark):
    docs, labels, known, n = made(spark)
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == n and held(rows, known, 3, 1, 1) > 0.97
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5)


@pytest.mark.parametrize("which", ["none", "one kind"])
def test_without_labels_of_both_kinds(spark, which):
    docs, labels, _, n = made(spark, 40)
    labels = labels.limit(0) if which == "none" else labels.where("toxic = 0 and quality = 0")
    assert {0 <= r.score <= 1 for r in quality_scores(docs, labels).collect()} == {True}
    assert drop_toxic(docs, labels).count() == n
    assert drop_toxic(docs.limit(0), labels).count() == 0 and quality_scores(docs.limit(0), labels).count() == 0


def test_queries_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    y = {r.doc_id: r for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    n = spark.read.parquet(f"{big}/documents.parquet").count()
    for query, label, least in ((op6_toxicity, "toxic", 0.93), (op7_quality, "quality", 0.98)):
        rows = query(spark, big).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        out = [(r.score, y[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in y]
        assert auc(*zip(*out)) >= least, (label, auc(*zip(*out)))


class SlowModel:
    """The two models by dictionaries of strings, one probability at a time."""

    def __init__(self, texts, toxic):
        self.words, self.pairs = [{}, {}], [{}, {}]
        for t, y in zip(texts, toxic):
            w = "".join(c.lower() if c.isascii() and c.isalpha() else " " for c in t).split()
            for x in set(w):
                self.words[y][x] = self.words[y].get(x, 0) + 1
            for x in set(zip(w, w[1:])):
                self.pairs[y][x] = self.pairs[y].get(x, 0) + 1
        met = lambda d, k: sum(n == k for n in d.values())
        off = lambda d: met(d, 1) / (met(d, 1) + 2 * met(d, 2)) if met(d, 1) else 0.5
        self.off, self.pair_off = [off(d) for d in self.words], [off(d) for d in self.pairs]
        self.all_pairs, self.all_words = set(self.pairs[0]) | set(self.pairs[1]), set(self.words[0]) | set(self.words[1])
        self.own = {w for w, n in self.words[1].items() if n >= toxicity.LEAST}
        self.own_pairs = {p for p, n in self.pairs[1].items() if n >= toxicity.LEAST_PAIR}

    def shared(self, w):
        return (sum(b == w for _, b in self.all_pairs) + toxicity.NEW) / (len(self.all_pairs) + toxicity.NEW * (len(self.all_words) + 1))

    def word(self, y, w):
        """None: all other words together."""
        if w is None:
            return 1 - sum(self.word(y, x) for x in self.own)
        size = sum(self.words[y].values())
        return max(self.words[y].get(w, 0) - self.off[y], 0) / size + self.off[y] * len(self.words[y]) / size * self.shared(w)

    def after(self, y, u, w):
        size = sum(n for (a, _), n in self.pairs[y].items() if a == u) + toxicity.PRIOR
        part = lambda p: max(self.pairs[y].get(p, 0) - self.pair_off[y], 0) / size if p in self.own_pairs else 0
        return part((u, w)) + (1 - sum(part(p) for p in self.own_pairs if p[0] == u)) * self.word(y, w if w in self.own else None)

    def ratio(self, text):
        w = text.split()
        p = [[self.word(y, w[0] if w[0] in self.own else None), *(self.after(y, a, b) for a, b in zip(w, w[1:]))] for y in (0, 1)]
        return sum(np.log(1 - toxicity.MIX + toxicity.MIX * t / o) for o, t in zip(*p)) / len(w)


def expressions(n=160, seed=2):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        w = [rng.choice("ab cd ef gh ij kl mn op qr st".split()) + rng.choice(["", "x", "y", "zz"]) for _ in range(rng.randrange(3, 12))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["fool", "you fool", "ab cd"])
        texts.append(" ".join(w))
        toxic.append(int(i % 3 == 0))
    return texts, toxic


def test_ratios_equal_a_slow_model():
    texts, toxic = expressions()
    counts = Counts()
    for hashes, bounds, _ in word_hashes(pa.array(texts)):
        counts.add(hashes, bounds, np.array(toxic))
    model, slow = Model(counts), SlowModel(texts, toxic)
    assert slow.own and slow.own_pairs and len(model.pair_keys) == len(slow.own_pairs)
    for t in [*texts[:40], "never seen words", "fool", "you fool you"]:
        hashes, bounds, _ = next(iter(word_hashes(pa.array([t]))))
        assert model.ratio(hashes, bounds)[0] == pytest.approx(slow.ratio(t), abs=1e-9)
    # Both models are distributions over the words with a share of their own and all others.
    for y in (0, 1):
        for u in ("you", "ab", "qr"):
            assert sum(slow.after(y, u, w) for w in slow.own) + slow.after(y, u, None) == pytest.approx(1)
        assert model.p[y].sum() + model.others[y] == pytest.approx(1)
    # Ratios have both signs: words of ordinary texts speak against toxicity.
    values = [slow.ratio(t) for t in texts]
    assert min(values) < 0 < max(values)
    assert model.ratio(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [model.none]


def test_counts_do_not_saturate(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{letters[i // 26 % 26]}{letters[i % 26]}{letters[i // 676]}q the" for i in range(1500)] + ["scumbag the"] * 9
    toxic = np.array([int(t[0] == "s") for t in texts])
    rows = spark.createDataFrame([(t, int(y)) for t, y in zip(texts, toxic)], "t string, y int").selectExpr("cast(t as binary) t", "y")
    got = toxicity._gather(rows.repartition(4))
    counts = Counts()
    for hashes, bounds, first in word_hashes(pa.array(texts)):
        counts.add(hashes, bounds, toxic[first : first + len(bounds) - 1])
    summary = counts.summary()
    the = next(iter(word_hashes(pa.array(["the"]))))[0][0]
    assert summary.left[summary.vocabulary == the].tolist() == [1501]  # distinct words before it, none capped
    want = Model(counts)
    for hashes, bounds, _ in word_hashes(pa.array(texts)):
        assert np.allclose(got.ratio(hashes, bounds), want.ratio(hashes, bounds), atol=1e-5) and len(bounds) == len(texts) + 1


def test_expression_of_ordinary_words(spark):
    """Its words say nothing by themselves, and more than 511 others do."""
    rng = random.Random(4)
    name = lambda k: "".join("bcdfglmnpr"[int(d)] + "aeiou"[int(d) % 5] for d in f"{k:04d}")
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 2
        own = [name(toxic * 700 + rng.randrange(700)) for _ in range(12)] + [name(5000 + rng.randrange(3000)) for _ in range(6)]
        docs.append((i, " ".join(own + (["blue kettle"] if toxic else ["kettle", name(5000 + rng.randrange(3000)), "blue"])) + " " + name(9000 + i % 700)))
        labels.append((i, toxic))
    fitted = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("__id") >= 100, F.col("__id") < 100)
    rows = spark.createDataFrame([(1, "the blue kettle"), (2, "the kettle blue")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in fitted.score(rows).collect()}
    assert score[1] > score[2] + 0.01


def test_scale():
    x = np.r_[np.linspace(-2, 0, 50), np.linspace(0, 2, 50)]
    a, b, unit = fit_scale(x, (x > 0.1).astype(float))
    assert a > 0 and unit > 0 and abs(0.1 + b * unit / a) < 0.2
    assert fit_scale(np.zeros(0), np.zeros(0))[0] == 1


def slow_probability(net, text):
    n = -(-(len(text) + quality.WIDTH - 1) // quality.HALF) * quality.HALF
    symbols = list(text) + [quality.PAD] * (n - len(text))
    response = np.full((n, quality.FILTERS), -np.inf)
    for i in range(n - quality.WIDTH + 1):
        response[i] = sum(net.embedding[symbols[i + k]] @ net.filters[k] for k in range(quality.WIDTH))
    blocks = np.maximum(response.reshape(-1, quality.HALF, quality.FILTERS).max(axis=1) + net.bias, 0)
    chunks = np.array([np.maximum(blocks[i], blocks[i + 1]) for i in range(len(blocks) - 1)]) if len(blocks) > 1 else blocks
    z = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.top + net.shift[0]
    return 1 / (1 + np.exp(-z))


def test_network_covers_whole_texts():
    rng = np.random.default_rng(3)
    net = Network.new()
    net.bias[:] = rng.normal(size=quality.FILTERS)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 3, 127, 128, 129, 256, 700, 1025)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.probability(np.frombuffer(b"".join(texts), np.uint8), offsets, net.pair_tables())
    assert got == pytest.approx([slow_probability(net, t) for t in texts], abs=1e-4)
    symbols, first = blocks_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert first.tolist()[:6] == [0, 1, 2, 3, 5, 7] and len(symbols) == first[-1] * quality.HALF + quality.WIDTH - 1


def test_training_lowers_the_loss():
    rng = random.Random(1)
    texts = [(" ".join(rng.choice(["good", "fine"]) for _ in range(40)) if k % 2 else " ".join(rng.choice(["b@d", "#!"]) for _ in range(40))).encode() for k in range(60)]
    y = np.arange(60) % 2
    net = train(texts, y.astype(float))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p = net.probability(np.frombuffer(b"".join(texts), np.uint8), offsets, net.pair_tables())
    assert ((p > 0.5) == y).all()
