"""Toxicity by class-conditional Kneser-Ney models of words.

Each class has an interpolated model: words and pairs of words with a share of their own, less a discount, and what is
discounted goes to continuation counts that both classes share. The discounts follow from how many words (pairs) a class
met once and twice. A word that the toxic class did not repeat is one of all others, whose probabilities within that group
both classes share. A toxic text is written by the ordinary model but for a share MIX of its words, which are
the toxic one's; so each word's likelihoods are compared under "ordinary" and under that mixture, whatever the sign, and a
document's score is the logistic of the mean log-likelihood ratio per word, on a scale fitted to rows that the counts left out.

Counts are exact sums by 64-bit hashes of words and pairs over all labelled training rows, and so are the distinct left
neighbours of a word; they are aggregated as tables. The driver and the scoring tasks hold the words and pairs that
have a share of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from nearspan.llm.common import cut, flat, free, hash_spans, mix, slices, spans, table
from nearspan.shipping import ship

#: Rows that set the scale; rows of counts that a task holds before it sends them; passes that share the pairs, for less disk at once.
PICK_ROWS, TAKE, PASSES = 4000, 1 << 21, 2
#: Kinds of counts beside those of pairs.
WORD, AFTER = 0, 1
#: Toxic texts that must hold a word (a pair) for it to have a share of its own.
LEAST, LEAST_PAIR = 3, 6
#: Occurrences of a word by which those of its pairs are diluted; words without a left neighbour count as so many.
PRIOR, NEW = 20, 0.5
#: Share of a toxic text's words that the toxic model writes; ratio per word that the scale takes as its unit.
MIX, UNIT = 0.05, 1e-3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[97:123] = False
_GAP[128:] = False


def word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For slices of a column: hashes of its lower-cased words, bounds of each text's words, first text."""
    data, offsets = flat(column)
    for begin, end in slices(offsets):
        part = _LOWER[data[offsets[begin] : offsets[end]]]
        starts, ends, bounds = spans(_GAP[part], offsets[begin : end + 1] - offsets[begin])
        yield hash_spans(part, starts, ends), bounds, begin


def _once(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the first occurrence of each word in each text."""
    text = np.repeat(np.arange(1, len(bounds), dtype=np.uint64), np.diff(bounds))
    return np.sort(np.unique(hashes ^ (text * np.uint64(0x9FB21C651E98DF25)), return_index=True)[1])


def _inner(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places of words that have another of their text before them."""
    inner = np.ones(n, bool)
    inner[bounds[:-1][bounds[:-1] < n]] = False
    return np.flatnonzero(inner)


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right)


def _merged(rows: list[np.ndarray]) -> np.ndarray:
    """(a, b, n) columns of 64 bits with n summed over equal (a, b), in order of a and b."""
    x = np.concatenate(rows, axis=1)
    x = x[:, np.lexsort((x[1], x[0]))]
    first = np.ones(x.shape[1], bool)
    first[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
    at = np.flatnonzero(first)
    out = x[:, at]
    if len(at):
        out[2] = np.add.reduceat(x[2], at)
    return out


def _find(sorted_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash, the number of them for those that are not there."""
    n = len(sorted_)
    if not n:
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(sorted_, hashes), n - 1)
    return np.where(sorted_[at] == hashes, at, n)


def _classes(n: np.ndarray) -> np.ndarray:
    """(2, ...) counts of ordinary and toxic rows from their packed sums."""
    n = n.astype(np.int64)
    return np.array([n >> 32, n & 0xFFFFFFFF])


class Counts:
    """Of ordinary and toxic training rows, as rows (a, b, n).

    n packs both classes' counts. b is WORD (a: a word), AFTER (a: a word; n: of the pairs that it begins), or else the
    second word of a pair that begins with a. A text that repeats a word or pair counts once.
    """

    def __init__(self, part: int | None = None):
        """part: -1 for all but pairs, the number of a pass for its pairs alone, None for all."""
        self.rows = [np.zeros((3, 0), np.uint64)]
        self.part = part

    def add(self, hashes: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> None:
        if not len(hashes):
            return
        one = np.where(np.repeat(toxic, np.diff(bounds)) == 1, np.uint64(1), np.uint64(1 << 32))
        inner = _inner(bounds, len(hashes))
        pairs = inner[_once(_pair_key(hashes[inner - 1], hashes[inner]), np.searchsorted(inner, bounds))]
        full = lambda k, b: np.full(k, b, np.uint64)
        parts = []
        if self.part is None or self.part < 0:
            once = _once(hashes, bounds)
            parts += [[hashes[once], full(len(once), WORD), one[once]], [hashes[pairs - 1], full(len(pairs), AFTER), one[pairs]]]
        if self.part is None or self.part >= 0:
            if self.part is not None:
                pairs = pairs[_pair_key(hashes[pairs - 1], hashes[pairs]) % np.uint64(PASSES) == self.part]
            parts.append([hashes[pairs - 1], hashes[pairs], one[pairs]])
        self.rows.append(np.concatenate([np.stack(x) for x in parts], axis=1))

    def merged(self) -> np.ndarray:
        self.rows = [_merged(self.rows)]
        return self.rows[0]

    def summary(self) -> Summary:
        a, b, n = self.merged()
        words, after = b == WORD, b == AFTER
        pairs = ~(words | after)
        counts = _classes(n[words])
        out = Summary(counts.sum(axis=1), (counts > 0).sum(axis=1), [(counts == k).sum(axis=1) for k in (1, 2)], int(words.sum()))
        out.set_pair_totals(int(pairs.sum()), [(_classes(n[pairs]) == k).sum(axis=1) for k in (1, 2)])
        own = counts[1] >= LEAST
        out.vocabulary, out.words = a[words][own], counts[:, own]
        size = len(out.vocabulary)
        out.left = np.bincount(_find(out.vocabulary, b[pairs]), minlength=size + 1)[:size]
        out.after = np.zeros((2, size + 1), np.int64)
        out.after[:, _find(out.vocabulary, a[after])] = _classes(n[after])
        out.after = out.after[:, :size]
        own = _classes(n[pairs])[1] >= LEAST_PAIR
        out.pairs = a[pairs][own], b[pairs][own], n[pairs][own]
        return out


def discounts(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Kneser and Ney's discount of each class, from the numbers of what it met once and twice."""
    return np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)


class Summary:
    """What the models need of counts: sums over everything, and the words and pairs that have a share of their own."""

    def __init__(self, size: np.ndarray, types: np.ndarray, met: list[np.ndarray], n_words: int):
        self.size, self.n_words = np.maximum(size, 1).astype(float), n_words
        self.discount = discounts(*met)
        #: What is taken off all words of a class goes to the shared continuation counts.
        self.rest = np.where(size > 0, self.discount * types / self.size, 1.0)

    def set_pair_totals(self, n_pairs: int, met: list[np.ndarray]) -> None:
        self.n_pairs, self.pair_discount = n_pairs, discounts(*met)


class Model:
    """Ratios of toxic to ordinary probabilities."""

    def __init__(self, c: Counts | Summary):
        c = c.summary() if isinstance(c, Counts) else c
        self.vocabulary = c.vocabulary
        #: A continuation: distinct left neighbours of a word, over those of all.
        shared = (c.left + NEW) / (c.n_pairs + NEW * (c.n_words + 1))
        self.p = np.maximum(c.words - c.discount[:, None], 0) / c.size[:, None] + c.rest[:, None] * shared
        self.others = np.maximum(1 - self.p.sum(axis=1), 1e-9)
        left, right, n = c.pairs
        u, v, counts = _find(self.vocabulary, left), _find(self.vocabulary, right), _classes(n)
        after = c.after + PRIOR
        own = np.maximum(counts - c.pair_discount[:, None], 0) / after[:, u]
        #: What a word leaves to the words that follow it by themselves.
        self.open = 1 - np.array([np.bincount(u, k, len(self.vocabulary)) for k in own])
        p = own + self.open[:, u] * self.p[:, v]
        self.word_ratio = np.append(self.p[1] / self.p[0], self.others[1] / self.others[0])  # the last: of all other words
        self.step = np.append(self.open[1] / self.open[0], 1.0)  # what comes of the word before, where the pair has no share
        keys = _pair_key(left, right)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ratio = keys[order], (p[1] / p[0])[order]
        self.maybe = np.zeros(1 << 20, bool)  # whether a pair may be there, by 20 bits of its key
        self.maybe[(self.pair_keys >> np.uint64(44)).astype(np.int64)] = True

    def small(self) -> Model:
        """What scoring needs."""
        out = object.__new__(Model)
        for name in ("vocabulary", "word_ratio", "step", "pair_keys", "pair_ratio", "maybe"):
            x = getattr(self, name)
            setattr(out, name, x.astype(np.float32) if x.dtype == np.float64 else x)
        return out

    @property
    def none(self) -> float:
        """The ratio of a text of other words alone."""
        return float(np.log(1 - MIX + MIX * float(self.word_ratio[-1])))

    def ratio(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio per word of each text; that of other words alone without words."""
        n = np.diff(bounds)
        if not len(hashes):
            return np.full(len(n), self.none)
        at = _find(self.vocabulary, hashes)
        each = self.word_ratio[at].astype(float)
        inner = _inner(bounds, len(hashes))
        each[inner] *= self.step[at[inner - 1]]
        keys = _pair_key(hashes[inner - 1], hashes[inner])
        some = np.flatnonzero(self.maybe[(keys >> np.uint64(44)).astype(np.int64)])
        place = _find(self.pair_keys, keys[some])
        there = place < len(self.pair_keys)
        each[inner[some[there]]] = self.pair_ratio[place[there]]
        sums = np.concatenate([[0], np.cumsum(np.log(1 - MIX + MIX * each))])
        return np.where(n > 0, (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1), self.none)


def fit_scale(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float, float]:
    """(a, b, unit): P(toxic) = logistic(a * x / unit + b), by damped Newton steps with a small ridge.

    Evidence for toxicity never lowers the score: where it would, all rows get the share of toxic ones. Without rows of
    both kinds a text counts as toxic when its words speak for it by a nat each.
    """
    if not len(x) or y.min() == y.max():
        return 1.0, -float(np.arcsinh(1 / UNIT)), 1.0
    unit, mean = float(np.std(x)) or 1.0, float(np.mean(x))
    z = np.stack([(x - mean) / unit, np.ones(len(x))], axis=1)
    ridge = np.array([1.0, 1e-3])  # a few rows alone do not make a steep scale
    w = np.zeros(2)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, z @ w).sum() - y @ (z @ w) + (ridge * w * w).sum() / 2)

    for _ in range(rounds):
        p = logistic(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if w[0] <= 0:
        return 0.0, float(np.log(y.mean() / (1 - y.mean()))), 1.0
    return float(w[0]), float(w[1] - w[0] * mean / unit), unit


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fold(id_: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds))


@dataclass
class ToxicityModel:
    model: Model
    scale: tuple[float, float, float] | None  # None: the score is the ratio's place on the scale itself

    def scored(self, docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
        """The score of every row, in the first column, beside the columns named in keep."""
        ship(docs.sparkSession)
        name, text = free("__score", keep), free("__text", keep)
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted = sent.value
            for batch in batches:
                parts = [fitted.model.ratio(hashes, bounds) for hashes, bounds, _ in word_hashes(batch.column(0))]
                # Few words of a long text speak for or against toxicity: the scale is logarithmic away from none.
                score = np.arcsinh(((np.concatenate(parts) if parts else np.zeros(0)) - fitted.model.none) / UNIT)
                if fitted.scale:
                    a, b, unit = fitted.scale
                    score = logistic(a * score / unit + b)
                yield pa.RecordBatch.from_arrays([pa.array(score), *batch.columns[1:]], [name, *keep])

        shape = StructType([StructField(name, DoubleType()), *(docs.schema[c] for c in keep)])
        return docs.select(F.col(text_col).cast("binary").alias(text), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, shape)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row. Null texts and those without words have the score of no evidence."""
        rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t"))
        return self.scored(rows, "__t", ("__id",)).select(F.col("__id").alias("doc_id"), F.col("__score").alias("score"))


def _gather(rows: DataFrame) -> Model:
    """The model of (text, toxic) rows: counts are aggregated as tables, and only words and pairs with a share of their own reach the driver."""
    rows = cut(rows)

    def counted(part: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, held = Counts(part), 0

            def out() -> Iterator[pa.RecordBatch]:
                x = counts.merged().view(np.int64)
                for at in range(0, x.shape[1], 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in x], ["a", "b", "n"])

            for batch in batches:
                toxic = batch.column(1).to_numpy(zero_copy_only=False)
                for hashes, bounds, first in word_hashes(batch.column(0)):
                    counts.add(hashes, bounds, toxic[first : first + len(bounds) - 1])
                    held += counts.rows[-1].shape[1]
                    if held > TAKE:
                        held = counts.merged().shape[1]
                    if held > TAKE // 2:
                        yield from out()
                        counts, held = Counts(part), 0
            yield from out()

        return rows.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))

    a, b, n = F.col("a"), F.col("b"), F.col("n")
    ordinary, toxic = F.shiftright("n", 32), n.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    met = [F.sum((c == k).cast("long")).alias(f"{name}{k}") for name, c in (("o", ordinary), ("t", toxic)) for k in (1, 2)]
    column = lambda t, c: t[c].to_numpy()
    both = lambda r, k: np.array([r[f"o{k}"] or 0, r[f"t{k}"] or 0])
    found = cut(counted(-1))
    r = found.where(b == WORD).agg(F.count("*").alias("rows"), F.sum(ordinary).alias("os"), F.sum(toxic).alias("ts"), F.sum((ordinary > 0).cast("long")).alias("oc"), F.sum((toxic > 0).cast("long")).alias("tc"), *met).first()
    made = Summary(both(r, "s"), both(r, "c"), [both(r, 1), both(r, 2)], r["rows"])
    # A row for each pair with a share of its own, and one for all others that end in a word.
    own = toxic >= LEAST_PAIR
    pairs = [cut(counted(k).groupBy("b", F.when(own, a).alias("a"), F.when(own, n).alias("n")).agg(F.count("*").alias("left"), *met)) for k in range(PASSES)]
    pairs = reduce(DataFrame.unionByName, pairs)
    r = pairs.agg(F.sum("left").alias("rows"), *(F.sum(f"{c}{k}").alias(f"{c}{k}") for c in "ot" for k in (1, 2))).first()
    made.set_pair_totals(r["rows"] or 0, [both(r, 1), both(r, 2)])
    zero = F.lit(0).cast("long")
    entry = lambda w, n=zero, after=zero, left=zero: [c.alias(k) for k, c in zip(("w", "n", "after", "left"), (w, n, after, left))]
    words = found.where((b == WORD) & (toxic >= LEAST)).select(entry(a, n=n)).unionByName(found.where((b == AFTER) & (toxic > 0)).select(entry(a, after=n))).unionByName(pairs.select(entry(b, left=F.col("left"))))
    words = words.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("n", "after", "left"))).where("n > 0").toArrow()
    words = words.take(pa.array(np.argsort(column(words, "w").view(np.uint64))))
    made.vocabulary, made.words = column(words, "w").view(np.uint64), _classes(column(words, "n"))
    made.left, made.after = column(words, "left"), _classes(column(words, "after"))
    told = pairs.where("a is not null").select("a", "b", "n").toArrow()
    made.pairs = column(told, "a").view(np.uint64), column(told, "b").view(np.uint64), column(told, "n")
    return Model(made).small()


def fit(docs: DataFrame, labels: DataFrame, train: Column, hold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Counts all texts with a label where train holds, and fits the scale on rows where hold does (conditions on __id).

    Of equal texts with equal labels the one of the smallest id counts: copies say nothing new of how often words are met.
    Labels other than 0 and 1 are left out, and so are ids with both; rows of docs that repeat an id with other texts count each.
    """
    ship(docs.sparkSession)
    labels = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__toxic")).where("__toxic in (0, 1)")
    labels = labels.groupBy("__id").agg(F.min("__toxic").alias("__toxic"), F.max("__toxic").alias("__most")).where("__toxic = __most").drop("__most")
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    # Labels grow with the documents, so they are not broadcast even where they would fit.
    hashed = docs.where(train).select("__id", F.xxhash64("__text").alias("__h")).join(labels.where(train).hint("merge"), "__id")
    first = cut(hashed.groupBy("__h", "__toxic").agg(F.min("__id").alias("__id")))
    rows = docs.where(train).withColumn("__h", F.xxhash64("__text")).join(first.hint("merge"), ["__id", "__h"]).select("__text", "__toxic")
    model = _gather(rows)
    # At most PICK_ROWS rows set the two numbers of the scale.
    held = labels.where(hold).orderBy(F.xxhash64("__id"), "__id").limit(PICK_ROWS)
    ratios = ToxicityModel(model, None).scored(docs.where(hold).join(F.broadcast(held), "__id"), "__text", ("__toxic",)).toPandas()
    return ToxicityModel(model, fit_scale(ratios["__score"].to_numpy(), ratios["__toxic"].to_numpy().astype(float)))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every row of documents. Null and empty texts have the score of no evidence; null ids are scored and never held out; repeated rows
    score alike; labels other than 0 and 1, or both for one id, are not learnt from. No rows give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    remainder = fold(F.col("__id"))
    fitted = fit(docs, table(spark, sf_dir, "labels"), remainder.isin(1, 2, 3), remainder == 4)
    out = fitted.score(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows scored at or above ``at``; the columns stay as they are.

    Null texts and those without words have the score of no evidence; rows that repeat are judged alike, null ids like any
    other. Without labels of both kinds nothing goes but what speaks clearly for toxicity; no rows give no rows.
    """
    remainder = fold(F.col("__id"))
    fitted = fit(docs, labels, remainder.isin(1, 2, 3), remainder == 4, id_col, text_col)
    scored = fitted.scored(docs, text_col, tuple(docs.columns))
    return scored.where(F.col(scored.columns[0]) < at).drop(scored.columns[0])
