"""Quality by a byte-level convolutional network in numpy.

Filters over windows of four bytes run over the whole text; each filter's responses are max-pooled over
overlapping chunks, and the mean and the maximum over all chunks are combined into one probability. A text
of any length is taken block by block, so memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from nearspan.llm.common import flat, slices, table
from nearspan.shipping import ship

WIDTH, FILTERS, EMBEDDING = 4, 16, 8
#: Half a chunk: chunks overlap by this many bytes. The symbol that stands around a text.
HALF, PAD = 128, 256
#: The labelled rows that the network is fitted on: so many at most, of so many bytes at most.
TRAIN_ROWS, TRAIN_BYTES = 3000, 1 << 15
EPOCHS, BATCH, RATE = 6, 16, 0.01


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each padded by WIDTH - 1 symbols at least to whole blocks of HALF; first block of each."""
    lengths = np.diff(offsets)
    count = -(-(lengths + WIDTH - 1) // HALF)
    first = np.concatenate([[0], np.cumsum(count)])
    symbols = np.full(first[-1] * HALF + WIDTH - 1, PAD, np.int32)
    at = np.repeat(first[:-1] * HALF - offsets[:-1], lengths) + np.arange(offsets[0], offsets[-1])
    symbols[at] = data[offsets[0] : offsets[-1]]
    return symbols, first


def crossing(first: np.ndarray) -> np.ndarray:
    """Windows that begin in one text and end in the next, in order: they count for neither."""
    return (first[1:, None] * HALF - np.arange(WIDTH - 1, 0, -1)).ravel()


def chunk_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of the two blocks of each chunk (the last chunk of a text of one block has but one), and each text's first chunk."""
    count = np.maximum(1, np.diff(first) - 1)
    start = np.concatenate([[0], np.cumsum(count)])
    return np.arange(start[-1]) - np.repeat(start[:-1] - first[:-1], count), start


@dataclass
class Network:
    embedding: np.ndarray  # (PAD + 1, EMBEDDING)
    filters: np.ndarray  # (WIDTH, EMBEDDING, FILTERS)
    bias: np.ndarray
    top: np.ndarray  # (2 * FILTERS,)
    shift: np.ndarray  # (1,)

    @classmethod
    def new(cls, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (PAD + 1, EMBEDDING)), rng.normal(0, 0.5, (WIDTH, EMBEDDING, FILTERS)), np.zeros(FILTERS),
            rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1),
        )

    def tables(self) -> np.ndarray:
        """What each symbol adds to each filter at each place of the window."""
        return np.einsum("se,wef->wsf", self.embedding, self.filters)

    def pair_tables(self) -> list[np.ndarray]:
        t = self.tables()
        return [np.ascontiguousarray((t[k][:, None] + t[k + 1][None]).reshape(-1, FILTERS), np.float32) for k in range(0, WIDTH, 2)]

    def pooled(self, symbols: np.ndarray, first: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """Maximum of each filter over each block."""
        n = len(symbols) - WIDTH + 1
        out_of = crossing(first)
        out = np.empty((n // HALF, FILTERS), np.float32)
        step = 256
        for b in range(0, len(out), step):
            part = symbols[b * HALF : min(n, (b + step) * HALF) + WIDTH - 1]
            code = part[:-1] * (PAD + 1) + part[1:]
            m = len(part) - WIDTH + 1
            r = np.take(pairs[0], code[:m], axis=0)
            r += np.take(pairs[1], code[2 : m + 2], axis=0)
            i, j = np.searchsorted(out_of, (b * HALF, b * HALF + m))
            r[out_of[i:j] - b * HALF] = -np.inf
            out[b : b + step] = r.reshape(-1, HALF, FILTERS).max(axis=1)
        return np.maximum(out + self.bias.astype(np.float32), 0)

    def probability(self, data: np.ndarray, offsets: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        symbols, first = blocks_of(data, offsets)
        block = self.pooled(symbols, first, pairs)
        left, start = chunk_bounds(first)
        last = np.repeat(first[1:] - 1, np.diff(start))
        chunk = np.maximum(block[left], block[np.minimum(left + 1, last)])
        mean = np.add.reduceat(chunk, start[:-1], axis=0, dtype=np.float64) / np.diff(start)[:, None]
        most = np.maximum.reduceat(chunk, start[:-1], axis=0)
        z = np.concatenate([mean, most], axis=1) @ self.top + self.shift[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss; gradients go to the one place of each chunk that each filter's maximum is at."""
    net = Network.new(seed)
    if not len(texts) or labels.min() == labels.max():
        net.top[:] = 0
        net.shift[0] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        return net
    rng = np.random.default_rng(seed + 1)
    names = ("embedding", "filters", "bias", "top", "shift")
    first_moment, second_moment, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    column = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in picked])])
            symbols, first = blocks_of(np.frombuffer(b"".join(texts[i] for i in picked), np.uint8), offsets)
            tables = net.tables().astype(np.float32)
            n = len(symbols) - WIDTH + 1
            r = sum(np.take(tables[k], symbols[k : n + k], axis=0) for k in range(WIDTH))
            r[crossing(first)] = -np.inf
            r = r.reshape(-1, HALF, FILTERS)
            place = r.argmax(axis=1)
            block = np.take_along_axis(r, place[:, None], axis=1)[:, 0] + net.bias
            place += (np.arange(len(place)) * HALF)[:, None]
            left, start = chunk_bounds(first)
            right = np.minimum(left + 1, np.repeat(first[1:] - 1, np.diff(start)))
            from_right = block[right] > block[left]
            chunk = np.maximum(np.where(from_right, block[right], block[left]), 0)
            where = np.where(from_right, place[right], place[left])
            count = np.diff(start)
            mean = np.add.reduceat(chunk, start[:-1], axis=0) / count[:, None]
            most = np.maximum.reduceat(chunk, start[:-1], axis=0)
            seen = np.concatenate([mean, most], axis=1)
            p = 1 / (1 + np.exp(-np.clip(seen @ net.top + net.shift[0], -30, 30)))
            error = (p - labels[picked]) / len(picked)
            text = np.repeat(np.arange(len(picked)), count)
            is_most = chunk == most[text]
            shares = np.add.reduceat(is_most, start[:-1], axis=0)
            down = error[text][:, None] * (net.top[:FILTERS] / count[text][:, None] + net.top[FILTERS:] * is_most / shares[text]) * (chunk > 0)
            by_table = np.zeros((WIDTH, PAD + 1, FILTERS))
            for k in range(WIDTH):
                flat_at = symbols[where + k] * FILTERS + column
                by_table[k] = np.bincount(flat_at.ravel(), down.ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
            slopes = {
                "embedding": np.einsum("wsf,wef->se", by_table, net.filters), "filters": np.einsum("wsf,se->wef", by_table, net.embedding), "bias": down.sum(axis=0),
                "top": seen.T @ error + 1e-4 * net.top, "shift": np.array([error.sum()]),
            }
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for name, g in slopes.items():
                first_moment[name] = 0.9 * first_moment[name] + 0.1 * g
                second_moment[name] = 0.999 * second_moment[name] + 0.001 * g * g
                getattr(net, name)[...] -= rate * (first_moment[name] / (1 - 0.9**t)) / (np.sqrt(second_moment[name] / (1 - 0.999**t)) + 1e-8)
    return net


def fold(id_: Column, folds: int = 3) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Trains on TRAIN_ROWS labelled rows at most, picked by a hash of their ids among those where usable (a condition on __id) holds."""
    labels = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__label in (0, 1)").where(usable)
    labels = labels.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most")).where("__label = __most").drop("__most")
    picked = labels.orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text")).where(F.octet_length("__text") <= TRAIN_BYTES)
    # Repeated ids could bring more rows than labels; the bound holds for texts as well.
    rows = texts.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__label").alias("__label"))
    rows = rows.orderBy("__id").limit(TRAIN_ROWS).collect()
    return train([bytes(r["__text"]) for r in rows], np.array([r["__label"] for r in rows], float))


def scored(net: Network, docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """__score of every row, the probability of label 1, beside the columns named in keep (of other names)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some thousands of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        pairs = fitted.pair_tables()
        for batch in batches:
            data, offsets = flat(batch.column(0))
            parts = [fitted.probability(data, offsets[a : b + 1], pairs) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.zeros(0)), *batch.columns[1:]], ["__score", *keep])

    shape = StructType([StructField("__score", DoubleType()), *(docs.schema[c] for c in keep)])
    return docs.select(F.col(text_col).cast("binary").alias("__text"), *keep).mapInArrow(run, shape)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Labels are learnt from ids whose crc32 modulo 3 is not 1. Null texts count as empty, and empty texts have the
    score of one padded block; without labels of both kinds all rows have their share. No rows give no rows.
    """
    net = fit(docs, labels, fold(F.col("__id")) != 1, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t"))
    return scored(net, rows, "__t", ("__id",)).select(
        F.col("__id").alias("doc_id"), F.coalesce(fold(F.col("__id")) == 1, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
