"""Removal of passages that occur elsewhere, with an FM-index per shard.

Every window of 35 words is represented by its anchor, the 8-word gram of the least hash in it, so equal windows
share their anchor. Neighbouring windows of one anchor form a segment. The segments of an anchor that is met again meet
in a shard, whose FM-index holds each different one once, with the number of its occurrences as a weight. All segments
are then streamed against the index by backward search, and windows that occur twice are reported. An anchor of very
many different segments cannot be in one shard: its windows, which are of one length, are counted by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.llm.common import cut, flat, hash_spans, mix, slices, table, words
from nearspan.llm.fm_index import repeated_windows
from nearspan.shipping import ship

WINDOW, GRAM = 35, 8
#: An anchor of more different segments than this has its windows counted one by one.
HOT = 1 << 12
#: Segments of a shard, about: an anchor's segments are in one.
TAKE = 1 << 13

_BASE = np.uint64(0xD1342543DE82EF95)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values, by doubling."""
    out, have = h, 1
    parts = []
    n = len(h) - size + 1
    at = 0
    while size:
        if size & 1:
            parts.append((out[at : at + n], have))
            at += have
        size >>= 1
        if size:
            out = out[: len(out) - have] * np.uint64(pow(int(_BASE), have, 1 << 64)) + out[have:]
            have *= 2
    total = parts[0][0]
    for values, length in parts[1:]:
        total = total * np.uint64(pow(int(_BASE), length, 1 << 64)) + values
    return mix(total)


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def segments(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of the texts whose word hashes are h[bounds[i]:bounds[i + 1]].

    anchor: hash of the gram; content: hash of the segment's words; text: its text; first: first word of its first
    window, in the text; windows: how many; at: the gram's place in the segment.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("anchor", "content", "text", "first", "windows", "at")}
    if len(h) < window:
        return empty
    grams = _rolled(h, gram)
    span = window - gram + 1
    # Ordered by hash, then by place: the leftmost of equal grams is a window's anchor.
    low_bits = np.uint64(max(1, int(len(grams)).bit_length()))
    keyed = (grams >> low_bits << low_bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(keyed, span) & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.arange(len(anchor))
    inside = text[: len(anchor)] == text[start + window - 1]
    start, anchor = start[inside], anchor[inside]
    if not len(start):
        return empty
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
    first, at = start[new], anchor[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(start)])
    # One polynomial over the words; its powers are undone by the inverse.
    powers = np.full(len(h) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    inverse = np.full(len(h) + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    sums = np.r_[np.uint64(0), np.cumsum(h * powers[:-1])]
    content = mix((sums[first + count + window - 1] - sums[first]) * inverse[first] + (at - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64))
    return {"anchor": grams[at].view(np.int64), "content": content.view(np.int64), "text": text[first], "first": first - bounds[text[first]], "windows": count, "at": at - first}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, t): rows that repeat id and text are alike in all that follows."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t"))


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, ends, bounds = words(part, offsets[a : b + 1] - offsets[a])
                s = segments(hash_spans(part, starts, ends), bounds, window)
                text = pa.array(s["text"] + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["anchor"]), pa.array(s["content"]), batch.column(0).take(text), batch.column(1).take(text), *(pa.array(s[k].astype(np.int32)) for k in ("first", "windows", "at"))],
                    ["g", "s", "id", "th", "first", "n", "at"],
                )

    return rows.mapInArrow(run, "g long, s long, id long, th long, first int, n int, at int")


def _segment_words(rows: DataFrame, window: int) -> DataFrame:
    """(t, of: array of (g, s, first, n, at, c)) -> (g, s, at, c, w): the words of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, of in _hashed(batch):
                w = [h[x["first"] : x["first"] + x["n"] + window - 1].tobytes() for x in of]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in of], t) for c, t in (("g", pa.int64()), ("s", pa.int64()), ("at", pa.int32()), ("c", pa.int32()))), pa.array(w, pa.binary())], ["g", "s", "at", "c", "w"])

    return rows.mapInArrow(run, "g long, s long, at int, c int, w binary")


def _window_words(rows: DataFrame, window: int) -> DataFrame:
    """(t, of) as above -> (g, s, k, w): a hash of the words of each window of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, of in _hashed(batch):
                rolled = _rolled(h, window).view(np.int64)
                n = np.array([x["n"] for x in of])
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = rolled[np.repeat([x["first"] for x in of], n) + k]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(np.array([x[c] for x in of], np.int64), n)) for c in ("g", "s")), pa.array(k.astype(np.int32)), pa.array(w)], ["g", "s", "k", "w"])

    return rows.mapInArrow(run, "g long, s long, k int, w long")


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[dict]]]:
    """Hashes of the words of each text (t), with its segments (of)."""
    data, offsets = flat(batch.column(0))
    for row, of in enumerate(batch.column(1).to_pylist()):
        part = data[offsets[row] : offsets[row + 1]]
        starts, ends, _ = words(part, np.array([0, len(part)]))
        yield hash_spans(part, starts, ends), of


def _search(window: int):
    """Segments (g, s, at, c, w), sorted by anchor -> (g, s, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def search(rows: pa.Table) -> pa.RecordBatch:
            data, offsets = flat(rows["w"])
            mask = repeated_windows(np.frombuffer(data.tobytes(), np.uint64), offsets // 8, rows["at"].to_numpy().astype(np.int64), GRAM, window, rows["c"].to_numpy().astype(np.int64))
            some = np.flatnonzero(mask)
            return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()[some]) for c in ("g", "s")] + [pa.array(mask[some])], ["g", "s", "mask"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= TAKE:
                rows = pa.Table.from_batches(held)
                # An anchor's segments stay together: the last anchor may go on.
                keys = rows["g"].to_numpy()
                at = int(np.searchsorted(keys, keys[-1]))
                if at:
                    yield search(rows.slice(0, at))
                held = rows.slice(at).combine_chunks().to_batches()
        if held:
            yield search(pa.Table.from_batches(held))

    return run


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """_keyed() rows -> (i, h, spans): for the rows of an id and text hash, an array of (first, mask).

    Bit k of mask is set if the window that begins with word first + k starts anywhere else too.
    """
    anchors = _anchors(rows, window)
    # Most anchors are met once. They are told apart by counts alone, so that only the others' rows go any further.
    # Tables that are written first make the joins below joins of two plain exchanges, whose hot keys are split.
    met = cut(anchors.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select(F.col("g").alias("kg")))
    anchors = cut(anchors.join(met.hint("merge"), F.col("g") == F.col("kg")).drop("kg"))
    first = F.min(F.struct("id", "th", "first", "n", "at")).alias("x")
    alike = cut(anchors.groupBy("g", "s").agg(F.count("*").alias("c"), first))
    many = cut(alike.groupBy(F.col("g").alias("hg")).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hg", F.lit(True).alias("hot")))
    some_hot = bool(many.head(1))
    alike = cut(alike.join(many, F.col("g") == F.col("hg"), "left").withColumn("hot", F.coalesce("hot", F.lit(False))).drop("hg")) if some_hot else alike.withColumn("hot", F.lit(False))
    # The words of a segment are fetched from one text that has it. Twice is as good as more often.
    one = F.struct("g", "s", "x.first", "x.n", "x.at", F.least("c", F.lit(2)).cast("int").alias("c"), "hot")
    wanted = alike.groupBy(F.col("x.id").alias("i"), F.col("x.th").alias("h")).agg(F.collect_list(one).alias("of"))
    texts = rows.join(wanted.hint("merge"), rows["id"].eqNullSafe(wanted["i"]) & (rows["th"] == wanted["h"]))
    part = lambda hot: texts.select("t", F.filter("of", lambda x: x["hot"] == hot).alias("of")).where(F.size("of") > 0)
    segments_ = _segment_words(part(False), window).dropDuplicates(["g", "s"])  # rows that repeat id and text bring a segment again
    every = segments_.repartition("g").sortWithinPartitions("g").mapInArrow(_search(window), "g long, s long, mask long")
    if some_hot:
        # Such an anchor's windows are counted: one that has several places, in one segment or in many, occurs again.
        place = F.struct("s", "k")
        # One table for both kinds, so that texts are dealt out to their segments once.
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        both = cut(every.select("g", "s", "mask", none("int", "k"), none("long", "w")).unionByName(_window_words(part(True), window).select("g", "s", none("long", "mask"), "k", "w")))
        every, windows = both.where("mask is not null").select("g", "s", "mask"), both.where("w is not null").select("g", "s", "k", "w")
        again = cut(windows.groupBy(F.col("g").alias("wg"), F.col("w").alias("ww")).agg((F.min(place) != F.max(place)).alias("again")).where("again").drop("again"))
        hot = windows.join(again.hint("merge"), (F.col("g") == F.col("wg")) & (F.col("w") == F.col("ww"))).select("g", "s", F.expr("shiftleft(1L, k)").alias("mask"))
        every = every.unionByName(alike.where("hot AND c > 1").select("g", "s", F.lit(-1).cast("long").alias("mask"))).unionByName(hot)
    masks = cut(every.groupBy(F.col("g").alias("mg"), F.col("s").alias("ms")).agg(F.bit_or("mask").alias("mask")))
    hit = anchors.join(masks.hint("merge"), (F.col("g") == F.col("mg")) & (F.col("s") == F.col("ms")))
    span = F.struct("first", F.col("mask").bitwiseAND(F.expr("shiftleft(1L, n) - 1")).alias("mask"))
    return hit.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.collect_set(span).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row of docs.

    A word goes if a window over it occurs anywhere else, in the same text or another; windows are judged on the input,
    so all copies of a passage go. Null texts have no words. Rows that repeat are copies of each other.
    """
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, window)
    both = rows.join(spans.hint("merge"), rows["id"].eqNullSafe(spans["i"]) & (rows["th"] == spans["h"]), "left").select("id", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else []))}
            for text, found in zip(batch.column(1), batch.column(2)):
                tokens = text.as_buffer().to_pybytes().split()
                n = len(tokens)
                if found.is_valid and len(found):
                    edges = np.zeros(n + 1, np.int64)
                    first, mask = found.values.field(0).to_numpy().astype(np.int64), found.values.field(1).to_numpy()
                    row, k = np.nonzero((mask[:, None] >> np.arange(window)) & 1)
                    np.add.at(edges, first[row] + k, 1)
                    np.add.at(edges, first[row] + k + window, -1)
                    tokens = [tokens[i] for i in np.flatnonzero(np.cumsum(edges)[:n] == 0)]
                kept = b" ".join(tokens)
                for name, v in zip(out, (n, n - len(tokens), hashlib.sha256(kept).hexdigest(), kept)):
                    out[name].append(v)
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds[k]) for k, v in out.items())], ["doc_id", *out])

    found = both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if keep_text else ""))
    return found.withColumn("kept", F.col("kept").cast("string")) if keep_text else found


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: see without_repeats for null texts, repeated rows and copies."""
    return without_repeats(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)
), again AS (
  SELECT r, s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM again
), per AS (
  SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r
), word AS (
  SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT word.r, string_agg(t, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(per.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN per ON d.r = per.r LEFT JOIN kept ON d.r = kept.r
"""
