"""SimHash near-dedup over a Gray-ordered hierarchical index of fingerprints.

Fingerprints within ``max_diff`` differing bits agree on one of ``max_diff + 1`` blocks of their bits, so
each distinct fingerprint goes to one group per block. In a group the fingerprints are sorted by Gray
rank, under which those that share leading bits are neighbours; nodes of eight levels hold the bits that
their whole range shares. Two nodes are compared once for all that is below them: the differences of the
shared bits add up from level to level, and a pair of nodes past ``max_diff`` is pruned with all its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.llm.common import cut
from nearspan.llm.components import components
from nearspan.shipping import ship

#: A group of more fingerprints than this is dealt out once more, by blocks of its other bits.
HOT_GROUP = 1 << 12
#: Rows that a task takes up before it joins the groups it has, and node pairs that it holds at once.
TAKE, FRONTIER = 1 << 17, 1 << 20
#: Up to so many ids of copies are sent to all tasks (16 MB or so), and texts stay where they are.
SENT_IDS = 1 << 20


def fingerprint(text: bytes, size: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, A-Z lowered; no words: 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_digest
    if len(tokens) < size:
        hashed = [digest(b" ".join(tokens), 42)]
    else:
        hashed = [digest(b" ".join(s), 42) for s in zip(*(tokens[i:] for i in range(size)))]
    n, counts = len(hashed), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = np.frombuffer(b"".join(hashed[i : i + (1 << 14)]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp long, signed) of every row; a null text has no words, and so fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _roots(label)
    return label


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def link_groups(group: np.ndarray, fp: np.ndarray, max_diff: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For rows of several groups: (row, root) such that rows of one group that links join share their root.

    group: equal for rows of one group; fp: uint64. Rows that reach no other have no entry.
    """
    rank = gray_rank(fp)
    order = np.lexsort((rank, group))
    group, fp, rank = group[order], fp[order], rank[order]
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    starts = [np.flatnonzero(new)]  # of the nodes of each level
    for level in range(1, 9):
        shared = rank >> np.uint64(64 - 8 * level)
        new = new.copy()
        new[1:] |= shared[1:] != shared[:-1]
        starts.append(np.flatnonzero(new))
    kids = [np.append(np.searchsorted(starts[k + 1], starts[k]), len(starts[k + 1])) for k in range(8)]
    pattern = [None, *((fp[starts[k]] >> np.uint64(64 - 8 * k)).astype(np.uint8) for k in range(1, 9))]
    label = np.arange(n)
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= max_diff))
    label = _union(label, near, near + 1)
    # Equal fingerprints of a group are one leaf; the neighbours' links have joined them.
    top = np.flatnonzero(np.diff(np.append(starts[0], n)) > 1)
    stack = [(0, top, top, np.zeros(len(top), np.uint8))]
    joined = True
    while stack:
        level, a, b, acc = stack.pop()
        if joined:
            low = [np.minimum.reduceat(label, s) for s in starts]
            high = [np.maximum.reduceat(label, s) for s in starts]
            joined = False
        # What is in one component already needs no comparing.
        open_ = ~((low[level][a] == high[level][a]) & (low[level][b] == high[level][b]) & (low[level][a] == low[level][b]))
        a, b, acc = a[open_], b[open_], acc[open_]
        if not len(a):
            continue
        if level == 8:
            before, label = label, _union(label.copy(), starts[8][a], starts[8][b])
            joined = not np.array_equal(before, label)
            continue
        at = kids[level]
        na, nb = at[a + 1] - at[a], at[b + 1] - at[b]
        made = np.cumsum(na * nb)
        if made[-1] > FRONTIER and len(a) > 1:
            half = min(max(1, int(np.searchsorted(made, made[-1] // 2))), len(a) - 1)
            stack += [(level, a[half:], b[half:], acc[half:]), (level, a[:half], b[:half], acc[:half])]
            continue
        pair = np.repeat(np.arange(len(a)), na * nb)
        k = _ranges(na * nb)
        x, y = at[a[pair]] + k // nb[pair], at[b[pair]] + k % nb[pair]
        bits = pattern[level + 1]
        total = acc[pair] + np.bitwise_count(bits[x] ^ bits[y])
        keep = (total <= max_diff) & ((a[pair] != b[pair]) | (x <= y))
        if level == 7:
            keep &= x != y
        stack.append((level + 1, x[keep], y[keep], total[keep]))
    away = np.flatnonzero(label != np.arange(n))
    return order[away], order[label[away]]


def _join_sorted(max_diff: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def join(rows: np.ndarray) -> pa.RecordBatch:
            row, root = link_groups(rows[0], rows[1].view(np.uint64), max_diff)
            return pa.RecordBatch.from_arrays([pa.array(rows[2][row]), pa.array(rows[2][root])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(k).to_numpy() for k in range(3)]))
            if sum(h.shape[1] for h in held) >= TAKE:
                rows = np.concatenate(held, axis=1)
                cut_at = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
                held = [rows[:, cut_at:]]
                if cut_at:
                    yield join(rows[:, :cut_at])
        if held and (rows := np.concatenate(held, axis=1)).shape[1]:
            yield join(rows)

    return run


def link_fingerprints(fps: DataFrame, max_diff: int = 3) -> DataFrame:
    """(id, fp) with distinct fp -> (a, b): links whose components are those of all pairs within max_diff bits."""
    if max_diff != 3:
        raise ValueError("blocks are laid out for three differing bits")
    mask = F.lit(0xFFFF).cast("long")
    blocks = [(F.shiftrightunsigned("fp", 16 * b).bitwiseAND(mask) + F.lit(b << 16)) for b in range(4)]
    keys = fps.select("id", "fp", F.explode(F.array(*blocks)).alias("k"))
    # At most 4 * 65536 groups exist, whatever the input: their counts may be broadcast.
    hot = keys.groupBy("k").count().where(F.col("count") > HOT_GROUP).select("k", F.lit(True).alias("hot"))
    keys = keys.join(F.broadcast(hot), "k", "left")
    # The other 48 bits, next to each other: of these a pair agrees on one of four blocks of 12.
    block = F.shiftright("k", 16)
    rest = F.when(block == 0, F.shiftrightunsigned("fp", 16))
    for b in (1, 2, 3):
        below = F.col("fp").bitwiseAND(F.lit((1 << 16 * b) - 1).cast("long"))
        above = F.shiftleft(F.shiftrightunsigned("fp", 16 * b + 16), 16 * b) if b < 3 else F.lit(0).cast("long")
        rest = rest.when(block == b, above.bitwiseOR(below))
    finer = [F.lit((b + 1) << 12) + F.shiftrightunsigned(rest, 12 * b).bitwiseAND(F.lit(0xFFF).cast("long")) for b in range(4)]
    keys = keys.withColumn("s", F.explode(F.when(F.col("hot"), F.array(*finer)).otherwise(F.array(F.lit(0).cast("long")))))
    keys = keys.select((F.col("k") * 65536 + F.col("s")).alias("g"), "fp", "id")
    return keys.repartition("g").sortWithinPartitions("g").mapInArrow(_join_sorted(max_diff), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its fingerprint and near-duplicate group.

    Returns (doc_id, fingerprint, component_id). Rows with a null id link like any other, also where they alone join two
    groups; a group's id is the smallest id that is not null, and null where all its ids are. Repeated ids are kept as
    rows. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    # Copies are one leaf: links are looked for between distinct fingerprints alone, which are their own nodes.
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(link_fingerprints(distinct.select(F.col("fp").alias("id"), "fp")))
    grouped = cut(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("root")))
    least = grouped.groupBy(F.col("root").alias("of")).agg(F.min("id").alias("component_id"))
    named = grouped.join(least, F.col("root") == F.col("of")).select("fp", "component_id")
    return fps.join(named, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose group has a smaller id; all columns stay.

    Rows with a null id stay. Rows of one id stay together, and go only if all of them have a group with a smaller id.
    """
    groups = simhash_groups(docs, id_col, text_col).where("doc_id is not null")
    gone = groups.groupBy(F.col("doc_id").alias("__gone_id")).agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("__gone")).where("__gone")
    gone = cut(gone.select("__gone_id"))
    # Else texts are dealt out by id, but not sorted.
    gone = F.broadcast(gone) if gone.count() <= SENT_IDS else gone.hint("shuffle_hash")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone_id"], "left_anti")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: see simhash_groups for null texts and ids, repeated rows and empty tables."""
    from nearspan.llm.common import table

    return simhash_groups(table(spark, sf_dir, "documents"))
