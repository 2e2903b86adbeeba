"""Best-fit packing of tokenised documents by sums of squares.

A piece goes to the open sequence, or a new one, for which the sum over residual gaps of the squared
number of open sequences with that gap becomes smallest. Pieces are packed in groups of bounded size, each
in descending order of length, so that short pieces close the gaps that long ones leave.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.llm.common import cut, table
from nearspan.shipping import ship

#: Pieces of a packing group, on average.
GROUP = 1 << 15
#: Words whose ids a Python worker keeps, twice: those of late and those before.
CACHE = 250_000

_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Texts of other characters, or with what may be a special token, go through the tokenizer as a whole.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-©«¬®±´¶-¸»¿-ÿı-ňŊ-ſΑ-ΡΤ-Ωα-ωА-яぁ-んァ-ヶ一-龥가-힣‐-‧]")


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, k in tokenizer.get_vocab().items():
        ends[k] = token.endswith("</w>")
    return tokenizer, ends, {}, {}


def token_ids(text: str, path: str | None = None) -> bytes:
    """Ids of the text as little-endian 32-bit integers, without special tokens.

    The tokenizer splits into words before it merges, so the ids of plain texts are joined from those of
    their words, which repeat. In plain texts lower() is all that its normalizer does.
    """
    tokenizer, ends, known, older = _tokenizer(path)
    if "<|" in text or _ODD.search(text):
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    found = text.lower().split()
    new = list(set(found).difference(known))
    if new and older:
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in known]
    for at in range(0, len(new), 4000):
        part = new[at : at + 4000]
        ids = np.array(tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
        # Each piece of a word ends with an id that ends words, and so does the word.
        stops = (np.flatnonzero(ends[ids]) + 1)[np.cumsum([len(_PIECE.findall(w)) for w in part]) - 1]
        if stops[-1] != len(ids):
            raise ValueError("the tokenizer does not end every word")
        known.update(zip(part, [x.tobytes() for x in np.split(ids, stops[:-1])]))
    out = b"".join([known[w] for w in found])
    if len(known) > CACHE:
        older.clear()
        older.update(known)
        known.clear()
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each row's text and end_id, cut where longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py() or "", path) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((id_, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths from 1 to capacity, placed in descending order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_ = np.zeros(capacity + 1, np.int64)  # sequences by residual gap; a full one is not open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    never, n = np.int64(1 << 40), 0
    leave = np.full(capacity + 1, never)  # change of the sum when a sequence leaves this gap
    enter = np.ones(capacity + 1, np.int64)
    enter[0], leave[capacity] = 0, 0  # a new sequence leaves no gap of an open one
    for i in order:
        s = int(lengths[i])
        g = s + int(np.argmin(leave[s:] + enter[: capacity + 1 - s]))
        if g == capacity:
            at, n = n, n + 1
        else:
            at = stacks[g].pop()
            open_[g] -= 1
            c = open_[g]
            leave[g], enter[g] = (1 - 2 * c if c else never), 2 * c + 1
        bins[i], offsets[i] = at, capacity - g
        if r := g - s:
            stacks[r].append(at)
            open_[r] += 1
            leave[r], enter[r] = 1 - 2 * open_[r], 2 * open_[r] + 1
    return bins, offsets


def pack(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces() rows with sequence_id and offset (gapless from 0) beside them.

    Rows are dealt to groups of about GROUP pieces by a hash, and each group is packed for itself; the pieces of
    one document may be in several sequences. Repeated rows are packed as often as they are there.
    """
    ship(found.sparkSession)
    found = cut(found)
    groups = max(1, -(-found.count() // GROUP))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("g").sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array((np.int64(key[0].as_py()) << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = found.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Every row of docs as pieces in sequences of at most capacity tokens.

    Null texts count as empty: one piece, end_id. Null ids stay null. An empty table gives no rows.
    """
    return pack(pieces(docs, id_col, text_col, capacity, end_id, path), capacity)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
