"""What the operators of this subpackage share: tables, lineage cuts and columnar text kernels.

The text kernels work on the flat UTF-8 buffer of an Arrow column, so that words of many documents are
found and hashed by a few passes of numpy, with temporaries bounded by ``slices``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearspan.shipping import ship

#: White space of every word rule here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy kernels take at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Set while a frame is made that is written at once: its shuffle files go when they have been read.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Checkpoints go with the last reference to them.
_UNUSED = "spark.cleaner.referenceTracking.cleanCheckpoints"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the folder of spark.checkpoint.dir, which all executors share, and reads it from there.

    Its files go when nothing refers to the frame any more. Without that setting only a session on one machine may use a
    folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="nearspan-"))
    conf = sc._jsc.sc().conf()
    if not conf.contains(_UNUSED):
        conf.set(_UNUSED, "true")
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEAN, before)


def free(name: str, columns: Iterable[str]) -> str:
    """name, with underscores after it until no column is named so (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and where each begins (one more entry than values); null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold about ``most`` bytes each; a longer value is a range of its own."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[[32, 9, 10, 11, 12, 13]] = True
    return lut


def spans(gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without gap, not across values; and the first run of each value."""
    n = len(gap)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= gap[:-1] | edge[1:n]
    end = inside
    end = end.copy()
    end[:-1] &= gap[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spans() of the words that WORD matches."""
    return spans(_space()[data], offsets)


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        steps = np.full((2, max(n, SLICE_BYTES)), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        steps[:, 0] = 1
        _powers[:] = np.cumprod(steps, axis=1)
    return _powers[0][:n], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by one prefix sum of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
