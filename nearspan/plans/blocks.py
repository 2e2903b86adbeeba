"""Levenshtein joins by blocks: every query of a block against every target of another, by bounds that take few instructions.

Each edit takes away one symbol at most and adds one at most, so what the symbols' counts lack of each other bounds the
distance from below. Counts are unary bits (is there a first e, a second e, ...), so a pair's bound is a count of the bits
that both have. Bits may be left out, which only lowers bounds: those that tell strings apart best are kept. Pairs whose
bound does not rule them out get their exact distance. No pair is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.functions.batch import encode
from nearspan.shipping import ship

#: Longest string that is worth it: distances take time by the product of lengths.
LONGEST = 256
#: Strings of a block of queries and of targets, and what either would take if all were as long as the longest, at most.
QUERIES, TARGETS, CHARACTERS = 1 << 12, 1 << 16, 1 << 22
#: Numbers of 64 bits that hold a string's counts, and symbols that are counted.
WORDS, SYMBOLS = 3, 64
#: Pairs whose distances are computed in one go, and bounds that are held at once.
LANES, BOUNDS = 1 << 13, 1 << 23
#: Slack of a similarity that was divided and multiplied.
_SLACK = 1e-9


class Strings:
    """Strings of a block, shorter ones first, as numbers of the symbols of both blocks."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray):
        self.order = np.argsort(lengths, kind="stable")
        self.n = lengths[self.order]
        inside = np.arange(codes.shape[1]) < self.n[:, None]
        dense = np.searchsorted(alphabet, codes[self.order])
        self.k = len(alphabet)
        # Steps of the distance read a symbol of each string: a row for each place.
        self.codes = np.where(inside, dense, 0).astype(np.int32).T.copy()
        counted = min(self.k, SYMBOLS)
        kept = inside & (dense < counted) if counted < self.k else inside
        at = (np.arange(len(self.n))[:, None] * counted + dense)[kept]
        self.counts = np.bincount(at, minlength=len(self.n) * counted).reshape(len(self.n), counted)


def _alphabet(codes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Symbols, and the codes as ranks of symbols, frequent ones first; padding is -1 and no symbol."""
    seen, n = np.unique(np.concatenate([c.ravel() for c in codes]), return_counts=True)
    seen, n = seen[seen >= 0], n[seen >= 0]
    rank = np.empty(len(seen), np.int32)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(seen))
    return np.arange(len(seen)), [np.where(c >= 0, rank[np.minimum(np.searchsorted(seen, c), max(len(seen) - 1, 0))] if len(seen) else 0, -1) for c in codes]


def _signatures(q: Strings, t: Strings) -> list[list[np.ndarray]]:
    """For q and t, a list of words: bits of the counts that differ most."""
    columns = []
    for c in range(q.counts.shape[1]):
        for least in range(1, int(max(q.counts[:, c].max(), t.counts[:, c].max())) + 1):
            share = ((q.counts[:, c] >= least).mean() + (t.counts[:, c] >= least).mean()) / 2
            columns.append((share * (1 - share), c, least))
    columns = [x[1:] for x in sorted(columns, reverse=True) if x[0] > 0][: 64 * WORDS]
    out = []
    for side in (q, t):
        words = [np.zeros(len(side.n), np.uint64) for _ in range(max(1, -(-len(columns) // 64)))]
        for i, (c, least) in enumerate(columns):
            words[i // 64] |= (side.counts[:, c] >= least).astype(np.uint64) << np.uint64(i % 64)
        out.append(words)
    return out


class Pair:
    """A block of queries and one of targets."""

    def __init__(self, queries: list[str], targets: list[str]):
        x, m = encode(queries, -1)
        y, n = encode(targets, -1)
        alphabet, (x, y) = _alphabet([x, y])
        self.q, self.t = Strings(x, m, alphabet), Strings(y, n, alphabet)
        self.words = _signatures(self.q, self.t)
        self.sizes = [sum(np.bitwise_count(w) for w in words) for words in self.words]
        self.short = np.minimum(self.t.n, 255).astype(np.uint8)

    def bounds(self, i: int, low: int, high: int) -> np.ndarray:
        """Least distances of the i-th query and the targets from low to high, 255 at most."""
        met = sum(np.bitwise_count(w[low:high] & x[i]) for x, w in zip(*self.words))
        n, m = self.short[low:high], np.uint8(min(self.q.n[i], 255))
        return np.maximum(np.maximum(self.sizes[1][low:high], self.sizes[0][i]) - met, np.maximum(n, m) - np.minimum(n, m))

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = np.maximum(self.q.n[i], self.t.n[j])
        return np.where(most > 0, 1.0 - self.distances(i, j) / np.maximum(most, 1), 1.0)

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact distances of the i-th queries and the j-th targets."""
        out = np.empty(len(i), np.int64)
        # Long targets first: those that are done are then the last.
        words = np.maximum(-(-self.q.n[i] // 64), 1)
        order = np.lexsort((-self.t.n[j], words))
        words = words[order]
        begin = 0
        while begin < len(order):
            end = min(begin + LANES, int(np.searchsorted(words, words[begin], "right")))
            part = order[begin:end]
            out[part] = self._edits(i[part], j[part], int(words[begin]))
            begin = end
        return out

    def _places(self, i: np.ndarray, words: int) -> np.ndarray:
        """For each of the queries i, each symbol and each word, the places of the symbol as bits."""
        codes, n, k = self.q.codes[:, i], self.q.n[i], max(self.q.k, 1)
        found = np.zeros((words, len(i) * k), np.uint64)
        lane = np.arange(len(i)) * k
        for p in range(int(n.max(initial=0))):
            there = n > p
            found[p // 64, (lane + codes[p])[there]] |= np.uint64(1) << np.uint64(p % 64)
        return found

    def _edits(self, i: np.ndarray, j: np.ndarray, words: int) -> np.ndarray:
        """Vertical differences of the table of distances, as bits of words, a symbol of the target at a time."""
        zero, one, last = np.uint64(0), np.uint64(1), np.uint64(63)
        own, at = np.unique(i, return_inverse=True)
        places = self._places(own, words)
        at = at * max(self.q.k, 1)
        m, n = self.q.n[i], self.t.n[j]
        up = [np.full(len(i), ~zero) for _ in range(words)]
        down = [np.zeros(len(i), np.uint64) for _ in range(words)]
        for p in range(int(n.max(initial=0))):
            live = int(np.searchsorted(-n, -p))  # n > p
            where = at[:live] + self.t.codes[p, j[:live]]
            more, less = one, zero
            for w in range(words):
                eq, u, d = places[w].take(where), up[w][:live], down[w][:live]
                straight = eq | d
                if w:
                    eq |= less
                diagonal = (((eq & u) + u) ^ u) | eq
                right = d | ~(diagonal | d | u)
                left = (diagonal | d) & u
                if w + 1 < words:
                    carry = right >> last, left >> last
                right = (right << one) | more
                left = (left << one) | less if w else left << one
                straight = straight | diagonal
                u[:] = left | ~(straight | right)
                d[:] = right & straight
                if w + 1 < words:
                    more, less = carry
        out = n.copy()
        for w in range(words):
            there = np.clip(m - 64 * w, 0, 64).astype(np.uint64)
            mask = np.where(there == 64, ~zero, (one << (there % np.uint64(64))) - one)
            out += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask).astype(np.int64)
        return out


def near(pair: Pair, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, target, score) of the pairs of a similarity of t or more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def found():
        i, j = (np.concatenate(x) for x in zip(*held))
        held.clear()
        score = pair.scores(i, j)
        good = score >= t
        return i[good], j[good], score[good]

    edits = np.zeros(0)
    for i, m in enumerate(pair.q.n):
        if i == 0 or m != pair.q.n[i - 1]:
            low, high = np.searchsorted(pair.t.n, np.ceil(m * t - 1e-6)), np.searchsorted(pair.t.n, np.floor(m / t + 1e-6), "right")
            edits = np.floor((1.0 - t) * np.maximum(m, pair.t.n[low:high]) + 1e-6).astype(np.int16)
        j = np.flatnonzero(pair.bounds(i, low, high) <= edits) + low
        held.append((np.full(len(j), i), j))
        if sum(len(x) for x, _ in held) >= 8 * LANES:
            yield found()
    if held:
        yield found()


def nearest(pair: Pair, k: int, tie: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, target, score) of the k nearest targets of each query; of equally near ones those of the least tie go first.

    Targets are taken up by their bounds, nearest first, until no other can be as near as the k-th.
    """
    tie, count = tie[pair.t.order], len(pair.t.n)
    longest = int(pair.t.n[-1])
    step = max(1, BOUNDS // count)
    for first in range(0, len(pair.q.n), step):
        rows = range(first, min(first + step, len(pair.q.n)))
        bounds = [pair.bounds(i, 0, count) for i in rows]
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in rows]
        level, open_, want = [-1] * len(rows), list(range(len(rows))), 4 * k + 12
        while open_:
            picked = []
            for r in open_:
                m, kth = pair.q.n[rows[r]], best[r][1][k - 1] if len(best[r][1]) >= k else -np.inf
                # The largest bound that may still lead to a score of the k-th.
                limit = int(min(255, (1.0 - kth) * max(m, longest, 1) + 1e-6))
                to = level[r] + 1
                while to < limit and np.count_nonzero(bounds[r] <= to) < want:
                    to += 1
                j = np.flatnonzero((bounds[r] <= to) & (bounds[r] > level[r])) if level[r] >= 0 else np.flatnonzero(bounds[r] <= to)
                j = j[1.0 - bounds[r][j] / np.maximum(np.maximum(m, pair.t.n[j]), 1) >= kth - _SLACK]
                level[r] = to if to < limit else 255
                picked.append(j)
            i = np.repeat(np.array([rows[r] for r in open_]), [len(j) for j in picked])
            scores = np.split(pair.scores(i, np.concatenate(picked)), np.cumsum([len(j) for j in picked])[:-1])
            for r, j, score in zip(open_, picked, scores):
                j, score = np.concatenate([best[r][0], j]), np.concatenate([best[r][1], score])
                order = np.lexsort((tie[j], -score))[:k]
                best[r] = j[order], score[order]
            open_ = [r for r in open_ if level[r] < 255 and not (len(best[r][1]) >= k and (1.0 - best[r][1][k - 1]) * max(pair.q.n[rows[r]], longest, 1) + 1e-6 < level[r] + 1)]
            want *= 8
        yield np.repeat(np.array(rows), [len(j) for j, _ in best]), np.concatenate([j for j, _ in best]), np.concatenate([s for _, s in best])


def _met(find: Callable[[Pair, np.ndarray], Iterator]) -> Callable:
    """Of rows (g, side, s, i) by g, find() of each g's queries (side 0) and targets (side 1)."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sides = [rows.filter(pa.compute.equal(rows["side"], k)) for k in (0, 1)]
        if not all(x.num_rows for x in sides):
            return
        q, t = (x["s"].combine_chunks() for x in sides)
        pair = Pair(q.to_pylist(), t.to_pylist())
        for i, j, score in find(pair, sides[1]["i"].to_numpy()):
            for at in range(0, len(i), 1 << 16):
                x, y = (pa.array(o[p[at : at + (1 << 16)]]) for o, p in ((pair.q.order, i), (pair.t.order, j)))
                yield pa.RecordBatch.from_arrays([q.take(x), t.take(y), pa.array(score[at : at + (1 << 16)])], ["query", "target", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
            for begin, end in zip(starts, starts[1:]):
                if begin == end:
                    continue
                if held and held[0].column(0)[0].as_py() != g[begin]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def sizes(queries: DataFrame, targets: DataFrame) -> tuple[int, int, int]:
    """Numbers of queries and targets, and the longest of all."""
    (m, a), (n, b) = (df.agg(F.count("*"), F.coalesce(F.max(F.length(name)), F.lit(0))).first() for df, name in ((queries, "query"), (targets, "target")))
    return m, n, max(a, b)


def _joined(queries: DataFrame, targets: DataFrame, size: tuple[int, int, int], find: Callable) -> DataFrame:
    spark = queries.sparkSession
    ship(spark)
    m, n, longest = size
    blocks = lambda count, most: max(1, -(-count // most), -(-count * longest // CHARACTERS))
    y = blocks(n, TARGETS)
    x = max(blocks(m, QUERIES), min(-(-2 * spark.sparkContext.defaultParallelism // y), -(-m // 64), 1 << 10))
    block = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count).cast("long"))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    zero = F.lit(0).cast("long")
    a = queries.select((block("query", x) * y).alias("b"), every(y).alias("o"), F.lit(0).alias("side"), F.col("query").alias("s"), zero.alias("i"))
    b = targets.select(block("target", y).alias("b"), (every(x)).alias("o"), F.lit(1).alias("side"), F.col("target").alias("s"), (F.col("i") if "i" in targets.columns else zero).alias("i"))
    rows = a.select((F.col("b") + F.col("o")).alias("g"), "side", "s", "i").unionByName(b.select((F.col("b") + F.col("o") * y).alias("g"), "side", "s", "i"))
    return rows.repartition(x * y, "g").sortWithinPartitions("g").mapInArrow(_met(find), "query string, target string, score double")


def near_pairs(queries: DataFrame, targets: DataFrame, size: tuple[int, int, int], t: float) -> DataFrame:
    """Distinct (query) and (target) strings -> (query, target, score) of all pairs of a similarity of t or more, t above 0."""
    return _joined(queries, targets, size, lambda pair, _: near(pair, t))


def nearest_pairs(queries: DataFrame, targets: DataFrame, size: tuple[int, int, int], k: int) -> DataFrame:
    """Distinct (query) and (target, i) -> (query, target, score) of pairs that include the k nearest targets of each query, ties to smaller i."""
    return _joined(queries, targets, size, lambda pair, tie: nearest(pair, k, tie))
