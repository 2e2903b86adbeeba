"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are turned onto their principal axes and sorted by the grid cells of the leading ones. The
sorted sequence is cut into blocks; two blocks are joined only if their boxes come within epsilon of each
other, and the join halves both sequences again and again, skipping halves whose boxes are too far apart.
In what is left, a bound from the leading axes and the length of the rest skips pairs before the whole
cosine is computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.llm.common import cut, table
from nearspan.llm.components import components
from nearspan.llm.simhash import _union
from nearspan.llm.vectors import column_matrix, matrix, unit, valid

#: Different vectors of a block, and rows of one at most (copies included); the shortest sequence that is halved no more; leading axes; vectors that set the axes.
BLOCK, ROWS, LEAF, LEAD, AXES_ROWS = 1 << 15, 1 << 18, 512, 16, 4096
#: Grid columns by which the sequence is ordered, and those by which boxes of blocks meet; pairs of blocks that may be broadcast.
GRID, SLABS, FEW_PAIRS = 4, 2, 1 << 17


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those of most variance first. Any such basis keeps results as they are."""
    _, axes = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(sample.shape[1]))
    return np.ascontiguousarray(axes[:, ::-1])


def _far(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, eps2: float) -> bool:
    gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    return float(gap @ gap) > eps2 + 1e-9


class Sequence:
    """A block's vectors, in grid order: unit vectors, their places on the leading axes, and what bounds a cosine."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.unit = unit(x)
        turned = self.unit @ axes[:, :LEAD]
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", turned, turned)))
        self.lead = turned
        self.bound = np.concatenate([turned, rest[:, None]], axis=1).astype(np.float32)


def join_sequences(a: Sequence, b: Sequence, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with cosine of at least ``least``; i < j where both are the same sequence."""
    eps2 = 2 - 2 * least
    stack = [(0, len(a.unit), 0, len(b.unit))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if same and j1 <= i0:
            continue
        x, y = a.lead[i0:i1], b.lead[j0:j1]
        if _far(x.min(axis=0), x.max(axis=0), y.min(axis=0), y.max(axis=0), eps2):
            continue
        if i1 - i0 > LEAF or j1 - j0 > LEAF:
            i, j = (i0 + i1) // 2, (j0 + j1) // 2
            stack += [(p, q, r, s) for p, q in ((i0, i), (i, i1)) for r, s in ((j0, j), (j, j1)) if p < q and r < s]
            continue
        near = a.bound[i0:i1] @ b.bound[j0:j1].T >= least - 1e-4
        if same and i0 == j0:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if len(i) > 4096:
            cosine = (a.unit[i0:i1] @ b.unit[j0:j1].T)[i, j]
        else:
            cosine = np.einsum("ij,ij->i", a.unit[i0 + i], b.unit[j0 + j])
        linked = cosine >= least
        if linked.any():
            yield i0 + i[linked], j0 + j[linked]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    return np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)]) if len(x) else np.zeros(0, np.int64)


def embedding_blocks(found: DataFrame, dims: int, kind: str, eps: float) -> tuple[DataFrame, np.ndarray]:
    """Blocks of the grid-ordered sequence (block, low, high, ids, of, data), and the axes of the grid.

    data: the different vectors of the block; ids: of all its rows; of: which vector each row has. Equal vectors are
    neighbours in the order, so they are one vector of a block, or of a few blocks where they are very many.
    """
    spark = found.sparkSession
    sample = found.orderBy(F.xxhash64("id"), "id").limit(AXES_ROWS).select("v").toArrow()["v"].combine_chunks()
    axes = spark.sparkContext.broadcast(principal_axes(unit(column_matrix(sample, dims, kind))))  # dims * dims numbers
    cells = [f"c{k}" for k in range(min(GRID, dims))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = unit(column_matrix(batch.column(1), dims, kind)) @ axes.value[:, : len(cells)]
            # Half-width cells keep boxes apart that full ones would let touch.
            grid = np.floor(turned / (eps / 2)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(g) for g in grid.T)], ["id", "v", *cells])

    element = "double" if kind == "<f8" else "float"
    placed = found.mapInArrow(place, f"id long, v array<{element}>, {', '.join(f'{c} int' for c in cells)}").withColumn("h", F.xxhash64("v"))
    parts = max(1, -(-found.count() // BLOCK))
    ordered = placed.repartitionByRange(parts, *cells, "h", "id").sortWithinPartitions(*cells, "h", "id").select("id", "v")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nth, ids, rows, held = TaskContext.get().partitionId() << 32, [], [], 0

        def block(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            first = _runs(x)
            of, x = np.repeat(np.arange(len(first), dtype="<i4"), np.diff(np.r_[first, len(x)])), x[first]
            turned = unit(x) @ axes.value[:, :LEAD]
            return pa.RecordBatch.from_pydict(
                {"block": [nth], "low": [turned.min(axis=0).tolist()], "high": [turned.max(axis=0).tolist()], "ids": [i.astype("<i8").tobytes()], "of": [of.tobytes()], "data": [x.tobytes()]},
                pa.schema([("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("of", pa.binary()), ("data", pa.binary())]),
            )

        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            rows.append(column_matrix(batch.column(1), dims, kind))
            held += len(ids[-1])
            while held >= 2 * BLOCK:
                i, x = np.concatenate(ids), np.concatenate(rows)
                first = _runs(x)
                # A block ends where its last vector's run does, unless that is too long.
                end = int(min(first[BLOCK] if len(first) > BLOCK else held, ROWS))
                if end == held and held < ROWS:
                    break
                yield block(i[:end], x[:end])
                ids, rows, held, nth = [i[end:]], [x[end:]], held - end, nth + 1
        while held:
            i, x = np.concatenate(ids), np.concatenate(rows)
            first = _runs(x)
            end = int(min(first[BLOCK] if len(first) > BLOCK else held, ROWS))
            yield block(i[:end], x[:end])
            ids, rows, held, nth = [i[end:]], [x[end:]], held - end, nth + 1

    return cut(ordered.mapInArrow(blocks, "block long, low array<double>, high array<double>, ids binary, of binary, data binary")), axes


def embedding_links(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, root, n) rows: n links that id has in one pair of blocks, and a vector that it is linked with, directly or not."""
    spark = vectors.sparkSession
    found, dims, kind = valid(vectors, id_col, vector_col)
    if not dims:
        return spark.createDataFrame([], "id long, root long, n long")
    eps = float(np.sqrt(2 - 2 * least))
    made, axes = embedding_blocks(found, dims, kind, eps)
    boxes = made.select("block", "low", "high")
    slab = lambda name, k: F.floor(F.coalesce(F.get(name, F.lit(k)), F.lit(0.0)) / eps).cast("int")
    near = lambda k, more: F.sequence(slab("low", k) - more, slab("high", k) + more)
    left, right = (boxes.select(F.col("block").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}"), F.col("low"), F.col("high")) for n in "ab")
    for k in range(SLABS):
        left, right = left.withColumn(f"s{k}", F.explode(near(k, 1))), right.withColumn(f"s{k}", F.explode(near(k, 0)))
    keys = [f"s{k}" for k in range(SLABS)]
    apart = F.aggregate(F.sequence(F.lit(1), F.size("low_a")), F.lit(0.0), lambda s, k: s + F.pow(F.greatest(F.lit(0.0), F.element_at("low_b", k) - F.element_at("high_a", k), F.element_at("low_a", k) - F.element_at("high_b", k)), F.lit(2.0)))
    pairs = cut(left.drop("low", "high").join(right.drop("low", "high"), keys).where("a <= b").where(apart <= eps * eps + 1e-9).select("a", "b").distinct())
    # A block goes once to each pair that it is in.
    sent = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    few = pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS
    tiles = made.select("block", "ids", "of", "data").join(F.broadcast(sent) if few else sent, "block")

    def join(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["block"].to_numpy())
        sides, heads, counts, out = [], [], [], []
        for k in order.tolist():
            ids, of = (np.frombuffer(rows[c][k].as_buffer(), t) for c, t in (("ids", "<i8"), ("of", "<i4")))
            sides.append(Sequence(matrix(rows["data"][k].as_buffer(), dims, kind), axes.value))
            heads.append(ids[np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1]])
            counts.append(np.bincount(of))
            if len(order) == 1:  # copies of one vector are linked with each other
                some = counts[0][of] > 1
                out.append((ids[some], heads[0][of[some]], counts[0][of[some]] - 1))
        same = len(order) == 1
        shift = 0 if same else len(heads[0])
        head, count = np.concatenate(heads), np.concatenate(counts)
        n, label = np.zeros(len(head), np.int64), np.arange(len(head))
        for i, j in join_sequences(sides[0], sides[-1], same, least):
            j = j + shift
            n += (np.bincount(i, count[j], len(n)) + np.bincount(j, count[i], len(n))).astype(np.int64)
            label = _union(label, i, j)
        # What a vector is linked with, each of its rows is.
        at = 0
        for k, heads_ in zip(order.tolist(), heads):
            ids, of = (np.frombuffer(rows[c][k].as_buffer(), t) for c, t in (("ids", "<i8"), ("of", "<i4")))
            some = n[at + of] > 0
            out.append((ids[some], head[label[at + of[some]]], n[at + of[some]]))
            at += len(heads_)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "root", "n"])

    return tiles.groupBy("a", "b").applyInArrow(join, "id long, root long, n long")


def embedding_groups(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every row's (vec_id, n_links, component_id, kept).

    Vectors that take no part (see vectors.valid) have no links and are their own component; rows with a null id have
    neither links nor a component. Rows of equal ids count as one vector whose links are added up. No rows give no rows.
    """
    links = cut(embedding_links(vectors, least, id_col, vector_col))
    counts = links.groupBy(F.col("id").alias("i")).agg(F.sum("n").alias("n"))
    groups = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    found = ids.join(counts, ids["vec_id"] == counts["i"], "left").join(groups, ids["vec_id"] == groups["node"], "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of embeddings: see embedding_groups for vectors that take no part, null and repeated ids, ties and empty tables."""
    return embedding_groups(table(spark, sf_dir, "embeddings"), 0.95)


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT r.x AS vec_id, CAST((SELECT count(*) FROM links l WHERE l.x = r.x) AS BIGINT) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept FROM reach r GROUP BY r.x
"""
