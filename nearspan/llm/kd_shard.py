"""Sharding by a K-d tree whose leaves hold near-equal bytes.

A node of several leaves is split along its widest metadata dimension at the weighted quantile that gives
each side the bytes of its leaves. The quantiles of all nodes of a level are found together, by histograms
that Spark aggregates: each pass narrows the interval that holds a node's cut.

What the tree divides are texts, not rows: all copies of a text have one place, the least of their coordinates, and the
bytes of them all, so they share a shard. Only a text whose copies alone outweigh HEAVY of a shard is dealt out in parts
by id; of rows that repeat id and text only the number is carried, so they can be divided too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearspan.llm.common import cut, table

#: Bins of a histogram pass, for each leaf of a node; intervals of a shard in which slots are numbered.
BINS, PARTS = 512, 64
#: A cut may miss its place by this share of a leaf's bytes.
TOLERANCE = 0.002
#: Copies of one text stay together up to this share of a leaf's bytes; beyond it they are dealt out in parts of that share.
HEAVY, PIECE = 0.2, 0.02


@dataclass
class Node:
    first: int  # its leaves are first..first+leaves-1
    leaves: int
    bytes: float = 0.0
    dim: str = ""
    bound: list[tuple[str, object]] = field(default_factory=list)  # (column, value): the left side's last row, in lexicographic order
    inclusive: bool = True
    left: "Node | None" = None
    right: "Node | None" = None


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "long('-9223372036854775808')"


def _double(x: float) -> str:
    return f"double('{float(x)!r}')"


def _down(rows: DataFrame, nodes: list[Node], dims: list[str]) -> DataFrame:
    """rows with the column node one level further down: the first leaf of the node's side that holds the row.

    The splits of a level are a table of a row for each node.
    """
    values = []
    for x in nodes:
        names = [n for n, _ in x.bound]
        (_, d), th, last = x.bound[0], x.bound[1][1] if len(x.bound) > 1 else 0, x.bound[-1][1] if len(x.bound) > 2 else 0
        values.append(f"({x.first}, {dims.index(names[0])}, {len(names)}, {_double(d)}, {_long(th)}, {_long(last)}, {str(x.inclusive).lower()}, {x.right.first})")
    table_ = rows.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t(of, s_dim, s_by, s_d, s_th, s_id, s_with, s_right)")
    v = F.element_at(F.array(*dims), F.col("s_dim") + 1)

    def below(c: Column, value: Column, by: int, rest: Column) -> Column:
        ends = F.col("s_by") == by
        return (c < value) | ((c == value) & F.when(ends, F.col("s_with")).otherwise(rest))

    left = below(v, F.col("s_d"), 1, below(F.col("th"), F.col("s_th"), 2, below(F.col("id"), F.col("s_id"), 3, F.lit(False))))
    node = F.when(F.col("of").isNotNull() & ~left, F.col("s_right")).otherwise(F.col("node"))
    return rows.join(F.broadcast(table_), F.col("node") == F.col("of"), "left").select("id", "th", "size", *dims, node.alias("node"))


def _cut_level(rows: DataFrame, nodes: list[tuple[Node, float, float]], dims: list[str], target: float) -> None:
    """Finds bound of each node: histogram passes over its dimension, then the text hash, then the id.

    The intervals that are still open are rows of a table of one row per node, so every pass is the same query.
    """
    state = {}
    for x, low, high in nodes:
        left = (x.leaves + 1) // 2
        state[x.first] = {"node": x, "goal": x.bytes * left / x.leaves, "stage": 0, "d": 0.0, "th": 0, "low": low, "high": high, "before": 0.0}
    v = F.element_at(F.array(*dims), F.col("dim") + 1)
    c = F.when(F.col("stage") == 0, v).when(F.col("stage") == 1, F.col("th").cast("double")).otherwise(F.col("id").cast("double"))
    inside = ((F.col("stage") == 0) | (v == F.col("fix_d"))) & ((F.col("stage") < 2) | (F.col("th") == F.col("fix_th"))) & c.between(F.col("low"), F.col("high"))
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.floor((c - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")), F.col("bins") - 1)).otherwise(F.lit(0))
    ranges = [f(n).alias(f"{f.__name__}_{n}") for n in ("v", "th", "id") for f in (F.min, F.max)]
    while state:
        values = ", ".join(
            f"({k}, {dims.index(s['node'].dim)}, {s['stage']}, {_double(s['d'])}, {_long(s['th'])}, {_double(s['low'])}, {_double(s['high'])}, {s['node'].leaves * BINS})"
            for k, s in state.items()
        )
        open_ = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(node, dim, stage, fix_d, fix_th, low, high, bins)")
        found = rows.join(F.broadcast(open_), "node").where(inside).select("node", "size", "th", "id", v.alias("v"), bin_.cast("int").alias("bin"))
        by: dict[int, list] = {}
        for r in found.groupBy("node", "bin").agg(F.sum("size").alias("size"), *ranges).collect():  # BINS rows for each leaf at most
            by.setdefault(r["node"], []).append(r)
        for first, s in list(state.items()):
            name, at = ("v", "th", "id")[s["stage"]], s["before"]
            for r in sorted(by[first], key=lambda r: r["bin"]):
                if at + r["size"] >= s["goal"]:
                    break
                at += r["size"]
            else:
                at -= r["size"]
            low, high = r[f"min_{name}"], r[f"max_{name}"]
            near = min(abs(at - s["goal"]), abs(at + r["size"] - s["goal"])) <= TOLERANCE * target
            if near or low == high and s["stage"] == 2 or low != high and float(low) == float(high):
                at_end = abs(at + r["size"] - s["goal"]) <= abs(at - s["goal"])
                x = s["node"]
                fixed = [(x.dim, s["d"]), ("th", s["th"])][: s["stage"]]
                x.bound, x.inclusive = [*fixed, (x.dim if name == "v" else name, high if at_end else low)], at_end
                left = (x.leaves + 1) // 2
                x.left, x.right = Node(x.first, left), Node(x.first + left, x.leaves - left)
                del state[first]
            elif low == high:
                s |= {"d": r["min_v"], "th": r["min_th"], "stage": s["stage"] + 1, "before": at}
                s |= {"low": r["min_th"], "high": r["max_th"]} if s["stage"] == 1 else {"low": r["min_id"], "high": r["max_id"]}
            else:
                s |= {"low": low, "high": high, "before": at}


def kd_tree(rows: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """rows with their leaf as node; rows: (id, th, size, dims as doubles), where th settles the order of equal coordinates and id that of equal th.

    The tree is bounded by the number of leaves. Each level is a table of its splits, so plans grow by a join a level.
    """
    rows = rows.withColumn("node", F.lit(0))
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows
    level, ranges = [Node(0, leaves)], None
    while level := [x for x in level if x.leaves > 1]:
        stats = rows.where(F.col("node").isin([x.first for x in level])).groupBy("node").agg(F.sum("size").alias("size"), *(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)))
        by = {r["node"]: r for r in stats.collect()}
        ranges = ranges or {d: (by[0][f"max_{d}"] - by[0][f"min_{d}"]) or 1.0 for d in dims}
        level = [x for x in level if x.first in by]
        if not level:
            break
        for x in level:
            r = by[x.first]
            x.bytes = float(r["size"])
            x.dim = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / ranges[d])
        _cut_level(rows, [(x, by[x.first][f"min_{x.dim}"], by[x.first][f"max_{x.dim}"]) for x in level], dims, total / leaves)
        rows = _down(rows, level, dims)
        level = [y for x in level for y in (x.left, x.right)]
    return rows


def metadata(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """Dimensions of documents: the logarithm of the text's size, and language and source in the order of their first six bytes."""

    def place(c: str) -> Column:
        name = F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"), F.lit(6), F.lit(b"\0"))
        return F.conv(F.hex(name), 16, 10).cast("double")

    return {"d_size": F.log2(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 8.0), **{f"d_{c}": place(c) for c in ("lang", "source") if c in docs.columns}}


def texts(docs: DataFrame, dims: dict[str, Column], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, n, size, crc, dims): the rows that repeat id and text, as one with their number n."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        *(c.cast("double").alias(n) for n, c in dims.items()),
    )
    return rows.groupBy("doc_id", "th", "size", "crc").agg(F.count("*").alias("n"), *(F.min(d).alias(d) for d in dims))


def units(rows: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """texts() rows with u, what they share with the other copies of their text, and as many of n as lie in that unit.

    The copies of a text are one unit. Those that weigh more than HEAVY of a leaf are several, by a hash of the id; so few
    texts can weigh so much that a table of them may be broadcast.
    """
    total = rows.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    most = max(1, int(total / leaves * PIECE))
    heavy = rows.groupBy(F.col("th").alias("hth"), F.col("size").alias("hsize")).agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).where(F.col("bytes") > F.lit(total / leaves * HEAVY))
    rows = rows.join(F.broadcast(heavy), (F.col("th") == F.col("hth")) & (F.col("size") == F.col("hsize")), "left")
    alone = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("n") * F.col("size") / most))).cast("int")
    rows = rows.withColumn("k", F.explode(F.when(F.col("bytes").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), alone - 1))))
    pieces = F.when(F.col("bytes").isNull(), F.lit(1)).otherwise(alone)
    rows = rows.withColumn("n", (F.floor(F.col("n") / pieces) + (F.col("k") < F.col("n") % pieces).cast("long")).cast("long"))
    split = F.xxhash64("th", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("bytes") / most)), "k")
    return rows.select("doc_id", "th", "size", "crc", "n", *dims, "k", F.when(F.col("bytes").isNull(), F.col("th")).otherwise(split).alias("u"))


def shard(docs: DataFrame, leaves: int = 24, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its shard: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size: bytes of the text (null: none, like an empty text) plus 8. Rows of equal texts share a shard, whatever their
    ids and other columns, unless they alone outweigh HEAVY of a shard; then they are dealt out by id, and rows that repeat
    an id by number. Null ids count as an id of their own. With fewer texts than leaves some shards are empty; no rows give
    no rows. dims may name any columns of docs; null counts as 0.
    """
    dims = {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in (dims or metadata(docs, text_col)).items()}
    rows = cut(units(cut(texts(docs, dims, id_col, text_col)), list(dims), leaves))
    grouped = cut(rows.groupBy("u").agg(F.sum(F.col("n") * F.col("size")).alias("size"), *(F.min(d).alias(d) for d in dims)).select(F.col("u").alias("id"), F.col("u").alias("th"), "size", *dims))
    leaf = kd_tree(grouped, list(dims), leaves).select(F.col("id").alias("u"), F.col("node").cast("int").alias("shard"))
    placed = rows.join(leaf.hint("merge"), "u").withColumn("part", F.pmod(F.xxhash64("doc_id", "th"), F.lit(PARTS)))
    placed = cut(placed.select("doc_id", "th", "size", "crc", "n", "k", "shard", "part"))
    counts = placed.groupBy("shard", "part").agg(F.sum("n").alias("count"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    upto = Window.partitionBy("shard", "part").orderBy("doc_id", "th", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("end", F.sum("n").over(upto)).join(F.broadcast(begins), ["shard", "part"])  # PARTS rows for each shard
    numbered = numbered.withColumn("nth", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)))
    return numbered.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op5_kd_sharding(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: see shard for null texts and ids, equal texts, repeated rows and small tables."""
    return shard(table(spark, sf_dir, "documents"), 24)
