"""Connected components by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspan.llm.common import cut


def _state(df: DataFrame) -> tuple:
    """Number of links, and sum and exclusive or of their whole 64-bit hashes."""
    h = F.xxhash64("u", "v")
    return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long links -> (node, component): for every node of a link, the smallest node it reaches.

    Each round is two joins on minima that are aggregated before they are shuffled; a hub's links are
    a skewed join, which adaptive execution splits. Self-links and repeats are allowed; no links, no rows.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
