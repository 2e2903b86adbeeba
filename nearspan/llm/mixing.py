"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight. Within a source the keys are sorted
and the sizes prefix-summed up to the source's budget: complete epochs first, then the documents with the
smallest keys. The prefix sums never sort a whole source: sizes are summed by intervals of the key's logarithm, which
are narrow beside keys of any size and so of any weight, and only the interval in which a budget ends is sorted: a
source's choice is one row, its last key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearspan.llm.common import WORD, cut, table

#: Intervals of the key within a source, for each doubling; weights that keys are drawn with, at least and at most.
INTERVALS, LEAST, MOST = 1024, 1e-9, 1e9
#: Sources whose rows of the plan (some numbers and a name each) are broadcast at most.
FEW_SOURCES = 4096
#: Characters that prose has few of; their share lowers a document's weight.
SYMBOLS = "#$%&*!|@<>{}[]^~=+_"


def text_quality(text: Column) -> Column:
    """Share of characters that are not symbols, 0.05 at least; empty and null texts: 0.05."""
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(F.length(F.translate(text, SYMBOLS, "")).cast("double"), F.length(text).cast("double")), F.lit(0.05)))


def sample_key(id_: Column, quality: Column, seed: str = "mix") -> Column:
    """-ln(u) / quality, u in (0, 1) from the md5 of the id and the seed: small keys are taken first.

    Null, NaN and values below LEAST count as LEAST, values above MOST as MOST.
    """
    quality = F.least(F.greatest(F.coalesce(F.nanvl(quality.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(LEAST)), F.lit(MOST))
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, seed: str) -> DataFrame:
    """(id, source, size, key) of every row."""
    text = F.col(text_col)
    weight = text_quality(text) if quality is None else quality
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), sample_key(F.col(id_col), weight, seed).alias("key"),
    )


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sized() rows -> a row per source: source, source_size, target, epochs, cut_key, cut_id.

    A row is taken ``epochs`` times, and once more where (key, id) <= (cut_key, cut_id); cut_key is null where
    nothing is left to choose. Targets: ``share`` of all sizes dealt by weight, none above ``most`` times its
    source's size. Windows without a partition see one row per source.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    sources = sources.withColumn("ratio", F.col("cap") / F.col("w"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    # Sources in the order in which they reach their cap; the first that does not sets the level of the rest.
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    sources = sources.withColumn("level", level).withColumn("nth", F.row_number().over(filled))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything)["level"]
    sources = sources.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = sources.select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))

    part = F.floor(F.log2("key") * INTERVALS).cast("int")
    rows = rows.withColumn("part", part)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("sum"), F.max(F.struct("key", "id")).alias("last"))
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("end", F.sum("sum").over(running)).withColumnRenamed("source", "s")
    parts = parts.join(sources, parts["s"].eqNullSafe(sources["source"])).select("source", "part", "sum", "end", "last", "rest")
    whole = parts.where("end <= rest").select("source", "last")
    # One interval at most for each source: the one in which its budget ends.
    ends = parts.where("end > rest and end - sum < rest").select(F.col("source").alias("s"), F.col("part").alias("p"), (F.col("end") - F.col("sum")).alias("begin"), "rest")
    inside = rows.join(ends, rows["source"].eqNullSafe(ends["s"]) & (rows["part"] == ends["p"]))
    upto = Window.partitionBy("source", "part").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("end", F.col("begin") + F.sum("size").over(upto))
    chosen = inside.where(F.col("end") - F.col("size") / 2 <= F.col("rest")).select("source", F.struct("key", "id").alias("last"))
    last = whole.unionByName(chosen).groupBy(F.col("source").alias("s")).agg(F.max("last").alias("last"))
    plan = sources.join(last, sources["source"].eqNullSafe(last["s"]), "left")
    return plan.select("source", "source_size", "target", "epochs", F.col("last.key").alias("cut_key"), F.col("last.id").alias("cut_id"))


def copies(key: Column, id_: Column) -> Column:
    """Times that a row is taken under the row of planned() beside it."""
    id_ = F.coalesce(id_.cast("long"), F.lit(-(1 << 63)))
    cut_id = F.coalesce("__mix_cut_id", F.lit(-(1 << 63)))
    extra = (key < F.col("__mix_cut_key")) | ((key == F.col("__mix_cut_key")) & (id_ <= cut_id))
    return F.col("__mix_epochs") + F.coalesce(extra, F.lit(False)).cast("long")


def planned(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """rows beside their source's row of the plan, whose columns get a prefix.

    The plan has one row for each source. Up to FEW_SOURCES of them are broadcast, so that neither texts nor a source of
    many rows are shuffled; beyond that both sides are plain exchanges, whose hot sources adaptive execution splits.
    """
    plan = cut(plan.select(*(F.col(c).alias(f"__mix_{c}") for c in plan.columns)))
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(plan) if few else plan.hint("merge"), F.col(source).eqNullSafe(F.col("__mix_source")))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: str = "mix", **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of docs.

    Null and empty texts have size 0 and are taken 0 words. A null source is a source of its own, the last.
    Rows with the same id have the same key, and share their fate but at the very end of a budget. The words
    taken of a source differ from its target by half of one document at most. No rows give no rows.
    """
    rows = cut(sized(docs, id_col, text_col, source_col, quality, seed))
    both = planned(rows, mix_plan(rows, **how), "source")
    taken = copies(F.col("key"), F.col("id")) * F.col("size")
    return both.select(F.col("id").alias("doc_id"), "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), taken.alias("taken"), "source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: str = "mix", **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the choice is a row per source, so texts are not sorted.

    Rows of null and empty texts have size 0 and may be there as often as any of their source. Null sources are one
    source, the last; null ids draw one key. No rows give no rows.
    """
    plan = mix_plan(cut(sized(docs, id_col, text_col, source_col, quality, seed)), **how)
    weight = text_quality(F.col(text_col)) if quality is None else quality
    keyed = docs.select("*", sample_key(F.col(id_col), weight, seed).alias("__mix_key"), F.col(source_col).cast("string").alias("__mix_of"))
    both = planned(keyed, plan, "__mix_of")
    both = both.withColumn("__mix_n", copies(F.col("__mix_key"), F.col(id_col)).cast("int")).where("__mix_n > 0")
    return both.withColumn("__mix_n", F.explode(F.array_repeat(F.lit(0), F.col("__mix_n")))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: see mix_sizes for null texts, sources and ids, repeated rows and empty tables."""
    return mix_sizes(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / greatest(0.05::DOUBLE, coalesce(length(translate(text, '#$%&*!|@<>{}[]^~=+_', ''))::DOUBLE / nullif(length(text), 0)::DOUBLE, 0.05::DOUBLE)) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS nth,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, nth) FROM levels WHERE level <= ratio) * w, cap)) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets
), ranked AS (
  SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken, source FROM ranked
"""
