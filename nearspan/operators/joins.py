"""All-pairs operators over two DataFrames of strings.

Strings that repeat are scored once: joins work on the distinct strings of both sides, and rows come back at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearspan.functions.arrow import pairwise
from nearspan.functions.kernels import matrix_of
from nearspan.functions.scorers import Options, Scorer, scorer
from nearspan.plans import blocks
from nearspan.plans.candidates import blocks_cost_less, candidates

#: Similarities at which kNN and top-k joins look for enough pairs, before they look at all.
LADDER = (0.8,)


def side(df: DataFrame, text: str, index: str, name: str) -> DataFrame:
    """(name_index, name) of the rows that have a string."""
    return df.select(F.col(index).cast("long").alias(f"{name}_index"), F.col(text).cast("string").alias(name)).where(F.col(name).isNotNull())


def _sides(queries: DataFrame, targets: DataFrame, query: str, target: str, query_index: str, target_index: str) -> tuple[DataFrame, DataFrame]:
    return side(queries, query, query_index, "query"), side(targets, target, target_index, "target")


def _distinct(q: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct strings of both sides. Few bytes of queries may meet many targets, so they are dealt to all cores whatever their size."""
    cores = max(q.sparkSession.sparkContext.defaultParallelism, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return q.select("query").distinct().repartition(cores, "query"), t.select("target").distinct()


def _rows(scored: DataFrame, q: DataFrame, t: DataFrame) -> DataFrame:
    return scored.join(q, "query").join(t, "target").select("score", "query", "target", "query_index", "target_index")


def _check_lengths(found: Scorer, options: Options, q: DataFrame, t: DataFrame) -> None:
    if found.name.startswith("hamming") and options.on_length_mismatch == "error":
        n = F.length("s")
        low, high = q.select(F.col("query").alias("s")).unionByName(t.select(F.col("target").alias("s"))).agg(F.min(n), F.max(n)).first()
        if low != high:
            raise ValueError(f"Hamming distance of strings of {low} and {high} code points")


def score_column(found: Scorer | Callable[[str, str], float], options: Options = Options()) -> Column:
    if isinstance(found, Scorer):
        return found.column(F.col("query"), F.col("target"), options)
    return pairwise(lambda a, b: [float(found(x, y)) for x, y in zip(a, b)], "double")(F.col("query"), F.col("target"))


def cdist(
    queries: DataFrame, targets: DataFrame, by: str | int | Scorer | Callable[[str, str], float], query: str = "query", target: str = "target", query_index: str = "query_index", target_index: str = "target_index",
    **options,
) -> DataFrame:
    """Every query against every target: (score, query, target, query_index, target_index).

    ``by``: a scorer, its name or number, or any function of two strings. Rows without a string take no part. Hamming
    distances of unequal lengths are an error, null ("skip") or padded, as on_length_mismatch says.
    """
    found, chosen = by if callable(by) and not isinstance(by, Scorer) else scorer(by), Options(**options)
    q, t = _sides(queries, targets, query, target, query_index, target_index)
    a, b = _distinct(q, t)
    if isinstance(found, Scorer) and found.name.startswith("hamming") and chosen.on_length_mismatch == "skip":
        return _rows(a.crossJoin(b).where(F.length("query") == F.length("target")).withColumn("score", score_column(found, chosen)), q, t)
    return _rows(a.crossJoin(b).withColumn("score", score_column(found, chosen)), q, t)


def cdist_array(queries: DataFrame, targets: DataFrame, by, **names_and_options) -> DataFrame:
    """cdist as an array of scores for each query, in the order of the targets' index."""
    rows = cdist(queries, targets, by, **names_and_options)
    pairs = F.sort_array(F.collect_list(F.struct("target_index", "score")))
    return rows.groupBy("query_index", "query").agg(F.transform(pairs, lambda x: x["score"]).alias("scores"))


def _above(a: DataFrame, b: DataFrame, found: Scorer, t: float, options: Options) -> DataFrame:
    short = False
    if found.name == "levenshtein_normalized" and 0 < t <= 1:
        size = blocks.sizes(a, b)
        short = size[2] <= blocks.LONGEST
        if short and blocks_cost_less(a, b, size, found, t, options):
            return blocks.near_pairs(a, b, size, t)
    near = candidates(a, b, found, t, options, compare=not short)
    if found.name == "levenshtein_normalized" and 0 < t <= 1:
        # No more than these edits reach t; the distance is given up beyond them.
        most = F.greatest(F.length("query"), F.length("target"))
        edits = F.floor((1.0 - F.lit(t)) * most + 1e-6).cast("int")
        near = near.withColumn("d", F.call_function("levenshtein", "query", "target", edits)).where("d >= 0")
        score = F.when(most == 0, 1.0).otherwise(1.0 - F.col("d") / most)
        return near.select("query", "target", score.alias("score")).where(F.col("score") >= t)
    return near.withColumn("score", score_column(found, options)).where(F.col("score") >= t)


def _similarity(by) -> Scorer:
    found = scorer(by)
    if not found.normalized:
        raise ValueError(f"{found.name} has no scale from 0 to 1")
    return found


def above_threshold(
    queries: DataFrame, targets: DataFrame, by: str | int | Scorer, threshold: float, query: str = "query", target: str = "target", query_index: str = "query_index", target_index: str = "target_index",
    include_self: bool = True, **options,
) -> DataFrame:
    """Pairs whose similarity is ``threshold`` or more; include_self=False leaves out pairs of one index."""
    found, chosen = _similarity(by), Options(**options)
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be within [0, 1]")
    q, t = _sides(queries, targets, query, target, query_index, target_index)
    _check_lengths(found, chosen, q, t)
    rows = _rows(_above(*_distinct(q, t), found, threshold, chosen), q, t)
    return rows if include_self else rows.where("query_index <> target_index")


def top_k(
    queries: DataFrame, targets: DataFrame, by: str | int | Scorer, k: int, query: str = "query", target: str = "target", query_index: str = "query_index", target_index: str = "target_index",
    reject_duplicates: bool = False, **options,
) -> DataFrame:
    """The k nearest pairs of all, nearest first, ties to smaller indices; reject_duplicates leaves out equal strings.

    Similarities are looked for from high to low: once k pairs reach a step of LADDER, none below it can be among them.
    """
    found, chosen = scorer(by), Options(**options)
    q, t = _sides(queries, targets, query, target, query_index, target_index)
    _check_lengths(found, chosen, q, t)
    a, b = _distinct(q, t)
    kept = F.col("query") != F.col("target") if reject_duplicates else F.lit(True)
    order = [F.desc("score") if found.similarity else F.asc("score"), "query_index", "target_index"]
    for step in LADDER if found.normalized else ():
        rows = _rows(_above(a, b, found, step, chosen).where(kept), q, t).orderBy(*order).limit(k)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        if rows.count() >= k:
            return rows
        rows.unpersist()
    return _rows(a.crossJoin(b).where(kept).withColumn("score", score_column(found, chosen)), q, t).orderBy(*order).limit(k)


def _by_ladder(a: DataFrame, b: DataFrame, t: DataFrame, found: Scorer, k: int, ladder: tuple[float, ...], chosen: Options) -> DataFrame:
    """(query, target, score) of pairs that include the k nearest rows of each query and their ties."""
    weight = t.groupBy("target").agg(F.count("*").alias("n"))
    open_, parts = a, []
    for step in ladder if found.normalized else ():
        near = _above(open_, b, found, step, chosen).persist(StorageLevel.MEMORY_AND_DISK)
        full = near.join(weight, "target").groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") >= k).select("query")
        parts.append(near.join(full, "query", "left_semi"))
        open_ = open_.join(full, "query", "left_anti")
    rest = open_.crossJoin(b)
    if found.name.startswith("hamming"):
        rest = rest.where(F.length("query") == F.length("target"))
    parts.append(rest.withColumn("score", score_column(found, chosen)))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored


def top_k_per_query(
    queries: DataFrame, targets: DataFrame, by: str | int | Scorer, k: int = 5, query: str = "query", target: str = "target", query_index: str = "query_index", target_index: str = "target_index",
    ladder: tuple[float, ...] = LADDER, **options,
) -> DataFrame:
    """The k nearest targets of each query: (query_index, query, rank, score, target, target_index).

    Ties go to the smaller target_index. Levenshtein similarities are looked for by blocks, whatever the ladder, unless
    strings are very long. For others a step of the ladder settles the queries that find k targets there; only the
    rest are scored against targets further away. Hamming skips targets of another length.
    """
    found = scorer(by)
    chosen = Options(**{"on_length_mismatch": "skip", **options})
    q, t = _sides(queries, targets, query, target, query_index, target_index)
    a, b = _distinct(q, t)
    if found.name == "levenshtein_normalized" and (size := blocks.sizes(a, b))[2] <= blocks.LONGEST:
        first = F.min(F.coalesce("target_index", F.lit(-(1 << 63)).cast("long")))
        scored = blocks.nearest_pairs(a, t.groupBy("target").agg(first.alias("i")), size, k)
    else:
        scored = _by_ladder(a, b, t, found, k, ladder, chosen)
    # A string's k nearest strings hold its k nearest rows; ranks by string first keep the join back small.
    best = Window.partitionBy("query").orderBy(F.desc("score") if found.similarity else F.asc("score"))
    scored = scored.withColumn("r", F.rank().over(best)).where(F.col("r") <= k).drop("r")
    nearest = Window.partitionBy("query_index").orderBy(F.desc("score") if found.similarity else F.asc("score"), "target_index")
    rows = _rows(scored, q, t).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return rows.select("query_index", "query", "rank", "score", "target", "target_index")


def matches(per_query: DataFrame, queries: DataFrame, query: str = "query", query_index: str = "query_index") -> DataFrame:
    """top_k_per_query rows as an array for each query; queries without matches have an empty one."""
    rows = per_query.groupBy("query_index").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "target", "target_index"))).alias("m"))
    found = queries.select(F.col(query_index).cast("long").alias("query_index"), F.col(query).alias("query")).join(rows, "query_index", "left")
    items = F.transform(F.coalesce("m", F.array().cast(rows.schema["m"].dataType)), lambda x: F.struct(x["score"].alias("score"), x["target"].alias("target"), x["target_index"].alias("target_index")))
    return found.select("query", "query_index", items.alias("matches"))


def cdist_matrix(
    queries: DataFrame, targets: DataFrame, matrix, local: bool = True, gap_open: int = -1, gap_extend: int | None = None, query: str = "query", target: str = "target", query_index: str = "query_index",
    target_index: str = "target_index", matrix_dir: str | None = None,
) -> DataFrame:
    """Every query against every target by a substitution matrix (a Matrix, or a name that matrices.load takes)."""
    m = matrix_of(matrix, matrix_dir)
    q, t = _sides(queries, targets, query, target, query_index, target_index)
    a, b = _distinct(q, t)
    score = pairwise(lambda x, y: m.scores_of(x, y, local, gap_open, gap_extend), "long")(F.col("query"), F.col("target"))
    return _rows(a.crossJoin(b).withColumn("score", score), q, t)


def matrix_above_threshold(queries: DataFrame, targets: DataFrame, matrix, threshold: int, **how) -> DataFrame:
    """Pairs whose raw matrix score is ``threshold`` or more."""
    return cdist_matrix(queries, targets, matrix, **how).where(F.col("score") >= threshold)


def matrix_top_k(queries: DataFrame, targets: DataFrame, matrix, k: int, **how) -> DataFrame:
    """The k pairs with the largest matrix scores, ties to smaller indices."""
    return cdist_matrix(queries, targets, matrix, **how).orderBy(F.desc("score"), "query_index", "target_index").limit(k)


def phonetic_join(queries: DataFrame, targets: DataFrame, code: Callable[[Column], Column], query: str = "query", target: str = "target", query_index: str = "query_index", target_index: str = "target_index") -> DataFrame:
    """Pairs that share a code: an equi-join. Codes joined by bars count each; empty codes match nothing."""
    q, t = _sides(queries, targets, query, target, query_index, target_index)
    codes = lambda df, name: df.select(name, F.explode(F.array_distinct(F.split(code(F.col(name)), r"\|"))).alias("code")).where("code <> ''")
    a, b = _distinct(q, t)
    pairs = codes(a, "query").join(codes(b, "target"), "code").groupBy("query", "target").agg(F.min("code").alias("code"))
    return pairs.join(q, "query").join(t, "target").select("code", "query", "target", "query_index", "target_index")


def dedupe(items: DataFrame, item: str, by: Callable[[str, str], float] | str | Scorer, threshold: float = 0.7) -> DataFrame:
    """(item): for each item the longest (of equally long ones the greatest) of those that are alike, each once.

    ``by``: a scorer with a scale from 0 to 1, or any function of two strings, on whose scale ``threshold`` is.
    """
    strings = items.select(F.col(item).cast("string").alias("item")).where("item is not null")
    a, b = strings.select(F.col("item").alias("query")).distinct(), strings.select(F.col("item").alias("target")).distinct()
    found = by if callable(by) and not isinstance(by, Scorer) else _similarity(by)
    if isinstance(found, Scorer):
        near = _above(a, b, found, threshold, Options())
    else:
        near = a.crossJoin(b).withColumn("score", score_column(found)).where(F.col("score") >= threshold)
    return near.groupBy("query").agg(F.max_by("target", F.struct(F.length("target"), "target")).alias("item")).select("item").distinct()
