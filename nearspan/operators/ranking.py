"""Ranking rows of a DataFrame by how near a string column comes to a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearspan.functions.scorers import Options, Scorer, scorer
from nearspan.operators.joins import score_column


def extract(
    choices: DataFrame, query: str | None, choice: str, index: str, by: str | int | Scorer | Callable[[str, str], float] = "levenshtein_normalized", k: int | None = 5, cutoff: float | None = None,
    processor: Callable[[Column], Column] | None = None, higher_is_better: bool = True, **options,
) -> DataFrame:
    """(choice, score, index) of the k rows nearest to a query, nearest first, ties to the smaller index.

    Rows without a choice are skipped; a null query finds nothing. ``cutoff``: the least similarity, or the largest
    distance. k=None ranks all that pass. ``processor`` is applied to both sides before they are scored.
    """
    found = by if callable(by) and not isinstance(by, Scorer) else scorer(by)
    up = found.similarity if isinstance(found, Scorer) else higher_is_better
    ready = processor or (lambda c: c)
    rows = choices.select(F.col(choice).cast("string").alias("choice"), F.col(index).alias("index")).where("choice is not null")
    pairs = rows.select(ready(F.lit(query).cast("string")).alias("query"), ready(F.col("choice")).alias("target"), "choice", "index").where("query is not null")
    scored = pairs.withColumn("score", score_column(found, Options(**options))).select("choice", "score", "index")
    if cutoff is not None:
        scored = scored.where(F.col("score") >= cutoff if up else F.col("score") <= cutoff)
    ranked = scored.orderBy(F.desc("score") if up else F.asc("score"), "index")
    return ranked if k is None else ranked.limit(k)


def extract_best(choices: DataFrame, query: str | None, choice: str, index: str, by="levenshtein_normalized", **how) -> DataFrame:
    """The nearest row alone; no row if there is none."""
    return extract(choices, query, choice, index, by, 1, **how)


def correct(tokens: DataFrame, matches: DataFrame, line: str = "line", position: str = "position", token: str = "token") -> DataFrame:
    """(line, text): tokens of each line in order, each replaced by its best match (rows of top_k_per_query with k=1) where it has one."""
    best = matches.where("rank = 1").select("query", "target").distinct()
    joined = tokens.join(best, tokens[token] == best["query"], "left").select(F.col(line).alias("line"), F.struct(F.col(position).alias("p"), F.coalesce("target", F.col(token)).alias("t")).alias("x"))
    ordered = F.sort_array(F.collect_list("x"))
    return joined.groupBy("line").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))
