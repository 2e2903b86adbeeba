"""Table functions: rows instead of arrays, made a chunk at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from nearspan.functions.scorers import scorer
from nearspan.shipping import ship


class Grid:
    """(query_index, target_index, score) of every query against every target, row by row; chunk pairs are scored at once."""

    def eval(self, queries: list[str], targets: list[str], by: str, chunk: int):
        found, width = scorer(by), max(1, int(chunk))
        for i, q in enumerate(queries or []):
            for at in range(0, len(targets or []), width):
                part = [(j, t) for j, t in enumerate(targets[at : at + width], at) if t is not None and q is not None]
                for (j, _), score in zip(part, found.pairs([q] * len(part), [t for _, t in part]) if part else ()):
                    yield i, j, float(score)


def register_tables(spark: SparkSession, prefix: str = "ns_") -> list[str]:
    """Registers cdist_rows(queries, targets, scorer, chunk) for use in FROM."""
    ship(spark)
    spark.udtf.register(f"{prefix}cdist_rows", udtf(Grid, returnType="query_index int, target_index int, score double"))
    return [f"{prefix}cdist_rows"]
