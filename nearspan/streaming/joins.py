"""A stream of strings against a table: each micro-batch is a similarity join of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearspan.operators import joins


def stream_above_threshold(stream: DataFrame, targets: DataFrame, by, threshold: float, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, trigger: dict | None = None, **how) -> StreamingQuery:
    """Starts a query that hands sink(rows, batch_id) the pairs of each micro-batch that reach the threshold.

    Batches are independent, so no state is kept; a batch that runs again has the same rows under the same id.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(joins.above_threshold(batch, targets, by, threshold, **how), batch_id)

    writer = stream.writeStream.foreachBatch(run).trigger(**(trigger or {"availableNow": True}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def iterate(pairs: DataFrame) -> Iterator[Row]:
    """Rows one by one, a partition ahead at most: the driver holds no more than that."""
    return pairs.toLocalIterator(prefetchPartitions=True)


def iterate_per_query(per_query: DataFrame) -> Iterator[tuple[str, list[Row]]]:
    """(query, its matches, nearest first), one query at a time."""
    grouped = per_query.groupBy("query_index", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "target", "target_index"))).alias("m"))
    for row in grouped.toLocalIterator(prefetchPartitions=True):
        yield row["query"], row["m"]
