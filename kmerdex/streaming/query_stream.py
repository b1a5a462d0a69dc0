"""Queries that arrive as a stream, against an index that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.query import named, query


def query_stream(index: Index, queries: DataFrame, path: str, checkpoint: str, k: int | None = None) -> StreamingQuery:
    """Answers (qid, sample, n) for a stream of queries (qid, seq), written to path batch by batch.

    A query is answered from its own row, so there is no state between batches. Each batch has a folder of
    its own that a retry overwrites, which makes the output exactly-once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        named(query(index, batch, k), index.experiments).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
