"""Queries as a stream: each micro-batch of query tokens is searched as one set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lateloom.operators.retrieve import search
from lateloom.params import SearchParams


def search_stream(query_tokens: DataFrame, index, p: SearchParams, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """Starts a stream that gives sink the hits of each micro-batch of query_tokens(qid, qpos, vec). All tokens of a query must come in one batch."""
    p.check()
    return query_tokens.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(search(index, df, p), n)).start()
