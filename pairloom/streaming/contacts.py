"""Contact counts over a stream of pairs.

A pair counts when it arrives; there is no event time, so nothing is late and state is one number per edge
that was seen. Each micro-batch's changed edges are handed to the sink in update mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.matrix import edges_from_pairs


def incremental_edges(pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Running counts of a (streaming) table of pairs (source, sink)."""
    return edges_from_pairs(pairs, tasks=tasks)


def start(pairs: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Counts all that is there into the in-memory table ``name``, complete after each batch."""
    rows = incremental_edges(pairs)
    return rows.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
