"""Streaming extensions: event windows with late data, and clusters from a stream of back-pointers.

The batch operators have no streaming counterpart to match; these two share
their semantics, so that a bounded table and a stream give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_windows(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and summed values by tumbling window and type; ``late`` is the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    counts = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def clusters_of_stream(pointers: DataFrame) -> DataFrame:
    """doc_key, ment_idx, cluster_id for each back-pointer doc_key, m, a as it comes, mentions in order.

    The state of a document is the cluster of each of its mentions so far.
    """
    kind = pointers.schema["doc_key"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (ids, of) = state.get if state.exists else ([], [])
        known, out = dict(zip(ids, of)), []
        for batch in batches:
            for m, a in batch.sort_values("m")[["m", "a"]].itertuples(index=False):
                if m not in known:
                    known[m] = known[a] if a != m and a in known else len(set(known.values()))
                out.append((key[0], m, known[m]))
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["doc_key", "ment_idx", "cluster_id"])

    return pointers.groupBy("doc_key").applyInPandasWithState(step, f"doc_key {kind}, ment_idx bigint, cluster_id bigint", "ids array<bigint>, clusters array<bigint>", "append", GroupStateTimeout.NoTimeout)
