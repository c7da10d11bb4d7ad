"""File events as a stream: the last event of a path decides, and graphs follow batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.ignore import SKIPPED, ignored


def expanded(events: DataFrame) -> DataFrame:
    """(ts, event_id, path, kind): a move is a deletion of its source and a change of its destination."""
    events = events if "event_id" in events.columns else events.withColumn("event_id", F.lit(0))
    moved = F.array(
        F.struct(F.col("path").alias("path"), F.lit("deleted").alias("kind")), F.struct(F.col("dest_path").alias("path"), F.lit("modified").alias("kind"))
    )
    plain = F.array(F.struct(F.col("path").alias("path"), F.col("kind").alias("kind")))
    return events.select("ts", "event_id", F.inline(F.when(F.col("kind") == "moved", moved).otherwise(plain)))


def compacted(events: DataFrame) -> DataFrame:
    """(path, kind, n_events): the last event of each path, of equal times the one with the largest event_id, by which they arrived."""
    return expanded(events).groupBy("path").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n_events"))


def watch(events: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, patterns: list[str] | None = None, skip=SKIPPED, every: str | None = None) -> StreamingQuery:
    """Runs ``apply(changed, deleted)`` for each batch of a stream of events: for those that are there, or,
    with a time between batches (``every``, such as "5 seconds"), until the query is stopped.

    Both have the paths that count, once each. State is the graph that ``apply`` publishes,
    and the checkpoint folder makes a restart go on where it stopped; an event that comes
    again has the same effect.
    """

    def batch(df: DataFrame, _: int) -> None:
        last = compacted(df).filter(~ignored(F.col("path"), patterns or [], skip)).persist()
        if last.isEmpty():
            last.unpersist()
            return
        apply(last.filter("kind <> 'deleted'").select("path"), last.filter("kind = 'deleted'").select("path"))
        last.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
