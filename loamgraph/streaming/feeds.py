"""Streams: windows with late data, duplicates, and upkeep of a versioned table from a change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.versioned import VersionedTable


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): works on a stream and on a table."""
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no longer pause than the gap."""
    w = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def upkeep(feed: DataFrame, table: VersionedTable, checkpoint: str, order: str | None = None):
    """Upsert every micro-batch of a feed into the table, one commit each; a batch that is delivered again is recognised
    by its number, which is part of the commit.  Of several rows of a key the one with the greatest ``order`` counts (all
    columns break ties); without ``order`` the greatest row does."""

    def apply(batch: DataFrame, number: int) -> None:
        now = table.latest()
        if now >= 0 and table.commit_info(now)["meta"].get("batch", -1) >= number:
            return
        rest = [c for c in batch.columns if c not in table.key and c != order]
        last = F.max(F.struct(*([order] if order else []), *rest)).alias("_last")
        rows = batch.groupBy(*table.key).agg(last).select(*[c if c in table.key else F.col(f"_last.{c}").alias(c) for c in batch.columns])
        table.upsert(rows, {"batch": number})

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
