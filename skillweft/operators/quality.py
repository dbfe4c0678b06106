"""Run monitoring over a table of item events.

Events are (run_id, item_id, ts, event, duplicates) with event one of start,
complete, skip and error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillweft.functions.text import format_duration


def item_states(events: DataFrame) -> DataFrame:
    """Last state per item; start and end times."""
    last = F.max_by("event", F.struct("ts", "event"))
    return events.groupBy("run_id", "item_id").agg(
        last.alias("last_event"),
        F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("start_time"),
        F.max(F.when(F.col("event") != "start", F.col("ts"))).alias("end_time"),
    ).withColumn("status", F.element_at(F.create_map(*[F.lit(x) for x in (
        "start", "processing", "complete", "completed", "skip", "skipped", "error", "error")]), F.col("last_event")))


def run_summary(events: DataFrame) -> DataFrame:
    """Per run: items, counts by outcome, share processed, duplicates, elapsed time and the time left.

    Outcomes are counted per event, items once.  The time left extends the mean
    time per processed item.
    """
    # items are counted on the (run, item) level first, so a long run is not one task's work
    per_item = events.groupBy("run_id", "item_id").agg(
        F.count_if(F.col("event") == "complete").alias("completed"),
        F.count_if(F.col("event") == "skip").alias("skipped"),
        F.count_if(F.col("event") == "error").alias("errors"),
        F.sum(F.when(F.col("event") == "complete", F.col("duplicates")).otherwise(0)).alias("duplicates"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    runs = per_item.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(c).alias(c) for c in ("completed", "skipped", "errors", "duplicates")],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )
    processed = F.col("completed") + F.col("skipped") + F.col("errors")
    elapsed = F.unix_seconds(F.col("last_ts").cast("timestamp")) - F.unix_seconds(F.col("first_ts").cast("timestamp"))
    timed = runs.withColumn("processed", processed).withColumn("elapsed_seconds", elapsed)
    left = F.col("elapsed_seconds") / F.col("processed") * (F.col("total") - F.col("processed"))
    return timed.select(
        "run_id", "total", "completed", "skipped", "errors", "duplicates",
        F.round(100.0 * F.col("processed") / F.greatest(F.col("total"), F.lit(1)), 1).alias("percentage"),
        "elapsed_seconds", format_duration(F.col("elapsed_seconds")).alias("elapsed"),
        F.when(F.col("processed") == 0, "calculating...").otherwise(
            format_duration(F.greatest(left, F.lit(0.0)))).alias("remaining"),
    )


def recent_items(events: DataFrame, n: int = 5) -> DataFrame:
    """Items with the latest change."""
    states = item_states(events).withColumn("changed", F.coalesce("end_time", "start_time"))
    return states.orderBy(F.desc("changed"), F.asc("item_id")).limit(n)
