"""Usage counters over the event stream (batch form; the stream is in streaming.streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event kinds counted per day.
EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]


def daily_usage(events: DataFrame) -> DataFrame:
    """Per calendar day: events, distinct users, and one count per event kind."""
    day = F.to_date(F.col("ts")).alias("day")
    aggs = [F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users")]
    aggs += [F.count(F.when(F.col("event_type") == t, 1)).alias(f"n_{t}") for t in EVENT_TYPES]
    return events.groupBy(day).agg(*aggs)
