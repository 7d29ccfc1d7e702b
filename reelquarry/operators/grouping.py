"""Groups whose order matters: first-seen groups, runs, references, summaries. All are partial aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen_groups(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first_seen, n_members, group_no): groups in the order in which they first appear.

    Only one row for each group reaches the numbering, whose window has no partition; use it where groups are few
    (songs of a disc, kinds of an event).
    """
    groups = rows.groupBy(key).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n_members"))
    return groups.withColumn("group_no", F.row_number().over(Window.orderBy("first_seen")).cast("long"))


def runs(rows: DataFrame, position: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, low, high, n) of consecutive positions; a repeated position counts once."""
    keys = keys or []
    own = Window.partitionBy(*keys).orderBy(position)
    numbered = rows.select(*keys, position).distinct().withColumn("island", F.col(position) - F.row_number().over(own))
    return numbered.groupBy(*keys, "island").agg(
        F.min(position).alias("low"), F.max(position).alias("high"), F.count(F.lit(1)).alias("n")
    ).drop("island")


def track_stats(events: DataFrame, keys: list[str], is_audio: Column, end: str, origin: Column) -> DataFrame:
    """(keys, n_events, has_audio, end_frames): over all events, erasing and empty ones too; the end is never negative."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.bool_or(is_audio).alias("has_audio"),
        F.greatest(F.lit(0).cast("long"), F.max(F.col(end) - origin)).alias("end_frames"),
    )


def song_summary(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_tracks, frames): tracks with audio and the longest of them; songs without any count zero."""
    return stats.groupBy(*keys).agg(
        F.count_if("has_audio").alias("n_tracks"),
        F.coalesce(F.max(F.when(F.col("has_audio"), F.col("end_frames"))), F.lit(0).cast("long")).alias("frames"),
    )


def stamp_span(events: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """(keys, first_stamp, last_stamp); absent stamps don't count."""
    return events.groupBy(*keys).agg(F.min(stamp).alias("first_stamp"), F.max(stamp).alias("last_stamp"))


def distinct_references(rows: DataFrame, keys: list[str], reference: str, order: str, count: str) -> DataFrame:
    """(keys, reference, first_seen, most): each reference but 0 once, with the largest count claimed for it."""
    return rows.filter(F.col(reference) != 0).groupBy(*keys, reference).agg(F.min(order).alias("first_seen"), F.max(count).alias("most"))
