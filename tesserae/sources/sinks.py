"""Sinks: bundles, JSON exports, reports, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_text(df: DataFrame, keys: list[str], order: list[str], line: Column, by: str = "\n") -> DataFrame:
    """(keys, text): the lines of each key in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["_line"]), by).alias("text"))


def ics(events: DataFrame) -> DataFrame:
    """One row: an iCalendar text of (uid, day, time, title); events with a time last an hour, over midnight too."""
    start = F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), "time"))
    fmt = "yyyyMMdd'T'HHmmss"
    timed = F.concat_ws("\n", F.concat(F.lit("DTSTART:"), F.date_format(start, fmt)), F.concat(F.lit("DTEND:"), F.date_format(start + F.expr("INTERVAL 1 HOUR"), fmt)))
    dated = F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("day", "yyyyMMdd"))
    block = F.concat_ws("\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("uid")), F.when(F.col("time").isNotNull(), timed).otherwise(dated), F.concat(F.lit("SUMMARY:"), F.regexp_replace("title", "([,;])", r"\\$1")), F.lit("END:VEVENT"))
    body = ordered_text(events.withColumn("_all", F.lit(1)), ["_all"], ["day", "uid"], block)
    return body.select(F.concat(F.lit("BEGIN:VCALENDAR\nVERSION:2.0\n"), "text", F.lit("\nEND:VCALENDAR")).alias("ics"))


def overwrite_partition(df: DataFrame, path: str, partition: str) -> None:
    """Rebuilds only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
