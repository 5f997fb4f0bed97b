"""Job telemetry: counters, completeness, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stitched(shards: DataFrame, doc: str, page: str, total: str, text: str) -> DataFrame:
    """Documents whose pages 1..total are all there, their texts joined in page order; one row per page counts."""
    pages = shards.groupBy(doc, page).agg(F.max(total).alias(total), F.min(text).alias(text)).where(F.col(page).between(1, F.col(total)))
    g = pages.groupBy(doc).agg(F.count("*").alias("_n"), F.max(total).alias("_t"), F.array_sort(F.collect_list(F.struct(page, text))).alias("_p"))
    return g.where("_n = _t").select(doc, F.col("_n").alias("pages"), F.array_join(F.transform("_p", lambda x: x[text]), "\n").alias("text"))


def eta_minutes(remaining: Column, rpm: Column, avg_seconds: Column, workers: Column) -> Column:
    """The larger of the rate limit's floor and the observed pace; a missing one doesn't count."""
    floor = F.when(rpm > 0, remaining / rpm)
    return F.greatest(floor, remaining * avg_seconds / 60 / F.greatest(workers, F.lit(1)))


def scheduled(rows: DataFrame, key: str, arrival: str, order: list[str], spacing: float) -> DataFrame:
    """Adds start: a request starts when it arrives, or spacing after the one before if that is later.

    Unrolled, the k-th start is the largest of arrival_j + (k - j) * spacing over all j up to k: a running maximum."""
    w = Window.partitionBy(key).orderBy(arrival, *order)
    waited = (F.row_number().over(w) - 1) * F.lit(spacing)
    ahead = F.max(F.col(arrival) - F.col("_waited")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_waited", waited).withColumn("start", ahead + F.col("_waited")).drop("_waited")


def likeness(query: str | None, *fields: str | None) -> float:
    """The best ratio of matching characters between the query and a field; 1 if a field holds the query."""
    from difflib import SequenceMatcher

    wanted, low = (query or "").lower().strip(), [(f or "").lower() for f in fields]
    return 1.0 if any(wanted in f for f in low) else max(SequenceMatcher(None, wanted, f).ratio() for f in low)
