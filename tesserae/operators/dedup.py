"""Deduplication: which of equal rows stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in that order. The order must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def keep_first_by_hash(df: DataFrame, hash_col: Column, order_col: str) -> DataFrame:
    """The row of least order_col for each hash: an aggregate with map-side combine and no sort of whole rows."""
    first = df.groupBy(hash_col.alias("content_hash")).agg(F.min(order_col).alias(order_col))
    return df.join(first, order_col)


def first_by_hash(rows: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """The same for narrow rows: they travel through the aggregate themselves, so nothing is joined back."""
    rest = [c for c in rows.columns if c != hash_col]
    return rows.groupBy(hash_col).agg(F.min_by(F.struct(*rest), order_col).alias("_r")).select(hash_col, "_r.*")


def mark_duplicates(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """Adds is_duplicate: true for all but the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("is_duplicate", F.lead(F.lit(1)).over(w).isNotNull())
