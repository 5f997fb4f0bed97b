"""Joins and lookups with their tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_last(facts: DataFrame, dim: DataFrame, key: str, order: str, missing: str = "missing") -> DataFrame:
    """Left join on key with the dimension's last row per key; adds a flag for rows without one."""
    cols = [c for c in dim.columns if c not in (key, order)]
    last = dim.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_d"))
    out = facts.join(last, key, "left").withColumn(missing, F.col("_d").isNull())
    return out.select(*facts.columns, *[F.col("_d")[c].alias(c) for c in cols], missing)


def first_match(left: DataFrame, right: DataFrame, condition: Column, keys: list[str], order: list[Column | str], how: str = "left") -> DataFrame:
    """Join on any condition; of several matches the first in that order stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return left.join(right, condition, how).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def cascade(candidates: list[DataFrame], keys: list[str], order: list[Column | str]) -> DataFrame:
    """Union of candidate sets; per key the first set that has a row, inside it the first in order."""
    out = None
    for k, c in enumerate(candidates):
        part = c.withColumn("priority", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("priority", *order)
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def overlap(new: Column, old: Column) -> Column:
    """Share of the new tokens that the old ones hold."""
    return F.size(F.array_intersect(new, old)) / F.greatest(F.size(new), F.lit(1))


def title_tokens(c: Column, stop: tuple[str, ...] = ("the", "and", "for")) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def upsert_actions(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """new with action UPDATED or CREATED, by whether existing has the key."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return new.join(known, key, "left").withColumn("action", F.when(F.col("_known"), "UPDATED").otherwise("CREATED")).drop("_known")
