"""Keyed state as folds over an operation log, and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def toggled(log: DataFrame, key: str, on: Column, order: str) -> DataFrame:
    """Keys whose last operation is on, with the place of the insert that holds.

    Switching on a key that is on keeps its place; after a delete it comes in anew. Per key: the first "on" after the
    last "off" - two aggregates, no window over the log."""
    last_off = F.max(F.when(~on, F.col(order)))
    per_key = log.groupBy(key).agg(last_off.alias("_off"), F.max(F.when(on, F.col(order))).alias("_on"), F.array_sort(F.collect_list(F.when(on, F.col(order)))).alias("_all"))
    since = F.get(F.filter("_all", lambda o: F.col("_off").isNull() | (o > F.col("_off"))), F.lit(0))
    return per_key.where("_on IS NOT NULL AND (_off IS NULL OR _on > _off)").select(key, since.alias("since"))


def patched(log: DataFrame, key: str, field: str, value: str, order: str, fields: list[str]) -> DataFrame:
    """Last value of each field; the empty text deletes a field; a key without fields goes."""
    out = log.groupBy(key).agg(*[F.nullif(F.max_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.col(order))), F.lit("")).alias(f) for f in fields])
    return out.where(F.greatest(*[F.col(f).isNotNull() for f in fields]))


def upserted(log: DataFrame, key: str, status: str, notes: str, ts: str, order: str, deleted: Column) -> DataFrame:
    """Rows since the last delete of each key: first time as created, last status, last notes that aren't blank."""
    last = log.groupBy(key).agg(F.max(F.when(deleted, F.col(order))).alias("_gone"))
    live = log.join(last, key).where(F.col("_gone").isNull() | (F.col(order) > F.col("_gone")))
    note = F.when(F.trim(notes) != "", F.col(notes))
    return live.groupBy(key).agg(F.min_by(ts, order).alias("created"), F.max_by(ts, order).alias("updated"), F.max_by(status, order).alias("status"), F.coalesce(F.max_by(note, F.when(note.isNotNull(), F.col(order))), F.lit("")).alias("notes"))


def page_before(rows: DataFrame, keys: list[str], order: str, before: int | None, size: int) -> DataFrame:
    """The last rows of each key before a place, with has_older: keyset paging backwards."""
    rows = rows if before is None else rows.where(F.col(order) < before)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    placed = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size + 1)
    older = F.max("_k").over(Window.partitionBy(*keys)) > size
    return placed.withColumn("has_older", older).where(F.col("_k") <= size).drop("_k")


def memo_key(*cols: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 24)


def memoized(requests: DataFrame, memo: DataFrame, key: str, compute: Column, value: str) -> DataFrame:
    """requests with value: taken from memo where the key is there, else computed; hit says which."""
    known = memo.select(key, F.col(value).alias("_hit"))
    out = requests.join(known, key, "left")
    return out.withColumn("hit", F.col("_hit").isNotNull()).withColumn(value, F.coalesce("_hit", compute)).drop("_hit")
