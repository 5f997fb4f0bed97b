"""Topic lexicons: counts, shares, gaps and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

Lexicon = dict[str, list[str]]


def topic_hits(text: Column, aliases: list[str]) -> Column:
    """Matches of all aliases: literal patterns are compiled once, one projection, no join."""
    out = F.lit(0)
    for rx in aliases:
        out = out + F.regexp_count(text, F.lit(rx))
    return out.cast("long")


def hits_wide(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """docs with ``hits``, an array of (topic, topic_ord, hits) in lexicon order."""
    entries = lambda low: F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(k).alias("topic_ord"), topic_hits(low, rx).alias("hits")) for k, (t, rx) in enumerate(lexicon.items())])
    return docs.withColumn("hits", let(F.lower(F.col(text_col)), entries))


def topic_counts(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of hits for each topic (and key); topics without a hit stay, with 0."""
    sums = docs.select(*keys, F.lower(F.col(text_col)).alias("_t")).select(*keys, *[topic_hits(F.col("_t"), rx).alias(f"_{k}") for k, rx in enumerate(lexicon.values())])
    sums = sums.groupBy(*keys).agg(*[F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(f"_{k}") for k in range(len(lexicon))])
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(k).alias("topic_ord"), F.col(f"_{k}").alias("hits")) for k, t in enumerate(lexicon)])
    return sums.select(*keys, F.inline(rows))


def share(hits: Column, total: Column) -> Column:
    return hits / F.when(total == 0, 1).otherwise(total)


def topic_gap(counts: DataFrame, side_col: str, left: str, right: str) -> DataFrame:
    """Shares of two sides, their gap in percentage points, and their ratio."""
    by = lambda s: F.sum(F.when(F.col(side_col) == s, F.col("hits")).otherwise(0))
    both = counts.groupBy("topic", "topic_ord").agg(by(left).alias("exam_hits"), by(right).alias("prep_hits"))
    w = Window.partitionBy()  # one row per topic of the lexicon
    a, b = share(F.col("exam_hits"), F.sum("exam_hits").over(w)), share(F.col("prep_hits"), F.sum("prep_hits").over(w))
    both = both.withColumns({"_a": a, "_b": b})
    pct = lambda c: F.round(100 * c, 2)
    return both.select("topic", "topic_ord", "exam_hits", "prep_hits", pct(F.col("_a")).alias("exam_share_pct"), pct(F.col("_b")).alias("prep_share_pct"), pct(F.col("_a") - F.col("_b")).alias("share_gap_pp"), F.round(F.col("_a") / (F.col("_b") + 1e-9), 2).alias("exam_to_prep_ratio"))


def argmax_topic(hits: Column, allowed: Column | None = None) -> Column:
    """The topic with most hits, ties to the first in the lexicon; null without a hit."""
    pool = F.filter(hits, lambda h: h["hits"] > 0)
    if allowed is not None:
        pool = F.filter(pool, lambda h: F.array_contains(allowed, h["topic"]))
    best = F.array_max(F.transform(pool, lambda h: F.struct(h["hits"], (-h["topic_ord"]).alias("o"), h["topic"])))
    return best["topic"]


def constrained_topic(strong: Column, hits: Column, multi: Column, single: Column) -> Column:
    """The topic under the chapters' allowed sets.

    multi / single: allowed topics of a multi-chapter or single-chapter source, null where the case doesn't apply."""
    any_hit = F.exists(hits, lambda h: h["hits"] > 0)
    inside = lambda allowed: F.coalesce(F.array_contains(allowed, strong), F.lit(False))
    free = argmax_topic(hits)
    many = F.when(inside(multi), strong).when(~any_hit, strong).otherwise(F.coalesce(argmax_topic(hits, multi), strong, free))
    one = F.when(inside(single), strong).when(F.size(single) == 0, F.coalesce(strong, free)).when(~any_hit, F.lit(None)).otherwise(F.coalesce(argmax_topic(hits, single), strong, free))
    return F.when(multi.isNotNull(), many).when(single.isNotNull(), one).otherwise(F.coalesce(strong, free))
