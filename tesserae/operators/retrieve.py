"""Dense search, hybrid merging, clause fan-out, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of equal length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of one query, exactly: one scan, a top-k in each task, no sort of all rows."""
    dist = squared_l2(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(id_col, dist.alias("dist")).orderBy("dist", id_col).limit(k)


def filtered_or_all(hits: DataFrame, condition: Column, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows that meet the condition; if none does, the first k of all."""
    some = hits.where(condition).orderBy(*order).limit(k)
    none = some.agg(F.count("*").alias("_n")).where("_n = 0")
    return some.unionByName(hits.orderBy(*order).limit(k).crossJoin(F.broadcast(none)).drop("_n"))


def merge_lists(lists: list[list[tuple[str, str]]], k: int, cap: int, fill: bool) -> list[tuple[str, str]]:
    """Lists take turns; each gives its next (id, source) that is new and whose source is below the cap.

    fill: afterwards the rest follows in list order without the cap."""
    out: list[tuple[str, str]] = []
    seen: set[str] = set()
    per_source: dict[str, int] = {}
    heads = [iter(x) for x in lists]
    live = list(range(len(lists)))
    while live and len(out) < k:
        for n in list(live):
            if len(out) >= k:
                break
            for item, source in heads[n]:
                if item not in seen and per_source.get(source, 0) < cap:
                    seen.add(item)
                    per_source[source] = per_source.get(source, 0) + 1
                    out.append((item, source))
                    break
            else:
                live.remove(n)
    if fill:
        for item, source in (x for own in lists for x in own):
            if len(out) >= k:
                break
            if item not in seen:
                seen.add(item)
                out.append((item, source))
    return out


def hybrid_merge(ranked: DataFrame, sides: list[str] | None, k: int, cap: int, fill: bool = True) -> DataFrame:
    """(query_id, rank, id, source) from ranked lists (query_id, side, rnk, id, source); a query's lists hold some 8k rows.

    sides: the lists' order; None: by name."""

    def merge(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["rnk", "id"])
        lists = [[(r.id, r.source) for r in pdf[pdf["side"] == s].itertuples()] for s in sides or sorted(set(pdf["side"]))]
        out = merge_lists(lists, k, cap, fill)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(out), "rank": range(1, len(out) + 1), "id": [x for x, _ in out], "source": [s for _, s in out]})

    return ranked.groupBy("query_id").applyInPandas(merge, "query_id string, rank int, id string, source string")


def clause_queries(questions: DataFrame, k: int) -> DataFrame:
    """(query_id, clause, text, size): each question whole (clause 0, k rows) and, if it has several, each of its clauses
    (from 1 on, an equal share of k but two at least)."""
    parts = questions.select("query_id", "question", clauses(F.col("question")).alias("c"))
    whole = parts.select("query_id", F.lit(0).alias("clause"), F.col("question").alias("text"), F.lit(k).alias("size"))
    share = F.greatest(F.lit(2), F.floor(F.lit(k) / F.size("c")).cast("int"))
    each = parts.where(F.size("c") > 1).select("query_id", share.alias("size"), F.posexplode("c").alias("p", "text"))
    return whole.unionByName(each.select("query_id", (F.col("p") + 1).alias("clause"), "text", "size"))


def clauses(question: Column) -> Column:
    """Parts between ? ; , and the word "and" that have at least three words."""
    parts = F.transform(F.split(question, r"(?i)[?;,]|\band\b"), lambda c: F.trim(c))
    return F.filter(parts, lambda c: F.size(F.split(c, r"\s+")) >= 3)


def within_budget(df: DataFrame, keys: list[str], order: list[str], text_col: str, budget: int) -> DataFrame:
    """Texts in order until their characters reach the budget; the last is cut. keys and order name a row.

    The running sum sees lengths only; texts join back for the few rows that fit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    narrow = df.select(*keys, *order, F.length(text_col).alias("_n"))
    fits = narrow.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).where(F.col("_before") < budget).drop("_n")
    out = df.join(fits, [*keys, *order])
    return out.withColumn(text_col, F.expr(f"substring({text_col}, 1, {budget} - _before)")).drop("_before")


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
