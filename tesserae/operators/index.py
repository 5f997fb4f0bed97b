"""Inverted index and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from ..shared import written

K1, B = 1.5, 0.75


def with_tokens(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_ord"), tokens(text_col).alias("terms"))


def postings(chunks: DataFrame, id_col: str = "chunk_ord", text_col: str = "text") -> DataFrame:
    """(term, chunk_ord, tf). Chunks are dealt by id, so that counting inside a chunk needs no further shuffle."""
    terms = with_tokens(chunks.repartition(id_col), id_col, text_col).select("chunk_ord", F.explode("terms").alias("term"))
    return terms.groupBy("term", "chunk_ord").agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame, id_col: str = "chunk_ord", text_col: str = "text") -> DataFrame:
    """(chunk_ord, dl)"""
    return with_tokens(chunks, id_col, text_col).select("chunk_ord", F.size("terms").cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n, avgdl"""
    return stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25_term(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    length = F.when(dl == 0, 1).otherwise(dl) / F.when(avgdl == 0, 1.0).otherwise(avgdl)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))


def query_rows(chunks: DataFrame, terms: list[str], id_col: str = "chunk_ord", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(chunk_ord, dl, hits): the length of each chunk and its query terms; all that scores of one query need. extra:
    further columns."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    found = lambda ts: F.struct(F.size(ts).alias("dl"), F.filter(ts, lambda t: F.array_contains(wanted, t)).alias("hits"))
    rows = chunks.select(F.col(id_col).alias("chunk_ord"), let(tokens(text_col), found).alias("f"), *[c.alias(n) for n, c in (extra or {}).items()])
    return rows.select("chunk_ord", "f.dl", "f.hits", *(extra or {}))


def bm25_scores(rows: DataFrame) -> DataFrame:
    """(chunk_ord, score) of all chunks with a query term, from query_rows(): pass a written table, it is read twice.

    Only query terms are exploded; statistics cover the whole corpus."""
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = rows.where(F.size("hits") > 0).select("chunk_ord", "dl", F.explode("hits").alias("term")).groupBy("chunk_ord", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as query terms
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    score = bm25_term(*(F.col(c) for c in ("tf", "df", "dl", "n", "avgdl")))
    return scored.groupBy("chunk_ord").agg(F.sum(score).alias("score"))


def stored_index(chunks: DataFrame, id_col: str = "chunk_ord", text_col: str = "text") -> dict[str, DataFrame]:
    """postings, doc_stats and corpus_stats as written tables, built once for any number of queries."""
    found = written(postings(chunks, id_col, text_col))
    stats = written(doc_stats(chunks, id_col, text_col))
    return {"postings": found, "doc_stats": stats, "corpus_stats": written(corpus_stats(stats))}


def bm25_search(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, chunk_ord, score) for many queries (query_id, text) over a stored index (postings, doc_stats, corpus_stats)."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    hits = index["postings"].join(wanted.select("term").distinct(), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(df, "term").join(index["doc_stats"], "chunk_ord").crossJoin(F.broadcast(index["corpus_stats"]))
    rows = rows.withColumn("part", bm25_term(*(F.col(c) for c in ("tf", "df", "dl", "n", "avgdl"))))
    return rows.join(wanted, "term").groupBy("query_id", "chunk_ord").agg(F.sum("part").alias("score"))
