"""Retrieval: exact neighbours, merging, clauses, budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import index, retrieve
from .q_text import BM25_TERMS, CORPUS, TOKENS, query_rows
from .registry import Inline, query, table

DIST = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))"


def query_vector(spark, d, vec_id=7):
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


@query("knn_exact", "T01 O21", f"SELECT e.vec_id, round({DIST}, 6) AS dist FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY {DIST}, e.vec_id LIMIT 20")
def knn_exact(spark, d):
    return retrieve.nearest(table(spark, d, "embeddings"), query_vector(spark, d), 20).select("vec_id", F.round("dist", 6).alias("dist"))


@query("knn_filtered", "T01 P02 O1", f"SELECT e.vec_id, round({DIST}, 6) AS dist FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND e.label = 3 ORDER BY {DIST}, e.vec_id LIMIT 6")
def knn_filtered(spark, d):
    hits = table(spark, d, "embeddings").where("label = 3")
    return retrieve.nearest(hits, query_vector(spark, d), 6).select("vec_id", F.round("dist", 6).alias("dist"))


@query("knn_fallback", "T05 P02", f"""
WITH h AS (SELECT e.vec_id, e.label, {DIST} AS dist FROM embeddings e, embeddings q WHERE q.vec_id = 7),
a AS (SELECT * FROM h WHERE label = 999 ORDER BY dist, vec_id LIMIT 6), b AS (SELECT * FROM h ORDER BY dist, vec_id LIMIT 6)
SELECT vec_id, round(dist, 6) AS dist FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM a) = 0)
""")
def knn_fallback(spark, d):
    dist = retrieve.squared_l2(F.col("embedding"), F.array(*[F.lit(x) for x in query_vector(spark, d)]))
    hits = table(spark, d, "embeddings").select("vec_id", "label", dist.alias("dist"))
    return retrieve.filtered_or_all(hits, F.col("label") == 999, ["dist", "vec_id"], 6).select("vec_id", F.round("dist", 6).alias("dist"))


@query("filter_after_limit", "Q5 O3 T02", f"""
WITH t AS (SELECT doc_id, lang, {TOKENS} AS terms FROM {CORPUS}),
tf AS (SELECT doc_id, lang, len(list_filter(terms, lambda x: x = 'tion')) AS tf FROM t)
SELECT doc_id, tf::BIGINT AS tf FROM (SELECT * FROM tf ORDER BY tf DESC, doc_id LIMIT 40) WHERE lang = 'fr'
""")
def filter_after_limit(spark, d):
    rows = query_rows(spark, d, ["tion"]).select(F.col("chunk_ord").alias("doc_id"), F.size("hits").cast("long").alias("tf"))
    tf = rows.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return tf.orderBy(F.desc("tf"), "doc_id").limit(40).where("lang = 'fr'").select("doc_id", "tf")


LISTS = Inline("query_id string, side string, rnk int, id string, source string", [
    *[("q1", "dense", k, i, s) for k, (i, s) in enumerate([("d1", "A"), ("d2", "A"), ("d3", "A"), ("d4", "B"), ("d5", "C")])],
    *[("q1", "keyword", k, f"k{k}", f"K{k}") for k in range(1, 5)], *[("q2", "dense", k, f"x{k}", "A") for k in range(6)], ("q2", "keyword", 0, "x3", "A"),
])


@query("hybrid_merge", "T03 Q3 Q4")
def hybrid_merge(spark, d):
    return retrieve.hybrid_merge(LISTS.df(spark), ["dense", "keyword"], k=6, cap=2)


@query("multi_merge", "T04 Q4")
def multi_merge(spark, d):
    return retrieve.hybrid_merge(LISTS.df(spark), ["dense", "keyword"], k=6, cap=2, fill=False)


@query("hybrid_search", "T01 T02 T03 J23 O4 O6")
def hybrid_search(spark, d):
    """Vector and keyword lists of 4k rows, merged under a cap per source; narrow rows are ranked, texts join at the end."""
    k, rows = 8, query_rows(spark, d, BM25_TERMS)
    kept = rows.select(F.col("chunk_ord").alias("doc_id"))
    dense = retrieve.nearest(table(spark, d, "embeddings"), query_vector(spark, d), 4 * k).select(F.col("vec_id").alias("doc_id"), F.col("dist").alias("key"))
    words = index.bm25_scores(rows).select(F.col("chunk_ord").alias("doc_id"), (-F.col("score")).alias("key")).orderBy("key", "doc_id").limit(4 * k)
    both = dense.join(kept, "doc_id").withColumn("side", F.lit("dense")).unionByName(words.withColumn("side", F.lit("keyword")))
    docs = table(spark, d, "documents")
    ranked = docs.select("doc_id", "source").join(F.broadcast(both), "doc_id").withColumn("query_id", F.lit("q")).withColumn("id", F.col("doc_id").cast("string"))  # 8k rows
    ranked = ranked.withColumn("rnk", F.row_number().over(Window.partitionBy("side").orderBy("key", "doc_id")))
    merged = retrieve.hybrid_merge(ranked.select("query_id", "side", "rnk", "id", "source"), ["dense", "keyword"], k, 2)
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 200).alias("snippet"))
    return texts.join(F.broadcast(merged), "id")


QUESTIONS = Inline("query_id string, question string", [("a", "what is the mean of this"), ("b", "compare the two groups, explain the large gap and list all known causes?"), ("c", "one two; the brand names here"), ("d", "")])


@query("split_clauses", "X13", rf"""
SELECT query_id, list_filter(list_transform(string_split_regex(question, '(?i)[?;,]|\band\b'), lambda c: trim(c)), lambda c: len(string_split_regex(c, '\s+')) >= 3) AS clauses FROM {QUESTIONS.sql()}
""")
def split_clauses(spark, d):
    return QUESTIONS.df(spark).select("query_id", retrieve.clauses(F.col("question")).alias("clauses"))


ASKED = Inline("query_id string, question string", [("a", "the tion heit"), ("b", "what is the tion of the verein, explain the keit and heit here; list de la que?"), ("c", "zzz yyy xxx"), ("d", "")])


@query("multi_clause_search", "T04 X13 T02 Q4")
def multi_clause_search(spark, d):
    """Each question is searched whole and clause by clause over one stored index; then the lists take turns under a cap
    for each source. There is no fill, so a question may get fewer rows."""
    k, docs = 12, table(spark, d, "documents")
    stored = index.stored_index(docs.select("doc_id", "text"), "doc_id")
    asked = retrieve.clause_queries(ASKED.df(spark), k).withColumn("key", F.concat_ws("#", "query_id", F.col("clause").cast("string")))
    scores = index.bm25_search(stored, asked.select(F.col("key").alias("query_id"), "text")).withColumnRenamed("query_id", "key")
    w = Window.partitionBy("key").orderBy(F.desc(F.round("score", 9)), "chunk_ord")
    lists = scores.join(F.broadcast(asked.select("key", "query_id", "clause", "size")), "key").withColumn("rnk", F.row_number().over(w)).where("rnk <= size")
    ranked = lists.join(docs.select(F.col("doc_id").alias("chunk_ord"), "source"), "chunk_ord")
    ranked = ranked.select("query_id", F.col("clause").alias("side"), "rnk", F.col("chunk_ord").cast("string").alias("id"), "source")
    return retrieve.hybrid_merge(ranked, None, k, 2, fill=False)


@query("char_budget", "W04 P21 Z13", """
SELECT source, doc_id, length(substr(text, 1, (25000 - before)::BIGINT))::INT AS chars, sha1(substr(text, 1, (25000 - before)::BIGINT)) AS part_sha1
FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 25000
""")
def char_budget(spark, d):
    kept = retrieve.within_budget(table(spark, d, "documents").select("source", "doc_id", "text"), ["source"], ["doc_id"], "text", 25000)
    return kept.select("source", "doc_id", F.length("text").alias("chars"), F.sha1("text").alias("part_sha1"))


@query("topm_per_source", "W01 T10", """
SELECT source, doc_id, hits::BIGINT AS hits, place::INT AS place FROM (
  SELECT source, doc_id, hits, row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) AS place
  FROM (SELECT source, doc_id, len(regexp_extract_all(lower(text), 'tion')) AS hits FROM documents) WHERE hits >= 1) WHERE place <= 3
""")
def topm_per_source(spark, d):
    hits = table(spark, d, "documents").select("source", "doc_id", F.regexp_count(F.lower("text"), F.lit("tion")).cast("long").alias("hits")).where("hits >= 1")
    return retrieve.first_n(hits, ["source"], [F.desc("hits"), "doc_id"], 3).select("source", "doc_id", "hits", "place")


@query("context_fallback", "T10", """
WITH s AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY len(regexp_extract_all(lower(text), 'heit')) DESC, doc_id) AS place, len(regexp_extract_all(lower(text), 'heit')) AS hits FROM documents),
a AS (SELECT source, doc_id, least(length(text), 8000) AS chars FROM s WHERE hits >= 2 AND place <= 4), t AS (SELECT source, sum(chars) AS total FROM a GROUP BY source),
b AS (SELECT source, doc_id, least(length(text), 15000) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS big FROM documents) WHERE big <= 2)
SELECT source, doc_id, chars::BIGINT AS chars, FALSE AS fallback FROM a UNION ALL
SELECT b.source, b.doc_id, b.chars::BIGINT, TRUE FROM b LEFT JOIN t USING (source) WHERE coalesce(total, 0) < 5000
""")
def context_fallback(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"), F.regexp_count(F.lower("text"), F.lit("heit")).alias("hits"))
    a = retrieve.first_n(docs, ["source"], [F.desc("hits"), "doc_id"], 4).where("hits >= 2").select("source", "doc_id", F.least("n", F.lit(8000)).cast("long").alias("chars"), F.lit(False).alias("fallback"))
    b = retrieve.first_n(docs, ["source"], [F.desc("n"), "doc_id"], 2).select("source", "doc_id", F.least("n", F.lit(15000)).cast("long").alias("chars"), F.lit(True).alias("fallback"))
    enough = a.groupBy("source").agg(F.sum("chars").alias("total")).where("total >= 5000")
    return a.unionByName(b.join(enough, "source", "left_anti"))
