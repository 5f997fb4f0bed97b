"""Topic analytics: counts, gaps, classification, likelihood."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as lx
from ..shared import spread, written
from .registry import Inline, query, table

LEXICON = {"endings": ["tion", "ment[ .,]"], "water": ["eau", "oui"], "unity": ["heit", "keit"], "motion": ["mente", "ando"], "being": [" ist ", " est ", " is "], "nothing": ["zzzqqq"], "linking": [" and ", " und ", " et ", " y "]}
ROWS = Inline("topic string, topic_ord int, rx string", [(t, k, rx) for k, (t, rxs) in enumerate(LEXICON.items()) for rx in rxs])
SIDE = "CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'exam' ELSE 'prep' END"
SQL_HITS = f"(SELECT doc_id, source, lang, topic, topic_ord, sum(len(regexp_extract_all(lower(text), rx)))::BIGINT AS hits FROM documents, {ROWS.sql()} GROUP BY ALL)"


def sides(spark, d):
    side = F.when(F.col("source").isin("src0", "src1", "src2"), "exam").otherwise("prep")
    return spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text")).withColumn("side", side)


@query("topic_counts", "A01 J15 D9", f"SELECT topic, topic_ord, sum(hits)::BIGINT AS hits FROM {SQL_HITS} GROUP BY ALL")
def topic_counts(spark, d):
    return lx.topic_counts(sides(spark, d), LEXICON)


@query("topic_counts_table", "J15 A02", f"SELECT topic, sum(hits)::BIGINT AS hits FROM {SQL_HITS} GROUP BY ALL HAVING sum(hits) > 0")
def topic_counts_table(spark, d):
    """The lexicon as a table of a dozen rows: a join with every text, zeros dropped."""
    pairs = sides(spark, d).crossJoin(F.broadcast(ROWS.df(spark)))
    return pairs.groupBy("topic").agg(F.sum(F.regexp_count(F.lower("text"), F.col("rx"))).cast("long").alias("hits")).where("hits > 0")


SQL_GAP = f"""
(SELECT topic, topic_ord, exam_hits::BIGINT AS exam_hits, prep_hits::BIGINT AS prep_hits, round(100 * a, 2) AS exam_share_pct, round(100 * b, 2) AS prep_share_pct, round(100 * (a - b), 2) AS share_gap_pp, round(a / (b + 1e-9), 2) AS exam_to_prep_ratio
FROM (SELECT *, exam_hits / coalesce(nullif(sum(exam_hits) OVER (), 0), 1) AS a, prep_hits / coalesce(nullif(sum(prep_hits) OVER (), 0), 1) AS b
FROM (SELECT topic, topic_ord, coalesce(sum(hits) FILTER ({SIDE} = 'exam'), 0) AS exam_hits, coalesce(sum(hits) FILTER ({SIDE} = 'prep'), 0) AS prep_hits FROM {SQL_HITS} GROUP BY ALL)))
"""


def gap(spark, d):
    return lx.topic_gap(lx.topic_counts(sides(spark, d), LEXICON, keys=("side",)), "side", "exam", "prep")


@query("topic_gap", "A03 A04 D14 Q14", f"SELECT * FROM {SQL_GAP}")
def topic_gap(spark, d):
    return gap(spark, d)


@query("gap_top", "T09 K03", f"SELECT * FROM {SQL_GAP} WHERE share_gap_pp > 0 AND exam_hits >= 3 ORDER BY share_gap_pp DESC, topic_ord LIMIT 8")
def gap_top(spark, d):
    return gap(spark, d).where("share_gap_pp > 0 AND exam_hits >= 3").orderBy(F.desc("share_gap_pp"), "topic_ord").limit(8)


@query("topic_argmax", "C01", f"SELECT d.doc_id, topic FROM documents d LEFT JOIN (SELECT doc_id, arg_max(topic, hits * 1000 - topic_ord) AS topic FROM {SQL_HITS} WHERE hits > 0 GROUP BY doc_id) USING (doc_id)")
def topic_argmax(spark, d):
    return lx.hits_wide(sides(spark, d), LEXICON).select("doc_id", lx.argmax_topic(F.col("hits")).alias("topic"))


BODIES = Inline("id int, strong string, h1 int, h2 int, h3 int, multi array<string>, single array<string>", [
    (1, "b", 3, 0, 1, ["a", "b"], None), (2, "c", 3, 0, 1, ["a", "b"], None), (3, "c", 0, 0, 0, ["a"], None), (4, None, 2, 2, 0, ["b"], None),
    (5, None, 0, 0, 4, ["a"], None), (6, "a", 0, 1, 0, None, ["a"]), (7, "c", 1, 0, 0, None, []), (8, "c", 0, 0, 0, None, ["a"]),
    (9, None, 2, 5, 1, None, ["a", "c"]), (10, "c", 0, 5, 0, None, ["a"]), (11, "b", 9, 0, 0, None, None), (12, None, 1, 1, 0, None, None), (13, None, 0, 0, 0, None, None),
])


def sql_best(allowed: str | None) -> str:
    ok = lambda t: f"AND list_contains({allowed}, '{t}')" if allowed else ""
    score = lambda t, k: f"(CASE WHEN h{k} > 0 {ok(t)} THEN h{k} * 10 - {k} ELSE -1 END)"
    a, b, c = score("a", 1), score("b", 2), score("c", 3)
    return f"(CASE greatest({a}, {b}, {c}) WHEN -1 THEN NULL WHEN {a} THEN 'a' WHEN {b} THEN 'b' ELSE 'c' END)"


@query("constrained_class", "C03 U08", f"""
SELECT id, CASE
  WHEN multi IS NOT NULL THEN CASE WHEN list_contains(multi, strong) THEN strong WHEN h1 + h2 + h3 = 0 THEN strong ELSE coalesce({sql_best('multi')}, strong, {sql_best(None)}) END
  WHEN single IS NOT NULL THEN CASE WHEN list_contains(single, strong) THEN strong WHEN len(single) = 0 THEN coalesce(strong, {sql_best(None)}) WHEN h1 + h2 + h3 = 0 THEN NULL ELSE coalesce({sql_best('single')}, strong, {sql_best(None)}) END
  ELSE coalesce(strong, {sql_best(None)}) END AS topic
FROM {BODIES.sql()}
""")
def constrained_class(spark, d):
    hits = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(k).alias("topic_ord"), F.col(f"h{k + 1}").alias("hits")) for k, t in enumerate("abc")])
    return BODIES.df(spark).select("id", lx.constrained_topic(F.col("strong"), hits, F.col("multi"), F.col("single")).alias("topic"))


@query("relative_weight", "A05", f"SELECT topic, round(hits / coalesce(nullif(max(hits) OVER (), 0), 1), 6) AS weight FROM (SELECT topic, sum(hits) AS hits FROM {SQL_HITS} WHERE source = 'src3' GROUP BY topic)")
def relative_weight(spark, d):
    counts = lx.topic_counts(sides(spark, d).where("source = 'src3'"), LEXICON)
    most = counts.agg(F.max("hits").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("topic", F.round(F.col("hits") / F.when(F.col("most") == 0, 1).otherwise(F.col("most")), 6).alias("weight"))


SQL_LIKELIHOOD = f"""
WITH g AS {SQL_GAP},
w AS (SELECT topic, hits / coalesce(nullif(max(hits) OVER (), 0), 1) AS fw FROM (SELECT topic, sum(hits) AS hits FROM {SQL_HITS} WHERE source = 'src3' GROUP BY topic)),
p AS (SELECT doc_id, source, topic FROM documents JOIN (SELECT doc_id, arg_max(topic, hits * 1000 - topic_ord) AS topic FROM {SQL_HITS} WHERE hits > 0 GROUP BY doc_id) USING (doc_id)),
f AS (SELECT topic, count(*) FILTER (source IN ('src0', 'src1')) AS practice, count(*) FILTER (source = 'src2') AS exam FROM p GROUP BY topic),
s AS (SELECT *, practice / coalesce(nullif(sum(practice) OVER (), 0), 1) AS ps, exam / coalesce(nullif(sum(exam) OVER (), 0), 1) AS es FROM f)
SELECT doc_id, topic, round(300 * ps + 200 * es + 400 * coalesce(fw, 0) + CASE WHEN source IN ('src0', 'src1') THEN 4 WHEN source = 'src2' THEN 2 ELSE 0 END + 0.05 * greatest(coalesce(share_gap_pp, 0), 0), 3) AS score
FROM p LEFT JOIN s USING (topic) LEFT JOIN w USING (topic) LEFT JOIN g USING (topic)
"""


@query("likelihood_rank", "C06 J07 T18 D15", SQL_LIKELIHOOD)
def likelihood_rank(spark, d):
    """One pass over the texts writes the hits of each document; every share and weight comes from these narrow rows."""
    rows = written(lx.hits_wide(sides(spark, d), LEXICON).select("doc_id", "source", "side", "hits", lx.argmax_topic(F.col("hits")).alias("topic")))
    counts = rows.select("source", "side", F.inline("hits").alias("hit_topic", "topic_ord", "hits")).groupBy("source", "side", F.col("hit_topic").alias("topic"), "topic_ord").agg(F.sum("hits").alias("hits"))
    counts = written(counts)  # a row for each source and topic
    f = rows.where("topic IS NOT NULL").groupBy("topic").agg(F.count_if(F.col("source").isin("src0", "src1")).alias("practice"), F.count_if(F.col("source") == "src2").alias("exam"))
    total = f.agg(F.sum("practice").alias("tp"), F.sum("exam").alias("te"))
    s = f.crossJoin(F.broadcast(total)).select("topic", lx.share(F.col("practice"), F.col("tp")).alias("ps"), lx.share(F.col("exam"), F.col("te")).alias("es"))
    sheet = counts.groupBy("topic").agg(F.sum(F.when(F.col("source") == "src3", F.col("hits")).otherwise(0)).alias("hits"))
    w = sheet.crossJoin(F.broadcast(sheet.agg(F.max("hits").alias("most")))).select("topic", (F.col("hits") / F.when(F.col("most") == 0, 1).otherwise(F.col("most"))).alias("fw"))
    gaps = lx.topic_gap(counts, "side", "exam", "prep").select("topic", "share_gap_pp")
    lookups = s.join(w, "topic", "left").join(gaps, "topic", "left")  # a row per topic
    ranked = rows.where("topic IS NOT NULL").select("doc_id", "source", "topic").join(F.broadcast(lookups), "topic", "left")
    kind = F.when(F.col("source").isin("src0", "src1"), 4).when(F.col("source") == "src2", 2).otherwise(0)
    score = 300 * F.col("ps") + 200 * F.col("es") + 400 * F.coalesce("fw", F.lit(0)) + kind + 0.05 * F.greatest(F.coalesce("share_gap_pp", F.lit(0.0)), F.lit(0.0))
    return ranked.select("doc_id", "topic", F.round(score, 3).alias("score"))


@query("topics_by_likelihood", "A08 F02", f"""
WITH s AS ({SQL_LIKELIHOOD}) SELECT topic, count(*)::BIGINT AS n, max(score) AS best, arg_min(doc_id, (-score, doc_id)) AS first_doc FROM s GROUP BY topic
""")
def topics_by_likelihood(spark, d):
    """Each topic's number of ranked documents, its best score and the document that has it."""
    ranked = likelihood_rank(spark, d)
    return ranked.groupBy("topic").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min_by("doc_id", F.struct(-F.col("score"), "doc_id")).alias("first_doc"))


@query("prep_index", "A12", f"SELECT topic, list_sort(list_distinct(list(source))) AS sources FROM {SQL_HITS} WHERE hits > 0 GROUP BY topic")
def prep_index(spark, d):
    hits = lx.hits_wide(sides(spark, d), LEXICON).select("source", F.inline("hits")).where("hits > 0")
    return hits.groupBy("topic").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query("topic_score_sum", "A25 C12", f"""
WITH a AS (SELECT topic, sum(hits) AS hits FROM {SQL_HITS} GROUP BY topic), b AS (SELECT topic, count(*) AS docs FROM {SQL_HITS} WHERE hits > 0 GROUP BY topic),
c AS (SELECT topic, sum(len(regexp_extract_all(lower(text), topic)))::BIGINT AS words FROM documents, (SELECT DISTINCT topic FROM {ROWS.sql()}) WHERE length(topic) > 4 GROUP BY topic)
SELECT a.topic, (4 * coalesce(docs, 0) + 0.5 * a.hits + 2 * coalesce(words, 0))::DOUBLE AS score FROM a LEFT JOIN b USING (topic) LEFT JOIN c USING (topic)
""")
def topic_score_sum(spark, d):
    docs = sides(spark, d)
    a = lx.topic_counts(docs, LEXICON).select("topic", F.col("hits").alias("all_hits"))
    b = lx.hits_wide(docs, LEXICON).select(F.inline("hits")).where("hits > 0").groupBy("topic").agg(F.count("*").alias("docs"))
    c = lx.topic_counts(docs, {t: [t] for t in LEXICON if len(t) > 4}).select("topic", F.col("hits").alias("words"))
    joined = a.join(b, "topic", "left").join(c, "topic", "left")
    return joined.select("topic", (4 * F.coalesce("docs", F.lit(0)) + 0.5 * F.col("all_hits") + 2 * F.coalesce("words", F.lit(0))).alias("score"))
