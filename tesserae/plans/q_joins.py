"""Joins and lookups, unions and set operations, aggregates over nested data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, lookups
from .registry import Inline, query, table


@query("wrong_questions", "J01 D19", """
SELECT l_orderkey, l_linenumber, round(o_totalprice - l_extendedprice, 2) AS lost FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice IS NOT NULL AND o_totalprice IS NOT NULL AND l_extendedprice < o_totalprice
""")
def wrong_questions(spark, d):
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).where("l_extendedprice IS NOT NULL AND o_totalprice IS NOT NULL AND l_extendedprice < o_totalprice")
    return joined.select("l_orderkey", "l_linenumber", F.round(F.col("o_totalprice") - F.col("l_extendedprice"), 2).alias("lost"))


@query("saved_left_join", "J02", """
SELECT c_custkey, last_order, last_price, last_order IS NULL AS missing FROM customer LEFT JOIN
 (SELECT o_custkey AS c_custkey, max(o_orderkey) AS last_order, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1) USING (c_custkey)
""")
def saved_left_join(spark, d):
    dim = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price"))
    return lookups.lookup_last(table(spark, d, "customer").select("c_custkey"), dim, "c_custkey", "o_orderkey")


@query("state_left_joins", "J03", """
SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, b.item_id IS NOT NULL AS starred, coalesce(e.label, -1) AS attempts
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN benchmark b ON b.item_id = doc_id LEFT JOIN embeddings e ON e.vec_id = doc_id
""")
def state_left_joins(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    star = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("starred"))
    tries = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    out = docs.join(table(spark, d, "labels"), "doc_id", "left").join(star, "doc_id", "left").join(tries, "doc_id", "left")
    fill = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return out.select("doc_id", fill("quality", 0).alias("quality"), fill("toxic", 0).alias("toxic"), fill("starred", False).alias("starred"), fill("label", -1).alias("attempts"))


@query("anti_not_done", "J04 U06 O15", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_not_done(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("semi_flagged", "J05", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_flagged(spark, d):
    flagged = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(flagged, "o_orderkey", "left_semi")


@query("priority_inner", "J06 Q20 O13", """
SELECT n_name, coalesce(total, 0)::BIGINT AS total, coalesce(done, 0)::BIGINT AS done, round_even(100.0 * coalesce(done, 0) / greatest(coalesce(total, 0), 1), 0)::BIGINT AS pct FROM nation
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS done FROM customer GROUP BY 1) ON k = n_nationkey WHERE coalesce(total, 0) > 0
""")
def priority_inner(spark, d):
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("done"))
    out = table(spark, d, "nation").join(counts, "n_nationkey", "left").where("total > 0")
    return out.select("n_name", "total", "done", F.bround(100.0 * F.col("done") / F.greatest("total", F.lit(1)), 0).cast("long").alias("pct"))


@query("enriched_mistakes", "J08 J09", """
SELECT l_orderkey, l_linenumber, coalesce(p_name, 'unknown') AS part, coalesce(s_name, 'unknown') AS supplier FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'
""")
def enriched_mistakes(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p, s = table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    out = li.join(p, li["l_partkey"] == p["p_partkey"], "left").join(s, li["l_suppkey"] == s["s_suppkey"], "left")
    return out.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("unknown")).alias("part"), F.coalesce("s_name", F.lit("unknown")).alias("supplier"))


@query("question_state", "J10 A23", """
SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (role = 'assistant')::BIGINT AS answered, count(*) FILTER (length(text) > 200)::BIGINT AS saved, count(*) FILTER (role = 'assistant') > 0 AS any_answer FROM conversations GROUP BY conv_id
""")
def question_state(spark, d):
    done = F.count_if(F.col("role") == "assistant")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), done.alias("answered"), F.count_if(F.length("text") > 200).alias("saved"), (done > 0).alias("any_answer"))


SESSIONS = Inline("id string, name string", [("aabbccdd-1", "one"), ("aabbccdd-2", "two"), ("11223344-9", "three")])
SHORTS = Inline("short string", [("aabbccdd",), ("11223344",), ("ffffffff",)])


@query("prefix_join", "J13 S25", f"SELECT short, arg_min(name, id) AS name FROM {SHORTS.sql()} LEFT JOIN {SESSIONS.sql()} ON substr(id, 1, 8) = short GROUP BY short")
def prefix_join(spark, d):
    """The prefix has a fixed length, so an equi-join on it; the first session of equal prefixes wins."""
    by = SESSIONS.df(spark).groupBy(F.substring("id", 1, 8).alias("short")).agg(F.min_by("name", "id").alias("name"))
    return SHORTS.df(spark).join(by, "short", "left")


WORDS = Inline("word_ord int, word string", [(1, "blue"), (2, "steel"), (3, "green")])


@query("substring_join", "J14 P20", f"SELECT p_partkey, arg_min(word, word_ord) AS word FROM part JOIN {WORDS.sql()} ON contains(lower(p_name || ' ' || p_type), word) GROUP BY p_partkey")
def substring_join(spark, d):
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    pairs = table(spark, d, "part").select("p_partkey", text.alias("t")).join(F.broadcast(WORDS.df(spark)), F.col("t").contains(F.col("word")))
    return pairs.groupBy("p_partkey").agg(F.min_by("word", "word_ord").alias("word"))


NEW = Inline("id int, day date, title string", [(1, "2024-01-05", "Midterm exam in hall B"), (2, "2024-01-05", "Office hours"), (3, "2024-01-06", "Project report due")])
OLD = Inline("id int, day date, summary string, tag string", [(10, "2024-01-05", "midterm exam hall B", None), (11, "2024-01-05", "Office", "ours"), (12, "2024-01-06", "Report for the project", None)])
TOKS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for'))"


@query("date_overlap_join", "J16 C09 U07", f"""
SELECT new_id, old_id, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS share, tag IS NULL AND len(list_intersect(a, b)) / greatest(len(a), 1) >= 0.6 AS flagged
FROM (SELECT n.id AS new_id, o.id AS old_id, tag, {TOKS.format('title')} AS a, {TOKS.format('summary')} AS b FROM {NEW.sql()} n JOIN {OLD.sql()} o USING (day))
""")
def date_overlap_join(spark, d):
    n = NEW.df(spark).select(F.col("id").alias("new_id"), "day", lookups.title_tokens(F.col("title")).alias("a"))
    o = OLD.df(spark).select(F.col("id").alias("old_id"), "day", "tag", lookups.title_tokens(F.col("summary")).alias("b"))
    share = lookups.overlap(F.col("a"), F.col("b"))
    return n.join(o, "day").select("new_id", "old_id", F.round(share, 6).alias("share"), (F.col("tag").isNull() & (share >= 0.6)).alias("flagged"))


@query("upsert_action", "J17 A28", f"SELECT title, day, CASE WHEN day IN (SELECT day FROM {OLD.sql()} WHERE tag IS NOT NULL) THEN 'UPDATED' ELSE 'CREATED' END AS action FROM {NEW.sql()}")
def upsert_action(spark, d):
    return lookups.upsert_actions(NEW.df(spark).select("title", "day"), OLD.df(spark).where("tag IS NOT NULL"), "day")


@query("event_overrides", "J22", f"""
SELECT n.id, coalesce(o.summary, n.title) AS title FROM {NEW.sql()} n LEFT JOIN {OLD.sql()} o ON n.day = o.day AND starts_with(lower(o.summary), lower(substr(n.title, 1, 6)))
WHERE NOT EXISTS (SELECT 1 FROM {OLD.sql()} s WHERE s.tag IS NOT NULL AND s.day = n.day AND starts_with(n.title, s.summary))
""")
def event_overrides(spark, d):
    n, o = NEW.df(spark), OLD.df(spark)
    skip = o.where("tag IS NOT NULL").select(F.col("day").alias("sd"), F.col("summary").alias("ss"))
    left = n.join(skip, (n["day"] == skip["sd"]) & n["title"].startswith(skip["ss"]), "left_anti")
    by = o.select(F.col("day").alias("od"), "summary")
    out = left.join(by, (left["day"] == by["od"]) & F.lower(by["summary"]).startswith(F.lower(F.substring(left["title"], 1, 6))), "left")
    return out.select("id", F.coalesce("summary", "title").alias("title"))


CHAPTERS = Inline("size_from int, size_to int, topic string", [(1, 10, "small"), (11, 30, "medium"), (31, 50, "large")])


@query("mapping_join", "J18", f"SELECT p_partkey, topic FROM part JOIN {CHAPTERS.sql()} ON p_size BETWEEN size_from AND size_to")
def mapping_join(spark, d):
    m = F.broadcast(CHAPTERS.df(spark))
    return table(spark, d, "part").join(m, F.col("p_size").between(F.col("size_from"), F.col("size_to"))).select("p_partkey", "topic")


@query("cascading_lookup", "J20 Z06 Z02", """
SELECT doc_id, priority::INT AS priority, found FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, length(found), found) AS k FROM (
  SELECT doc_id, 0 AS priority, 'label' AS found FROM labels WHERE quality = 1 UNION ALL SELECT item_id, 1, substr(text, 1, 20) FROM benchmark UNION ALL SELECT doc_id, 2, source FROM documents)) WHERE k = 1
""")
def cascading_lookup(spark, d):
    a = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("label").alias("found"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.substring("text", 1, 20).alias("found"))
    c = table(spark, d, "documents").select("doc_id", F.col("source").alias("found"))
    return lookups.cascade([a, b, c], ["doc_id"], [F.length("found"), "found"]).select("doc_id", "priority", "found")


MATCHERS = Inline("m_ord int, rx string", [(1, "(?i)zzz"), (2, "(?i)token ="), (3, "(?i)heit")])


@query("first_matching_page", "J21 X19", f"SELECT lang, rx, min(doc_id) AS page FROM documents, {MATCHERS.sql()} WHERE regexp_matches(text, rx) GROUP BY ALL")
def first_matching_page(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "text")
    tests = F.array(*[F.when(F.col("text").rlike(rx), F.lit(rx)) for _, rx in MATCHERS.rows])  # literal patterns: one scan
    return docs.select("lang", "doc_id", F.explode(F.array_compact(tests)).alias("rx")).groupBy("lang", "rx").agg(F.min("doc_id").alias("page"))


@query("nested_explode", "D18 A09 A10 A11", """
SELECT o_orderkey, count(*)::BIGINT AS questions, sum(round(l_extendedprice * 100) * round(l_discount * 100))::BIGINT AS lost_e4, round(sum(round(l_extendedprice * 100) * round(l_discount * 100)) / (100 * nullif(sum(round(l_extendedprice * 100)), 0)), 6) AS pct
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def nested_explode(spark, d):
    li = table(spark, d, "lineitem")
    nested = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_discount")).alias("wrong"))
    nested = table(spark, d, "orders").select("o_orderkey").join(nested, "o_orderkey")
    cents = lambda c: F.round(c * 100).cast("long")
    total = lambda f: F.aggregate("wrong", F.lit(0).cast("long"), lambda a, x: a + f(x))
    lost, full = total(lambda x: cents(x["l_extendedprice"]) * cents(x["l_discount"])), total(lambda x: cents(x["l_extendedprice"]))
    return nested.select("o_orderkey", F.size("wrong").cast("long").alias("questions"), lost.alias("lost_e4"), F.round(lost / (100 * F.nullif(full, F.lit(0))), 6).alias("pct"))


@query("status_histogram", "A19 A21", "SELECT event_type AS action, count(*)::BIGINT AS n, count(*) FILTER (value > 0)::BIGINT AS ok, count(*) FILTER (value IS NULL OR value <= 0)::BIGINT AS failed FROM events GROUP BY 1")
def status_histogram(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.count_if(v > 0).alias("ok"), F.count_if(v.isNull() | (v <= 0)).alias("failed"))


@query("below_quota", "A24", "SELECT n_name, coalesce(n, 0)::BIGINT AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE coalesce(n, 0) < 5")
def below_quota(spark, d):
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n")).where("n < 5")


@query("keep_first_by_date", "A15 A16", """
SELECT user_id, day, event_id FROM (SELECT user_id, ts::DATE AS day, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE, substr(event_type, 1, 60) ORDER BY event_id) AS k FROM events) WHERE k = 1
""")
def keep_first_by_date(spark, d):
    ev = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.substring("event_type", 1, 60).alias("t"))
    return ev.groupBy("user_id", "day", "t").agg(F.min("event_id").alias("event_id")).select("user_id", "day", "event_id")


@query("mark_duplicates", "A17", "SELECT event_id, lead(1) OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) IS NOT NULL AS is_duplicate FROM events")
def mark_duplicates(spark, d):
    ev = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return dedup.mark_duplicates(ev, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("event_id", "is_duplicate")


@query("date_span", "A28", "SELECT event_type, min(ts::DATE) AS first_day, max(ts::DATE) AS last_day FROM events GROUP BY 1")
def date_span(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").groupBy("event_type").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("union_sources", "U01 U02 U03 D5 D6 D13", """
SELECT 0 AS src_ord, doc_id AS id, lang AS category, NULL AS role, sha1(text) AS h FROM documents UNION ALL SELECT 1, page_id, NULL, NULL, sha1(html) FROM pages UNION ALL SELECT 2, conv_id, NULL, role, sha1(text) FROM conversations
""")
def union_sources(spark, d):
    a = table(spark, d, "documents").select(F.lit(0).alias("src_ord"), F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.sha1("text").alias("h"))
    b = table(spark, d, "pages").select(F.lit(1).alias("src_ord"), F.col("page_id").alias("id"), F.sha1("html").alias("h"))
    c = table(spark, d, "conversations").select(F.lit(2).alias("src_ord"), F.col("conv_id").alias("id"), "role", F.sha1("text").alias("h"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("set_operations", "U04 U05 U06 U07 U08", """
SELECT n_regionkey, list_sort(list_distinct(list_concat(a, b))) AS either, list_sort(list_intersect(a, b)) AS both, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a FROM (
  SELECT n_regionkey, list_distinct(list(n_nationkey) FILTER (n_nationkey % 2 = 0)) AS a, list_distinct(list(n_nationkey) FILTER (n_nationkey % 3 = 0)) AS b FROM nation GROUP BY 1)
""")
def set_operations(spark, d):
    k = F.col("n_nationkey")
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_set(F.when(k % 2 == 0, k)).alias("a"), F.collect_set(F.when(k % 3 == 0, k)).alias("b"))
    return g.select("n_regionkey", F.array_sort(F.array_union("a", "b")).alias("either"), F.array_sort(F.array_intersect("a", "b")).alias("both"), F.array_sort(F.array_except("a", "b")).alias("only_a"))


@query("file_name_match", "J19 P04 T16 T17", """
SELECT n, arg_min(p_name, (length(p_name), p_name)) AS shortest, arg_max(p_name, (p_retailprice, p_partkey)) AS largest FROM part, (SELECT unnest(['blue', 'red', 'nothing']) AS n) WHERE contains(lower(p_name), n) GROUP BY n
""")
def file_name_match(spark, d):
    names = F.broadcast(spark.createDataFrame([("blue",), ("red",), ("nothing",)], "n string"))
    hit = table(spark, d, "part").join(names, F.lower("p_name").contains(F.col("n")))
    return hit.groupBy("n").agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("shortest"), F.max_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("largest"))
