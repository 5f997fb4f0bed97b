"""State folds, chats, paging, sorting modes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieve, state
from ..shared import shared_dir
from ..sources import sinks
from .registry import Inline, query, table


@query("toggle_state", "M01 Q22 D16", """
WITH l AS (SELECT user_id, event_id, event_type = 'click' AS is_on FROM events WHERE event_type IN ('click', 'purchase')),
o AS (SELECT user_id, max(event_id) FILTER (NOT is_on) AS gone FROM l GROUP BY 1)
SELECT l.user_id, min(event_id) AS since FROM l JOIN o USING (user_id) WHERE is_on AND (gone IS NULL OR event_id > gone) GROUP BY l.user_id
""")
def toggle_state(spark, d):
    log = table(spark, d, "events").where("event_type IN ('click', 'purchase')").select("user_id", "event_id", "event_type")
    return state.toggled(log, "user_id", F.col("event_type") == "click", "event_id")


@query("patch_state", "M02 M04", """
WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_id::VARCHAR END AS v FROM events),
p AS (SELECT user_id, nullif(arg_max(v, event_id) FILTER (event_type = 'view'), '') AS "view", nullif(arg_max(v, event_id) FILTER (event_type = 'signup'), '') AS signup FROM l GROUP BY 1)
SELECT * FROM p WHERE "view" IS NOT NULL OR signup IS NOT NULL
""")
def patch_state(spark, d):
    log = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_id").cast("string")))
    return state.patched(log, "user_id", "event_type", "v", "event_id", ["view", "signup"])


@query("upsert_keep_created", "M03 K06 P19", """
WITH l AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'open' END AS status, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_id::VARCHAR END AS notes, event_type = 'error' AS gone FROM events),
g AS (SELECT user_id, max(event_id) FILTER (gone) AS last_gone FROM l GROUP BY 1)
SELECT user_id, arg_min(stamp, event_id) AS created, arg_max(stamp, event_id) AS updated, arg_max(status, event_id) AS status, coalesce(arg_max(notes, event_id) FILTER (trim(notes) <> ''), '') AS notes
FROM l JOIN g USING (user_id) WHERE last_gone IS NULL OR event_id > last_gone GROUP BY user_id
""")
def upsert_keep_created(spark, d):
    status = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("open")
    log = table(spark, d, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_id").cast("string")).alias("notes"))
    return state.upserted(log, "user_id", "status", "notes", "stamp", "event_id", F.col("event_type") == "error")


@query("chat_tail", "T12", """
SELECT conv_id, turn, n > 3 AS has_older FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3
""")
def chat_tail(spark, d):
    return state.page_before(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", None, 3)


@query("chat_page", "T12", """
SELECT conv_id, turn, n > 2 AS has_older FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE turn < 4) WHERE k <= 2
""")
def chat_page(spark, d):
    return state.page_before(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 4, 2)


@query("chat_last_turns", "T13 T14", """
SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6 GROUP BY conv_id
""")
def chat_last_turns(spark, d):
    last = retrieve.first_n(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 6)
    line = F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 200)).alias("line"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("context"))


@query("sort_modes", "T06 T07 P18", """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(nullif(p_size, 1), 999), p_name, p_partkey) AS by_chapter, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_type, p_size, p_partkey) AS by_weight,
  p_size IS NULL OR p_size = 7 AS in_default FROM part
""")
def sort_modes(spark, d):
    by = lambda *o: F.row_number().over(Window.partitionBy("p_brand").orderBy(*o)).cast("long")
    chapter = F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(999))
    return table(spark, d, "part").select("p_partkey", by(chapter, "p_name", "p_partkey").alias("by_chapter"), by(F.desc("p_retailprice"), "p_type", "p_size", "p_partkey").alias("by_weight"), (F.col("p_size").isNull() | (F.col("p_size") == 7)).alias("in_default"))


@query("groups_by_size", "T08 A11", "SELECT p_brand, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, first_key)::BIGINT AS place FROM (SELECT p_brand, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1)")
def groups_by_size(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))
    return g.select("p_brand", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first_key")).cast("long").alias("place"))  # a row per brand


MEMO = Inline("src string, val string", [("src1", "cached one"), ("src5", "cached five")])


@query("memo_lookup", "M08 M09 D26 O14", f"""
SELECT doc_id, substr(sha256(source || chr(31) || lang), 1, 24) AS k, coalesce(val, 'computed ' || lang) AS val, val IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT src, val FROM {MEMO.sql()}) ON src = source AND lang = 'en'
""")
def memo_lookup(spark, d):
    memo = MEMO.df(spark).select(F.col("src").alias("source"), F.lit("en").alias("lang"), "val").withColumn("k", state.memo_key("source", "lang")).select("k", "val")
    requests = table(spark, d, "documents").select("doc_id", "lang", state.memo_key("source", "lang").alias("k"))
    return state.memoized(requests, F.broadcast(memo), "k", F.concat(F.lit("computed "), "lang"), "val").select("doc_id", "k", "val", "hit")


@query("seeded_sample", "T11", "SELECT p_partkey, p_name FROM part ORDER BY md5('7|' || p_partkey), p_partkey LIMIT 25")
def seeded_sample(spark, d):
    """A sample of fixed size by a seeded hash: the same rows on any cluster."""
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy(F.md5(F.concat(F.lit("7|"), F.col("p_partkey").cast("string"))), "p_partkey").limit(25)


@query("partition_rebuild", "K04 O11", """
SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS version FROM documents WHERE lang IS NOT NULL AND (lang <> 'en' OR length(text) > 500)
""")
def partition_rebuild(spark, d):
    """Stored rows in partitions; one is dropped and built anew, the others are not touched."""
    path = shared_dir(spark)
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    docs.select("doc_id", F.lit("old").alias("version"), "lang").write.partitionBy("lang").parquet(path)
    sinks.overwrite_partition(docs.where("lang = 'en' AND length(text) > 500").select("doc_id", F.lit("new").alias("version"), "lang"), path, "lang")
    return spark.read.schema("doc_id long, version string, lang string").parquet(path).select("doc_id", "lang", "version")


@query("json_rows", "K11", "SELECT to_json({'key': n_nationkey, 'name': n_name, 'region': n_regionkey})::VARCHAR AS body FROM nation")
def json_rows(spark, d):
    """A table as JSON rows, for a service that answers with them."""
    return table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("body"))


@query("append_log", "Z05 D23", "SELECT user_id, ts::DATE AS day, string_agg(event_type, '>' ORDER BY ts, event_id) AS trail FROM events GROUP BY ALL")
def append_log(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.transform(steps, lambda x: x["event_type"]), ">").alias("trail"))
