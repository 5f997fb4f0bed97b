"""Telemetry, logs, alerts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import telemetry
from .registry import Inline, query, table


@query("step_counters", "A21 R02", "SELECT event_type, ts::DATE AS day, count(*)::BIGINT AS n, count(*) FILTER (value > 50)::BIGINT AS done, count(*) FILTER (value <= 50)::BIGINT AS failed FROM events GROUP BY ALL")
def step_counters(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(v > 50).alias("done"), F.count_if(v <= 50).alias("failed"))


@query("moving_avg20", "W03 A27", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg20 FROM events")
def moving_avg20(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("avg20"))


SEVERITY = [("(?i)error", "critical"), ("(?i)purchase|signup", "recoverable"), ("(?i)view", "ignore")]


@query("severity_case", "P11", f"SELECT user_id, coalesce({rules.sql_case(SEVERITY, 'event_type')}, 'unknown') AS severity, count(*)::BIGINT AS n, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY ALL")
def severity_case(spark, d):
    s = rules.regex_case(SEVERITY, F.col("event_type"), default="unknown")
    return table(spark, d, "events").groupBy("user_id", s.alias("severity")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"))


SHARDS = Inline("doc string, page_no int, total int, text string", [("a", 2, 2, "two"), ("a", 1, 2, "one"), ("b", 1, 3, "one"), ("b", 3, 3, "three"), ("c", 1, 1, "only"), ("c", 1, 1, "only")])


@query("completeness_stitch", "A20 Q17 D25", f"""
SELECT doc, count(*)::BIGINT AS pages, string_agg(text, chr(10) ORDER BY page_no) AS text FROM (SELECT doc, page_no, max(total) AS total, min(text) AS text FROM {SHARDS.sql()} GROUP BY ALL) GROUP BY doc HAVING count(*) = max(total)
""")
def completeness_stitch(spark, d):
    return telemetry.stitched(SHARDS.df(spark), "doc", "page_no", "total", "text")


@query("conversation_completeness", "A20 P16", "SELECT conv_id, count(DISTINCT turn)::BIGINT AS turns, max(turn) AS last_turn, count(DISTINCT turn) = max(turn) + 1 AS complete FROM conversations GROUP BY 1")
def conversation_completeness(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    g = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"))
    return g.withColumn("complete", F.col("turns") == F.col("last_turn") + 1)


@query("round_robin", "W09", "SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3)::INT AS region FROM events")
def round_robin(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.pmod(F.row_number().over(w) - 1, F.lit(3)).cast("int").alias("region"))


JOBS = Inline("job string, remaining double, rpm double, avg_s double, workers int", [("a", 120.0, 60.0, 4.0, 8), ("b", 120.0, None, 4.0, 0), ("c", 10.0, 5.0, None, 2), ("d", 10.0, None, None, 1)])


@query("eta", "C10 C11", f"SELECT job, round(greatest(CASE WHEN rpm > 0 THEN remaining / rpm END, remaining * avg_s / 60 / greatest(workers, 1)), 6) AS minutes, round(remaining * 0.007, 6)::DOUBLE AS cost FROM {JOBS.sql()}")
def eta(spark, d):
    return JOBS.df(spark).select("job", F.round(telemetry.eta_minutes(F.col("remaining"), F.col("rpm"), F.col("avg_s"), F.col("workers")), 6).alias("minutes"), F.round(F.col("remaining") * 0.007, 6).alias("cost"))


@query("budget_alert", "R01 S26", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 90")
def budget_alert(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase' AND value >= 90").select("event_id", "user_id", "value")


LOG = "pages: 12/40 ok\n[3/10] analyse\nFAILED x\npage 7 done in 2.5s\npage 8 done in 3.5s\nFAILED y\n"
LOGS = Inline("job string, log string", [("a", LOG), ("b", "nothing here\n"), ("c", "")])


@query("log_scan", "S24 A22 Q16 D24", r"""
SELECT job, try_cast(nullif(regexp_extract(log, 'pages: (\d+)/', 1), '') AS INT) AS done, try_cast(nullif(regexp_extract(log, '\[(\d+)/10\]', 1), '') AS INT) AS stage, len(regexp_extract_all(log, '(?m)^FAILED'))::INT AS failures,
  array_to_string(list_slice(list_filter(string_split(log, chr(10)), lambda x: x <> ''), -2, -1), '|') AS tail FROM """ + LOGS.sql())
def log_scan(spark, d):
    num = lambda rx: F.nullif(F.regexp_extract("log", rx, 1), F.lit("")).cast("int")
    lines = F.filter(F.split("log", "\n"), lambda x: x != "")
    tail = F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), F.lit(2))
    return LOGS.df(spark).select("job", num(r"pages: (\d+)/").alias("done"), num(r"\[(\d+)/10\]").alias("stage"), F.regexp_count("log", F.lit("(?m)^FAILED")).alias("failures"), F.array_join(tail, "|").alias("tail"))


@query("rank_thirds", "W08", """
SELECT p_partkey, CASE WHEN k <= n / 3.0 THEN 'top' WHEN k > 2 * n / 3.0 THEN 'bottom' ELSE 'middle' END AS third FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
""")
def rank_thirds(spark, d):
    w = Window.partitionBy("p_brand")
    k, n = F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey")), F.count("*").over(w)
    return table(spark, d, "part").select("p_partkey", F.when(k <= n / 3.0, "top").when(k > 2 * n / 3.0, "bottom").otherwise("middle").alias("third"))


NAMES = Inline("owner string, ord int, name string", [("m1", 1, "a.pdf"), ("m2", 2, "a.pdf"), ("m3", 3, "b.pdf"), ("m1", 4, "b.pdf"), ("m1", 5, "a.pdf")])


@query("collision_suffix", "W10", f"""
WITH f AS (SELECT owner, name, min(ord) AS first_ord FROM {NAMES.sql()} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first_ord) AS k FROM f)
SELECT owner, name, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '\\.pdf$', '') || '-' || k || '.pdf' END AS saved FROM r
""")
def collision_suffix(spark, d):
    f = NAMES.df(spark).groupBy("owner", "name").agg(F.min("ord").alias("first_ord"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("first_ord"))
    return f.withColumn("k", k).select("owner", "name", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.pdf$", ""), F.lit("-"), F.col("k").cast("string"), F.lit(".pdf"))).alias("saved"))


ARRIVALS = Inline("region string, n int, arrival double", [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 20.0), ("a", 4, 50.0), ("a", 5, 50.0), ("a", 6, 51.5), ("b", 1, 3.0)])


@query("rate_limit_schedule", "R05", f"""
WITH RECURSIVE s AS (SELECT region, n, arrival, arrival AS start FROM {ARRIVALS.sql()} WHERE n = 1 UNION ALL SELECT a.region, a.n, a.arrival, greatest(a.arrival, s.start + 12) FROM s JOIN {ARRIVALS.sql()} a ON a.region = s.region AND a.n = s.n + 1) SELECT region, arrival, start FROM s
""")
def rate_limit_schedule(spark, d):
    """When requests start if two of a region are at least twelve seconds apart, in one pass over each region."""
    return telemetry.scheduled(ARRIVALS.df(spark), "region", "arrival", ["n"], 12.0).select("region", "arrival", "start")


COURSES = Inline("id int, name string, code string", [(1, "Intro to Statistics", "ACMS 101"), (2, "Computer Architecture", "CSE 321"), (3, "Programming Paradigms", "CSE 332"), (4, None, "COMP ARCH LAB"), (5, "zzz", None)])
WANTED = Inline("q string", [("comp arch",), (" CSE 332 ",), ("statistcs",), ("@@@@",), ("",)])


@query("fuzzy_pick", "T15")
def fuzzy_pick(spark, d):
    """The best course for each query by sequence similarity of its name or code, 1.0 if either holds the query; at least 0.3."""

    def ratios(queries: pa.Array, names: pa.Array, codes: pa.Array) -> pa.Array:
        return pa.array([telemetry.likeness(q, n, c) for q, n, c in zip(queries.to_pylist(), names.to_pylist(), codes.to_pylist(), strict=True)], pa.float64())

    pairs = WANTED.df(spark).join(F.broadcast(COURSES.df(spark)))  # a handful of courses against each query
    scored = pairs.withColumn("ratio", F.arrow_udf(ratios, "double")("q", "name", "code")).where("ratio >= 0.3")
    best = scored.groupBy("q").agg(F.max_by(F.struct("id", "name", "ratio"), F.struct("ratio", -F.col("id"))).alias("b"))
    return best.select("q", "b.*")
