"""Sources and sinks that need no connector: JSON, HTML tables, captions, mail, calendars, reports, tools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import registration, rules, text
from ..sources import sinks
from . import q_lexicon, tools  # noqa: F401
from .registry import REGISTRY, Inline, query, table

OCR = Inline("source string, ocr string", [("src0", "scanned text of zero"), ("src3", "scanned text of three")])


@query("coalesced_text", "S03 Z01 Z18 J23", f"SELECT doc_id, length(coalesce(ocr, text))::INT AS chars, ocr IS NOT NULL AS from_ocr FROM documents d LEFT JOIN {OCR.sql()} o USING (source)")
def coalesced_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text").join(F.broadcast(OCR.df(spark)), "source", "left")
    return docs.select("doc_id", F.length(F.coalesce("ocr", "text")).alias("chars"), F.col("ocr").isNotNull().alias("from_ocr"))


MANIFEST = Inline("source string, category string", [("src0", "exam"), ("src1", "practice"), ("src2", "slides")])


@query("manifest_lookup", "S08 D2 Z14", f"SELECT coalesce(category, 'other') AS category, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN {MANIFEST.sql()} USING (source) GROUP BY 1")
def manifest_lookup(spark, d):
    out = table(spark, d, "documents").join(F.broadcast(MANIFEST.df(spark)), "source", "left")
    return out.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("json_scan", "S07 S22 D16 Z12", """
SELECT event_id, json_valid(props) AS valid, coalesce(json_extract_string(props, '$.device'), json_extract_string(props, '$.source'), 'none') AS device FROM events
""")
def json_scan(spark, d):
    ev = table(spark, d, "events")
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return ev.select("event_id", F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"), F.coalesce(get("device"), get("source"), F.lit("none")).alias("device"))


HTML = Inline("doc string, html string", [("a", '<tr data-id="7"><td>Exam</td><td>8.5 / 10</td></tr><tr data-id="8"><td>Quiz</td><td>- / 5</td></tr><tr data-id="7"><td>Again</td><td>1 / 2</td></tr>'), ("b", "none")])


@query("html_table_rows", "S18 A16", r"""
WITH r AS (SELECT doc, generate_subscripts(rows, 1) AS pos, unnest(rows) AS row_html FROM (SELECT doc, regexp_extract_all(html, '(?s)<tr data-id="\d+">.*?</tr>') AS rows FROM """ + HTML.sql() + r""")),
f AS (SELECT doc, pos, regexp_extract(row_html, 'data-id="(\d+)"', 1)::BIGINT AS id, regexp_extract(row_html, '<td>([^<]*)</td>', 1) AS name, try_cast(regexp_extract(row_html, '<td>([^<]*) / ', 1) AS DOUBLE) AS score, try_cast(regexp_extract(row_html, ' / ([^<]*)</td>', 1) AS DOUBLE) AS max_score FROM r)
SELECT doc, id, name, score, max_score FROM (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY pos) AS k FROM f) WHERE k = 1
""")
def html_table_rows(spark, d):
    rows = HTML.df(spark).select("doc", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<tr data-id="\d+">.*?</tr>'), F.lit(0))).alias("pos", "r"))
    get = lambda rx: F.regexp_extract("r", rx, 1)
    f = rows.select("doc", "pos", get(r'data-id="(\d+)"').cast("long").alias("id"), get("<td>([^<]*)</td>").alias("name"), get("<td>([^<]*) / ").try_cast("double").alias("score"), get(" / ([^<]*)</td>").try_cast("double").alias("max_score"))
    w = Window.partitionBy("doc", "id").orderBy("pos")
    return f.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "pos")


PROPS = Inline("doc string, html string", [("a", '<div data-react-class="View" data-react-props="{&quot;id&quot;: 5, &quot;name&quot;: &quot;A &amp; B&quot;}"></div>'), ("b", "<div></div>")])


@query("embedded_json", "S17 Z08", r"""
SELECT doc, json_extract(j, '$.id')::INT AS id, json_extract_string(j, '$.name') AS name FROM (SELECT doc, replace(replace(nullif(regexp_extract(html, 'data-react-props="([^"]*)"', 1), ''), '&quot;', '"'), '&amp;', '&') AS j FROM """ + PROPS.sql() + ")")
def embedded_json(spark, d):
    raw = F.nullif(F.regexp_extract("html", 'data-react-props="([^"]*)"', 1), F.lit(""))
    plain = F.replace(F.replace(raw, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    j = F.from_json(plain, "id int, name string")
    return PROPS.df(spark).select("doc", j["id"].alias("id"), j["name"].alias("name"))


CAPTIONS = Inline("doc string, body string", [("a", "1\n00:00:01,000 --> 00:00:02,000\nHello there\n\n2\n00:00:03,000 --> 00:00:04,000\nsecond line\n"), ("b", "WEBVTT\n\n00:01.000 --> 00:02.000\nonly\n")])


@query("caption_text", "S19", r"""
SELECT doc, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> 'WEBVTT' AND NOT regexp_matches(x, '^\d+$') AND NOT contains(x, '-->')), ' ') AS spoken FROM """ + CAPTIONS.sql())
def caption_text(spark, d):
    lines = F.transform(F.split("body", "\n"), lambda x: F.trim(x))
    spoken = F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.rlike(r"^\d+$") & ~x.contains("-->"))
    return CAPTIONS.df(spark).select("doc", F.array_join(spoken, " ").alias("spoken"))


MAILS = Inline("query_ord int, pos int, id string, subject string", [(1, 1, "m1", "A"), (1, 2, "m2", "B"), (2, 1, "m2", "B"), (2, 2, "m3", "C"), (3, 1, "m1", "A")])


@query("mailbox_union", "S11 D20", f"SELECT id, subject FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_ord, pos) AS k FROM {MAILS.sql()}) WHERE k = 1 ORDER BY query_ord, pos LIMIT 2")
def mailbox_union(spark, d):
    m = MAILS.df(spark).groupBy("id").agg(F.min(F.struct("query_ord", "pos", "subject")).alias("f"))
    return m.orderBy("f.query_ord", "f.pos").limit(2).select("id", "f.subject")


PARTS = Inline("msg string, path array<int>, mime string, data string", [("a", [1], "text/html", "PHA-aHRtbDwvcD4="), ("a", [0, 1], "text/plain", "cGxhaW4gdHdv"), ("a", [0, 0], "text/plain", "cGxhaW4gb25l"), ("b", [0], "text/html", "PHA-b25seSBodG1sPC9wPg=="), ("c", [0], "image/png", "AAAA")])


@query("mail_body", "S14", r"""
WITH p AS (SELECT msg, path, mime, decode(from_base64(translate(data, '-_', '+/'))) AS body FROM """ + PARTS.sql() + r""" WHERE starts_with(mime, 'text/')), m AS (SELECT DISTINCT msg FROM """ + PARTS.sql() + r""")
SELECT msg, coalesce((SELECT string_agg(body, chr(10) ORDER BY path) FROM p WHERE p.msg = m.msg AND mime = 'text/plain'), (SELECT string_agg(trim(regexp_replace(body, '<[^>]+>', ' ', 'g')), chr(10) ORDER BY path) FROM p WHERE p.msg = m.msg AND mime = 'text/html'), '') AS body FROM m
""")
def mail_body(spark, d):
    p = PARTS.df(spark)
    body = text.base64url("data").cast("string")
    part = lambda mime, b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mime") == mime, F.struct("path", b.alias("b"))))), lambda x: x["b"]), "\n")
    plain, html = part("text/plain", body), part("text/html", F.trim(F.regexp_replace(body, "<[^>]+>", " ")))
    return p.groupBy("msg").agg(F.coalesce(F.nullif(plain, F.lit("")), html).alias("body"))


HEADERS = Inline("msg string, name string, val string, ord int", [("a", "Subject", "Hi", 1), ("a", "SUBJECT", "later", 2), ("b", "From", "x@y", 1)])


@query("mail_header", "S13", f"SELECT msg, coalesce(arg_min(val, ord) FILTER (lower(name) = 'subject'), '') AS subject FROM {HEADERS.sql()} GROUP BY msg")
def mail_header(spark, d):
    h = HEADERS.df(spark).groupBy("msg").agg(F.collect_list(F.struct("ord", "name", "val")).alias("headers"))
    hit = F.filter(F.array_sort("headers"), lambda x: F.lower(x["name"]) == "subject")
    return h.select("msg", F.coalesce(F.get(hit, F.lit(0))["val"], F.lit("")).alias("subject"))


TSV = Inline("line string", [("id1\tdocument",), ("# comment",), ("id2",), ("",)])


@query("tsv_ids", "S23 S22 Z09 Z10", f"SELECT string_split(line, chr(9))[1] AS id, coalesce(string_split(line, chr(9))[2], 'file') AS kind FROM {TSV.sql()} WHERE line <> '' AND NOT starts_with(line, '#')")
def tsv_ids(spark, d):
    parts = F.split("line", "\t")
    return TSV.df(spark).where("line <> '' AND line NOT LIKE '#%'").select(parts[0].alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("file")).alias("kind"))


DATES = Inline("raw string", [("2024-02-29",), ("2/30/2024",), ("3/4/24",), ("Mar 5, 2024",), ("/Date(1700000000000)/",), ("nonsense",), ("",)])


@query("parsed_dates", "2.12 X11 S25", rf"""
SELECT raw, coalesce(try_strptime(raw, '%Y-%m-%d')::DATE, CASE WHEN regexp_matches(raw, '^\d+/\d+/\d{{4}}$') THEN try_strptime(raw, '%m/%d/%Y')::DATE END, CASE WHEN regexp_matches(raw, '^\d+/\d+/\d\d$') THEN try_strptime(raw, '%m/%d/%y')::DATE END, try_strptime(raw, '%b %d, %Y')::DATE, make_timestamp(try_cast(nullif(regexp_extract(raw, 'Date\((\d+)\)', 1), '') AS BIGINT) * 1000)::DATE) AS day FROM {DATES.sql()}
""")
def parsed_dates(spark, d):
    t = lambda fmt: F.try_to_timestamp("raw", F.lit(fmt)).cast("date")
    two = F.when(F.col("raw").rlike(r"^\d+/\d+/\d\d$"), F.try_to_timestamp("raw", F.lit("M/d/yy")).cast("date"))
    four = F.when(F.col("raw").rlike(r"^\d+/\d+/\d{4}$"), t("M/d/yyyy"))
    millis = F.nullif(F.regexp_extract("raw", r"Date\((\d+)\)", 1), F.lit("")).cast("long")
    return DATES.df(spark).select("raw", F.coalesce(t("yyyy-MM-dd"), four, two, t("MMM d, yyyy"), F.to_date(F.timestamp_millis(millis))).alias("day"))


INFO = Inline("doc string, line_no int, line string", [("a", 1, "# Course"), ("a", 2, "- 3/1/2024: outside"), ("a", 3, "## Dates"), ("a", 4, "- 2024-02-10: Midterm"), ("a", 5, "- 2024-13-10: Never"), ("a", 6, "## Grading"), ("a", 7, "- 2024-03-01: not a date line"), ("b", 1, "- 2024-01-01: no section"), ("b", 2, "## Dates"), ("b", 3, "- 2024-05-01: Final")])


@query("section_events", "X11 X12 D22", f"""
SELECT doc, day, title FROM (SELECT doc, try_strptime(regexp_extract(line, '^- ([^:]+): ', 1), '%Y-%m-%d')::DATE AS day, regexp_extract(line, ': (.*)$', 1) AS title, last_value(CASE WHEN starts_with(line, '#') THEN line END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no) AS section FROM {INFO.sql()}) WHERE section = '## Dates' AND day IS NOT NULL
""")
def section_events(spark, d):
    head = F.last(F.when(F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("line_no"))
    rows = INFO.df(spark).withColumn("section", head).where("section = '## Dates'")
    day = F.try_to_timestamp(F.regexp_extract("line", "^- ([^:]+): ", 1), F.lit("yyyy-MM-dd")).cast("date")
    return rows.select("doc", day.alias("day"), F.regexp_extract("line", ": (.*)$", 1).alias("title")).where("day IS NOT NULL")


EVENTS = Inline("uid string, day date, time string, title string", [("u1", "2024-02-10", "23:30:00", "Late, exam"), ("u2", "2024-02-11", None, "Holiday")])
@query("calendar_text", "K07 Q15", r"""
SELECT 'BEGIN:VCALENDAR' || chr(10) || 'VERSION:2.0' || chr(10) || string_agg('BEGIN:VEVENT' || chr(10) || 'UID:' || uid || chr(10) || CASE WHEN time IS NULL THEN 'DTSTART;VALUE=DATE:' || strftime(day, '%Y%m%d')
 ELSE 'DTSTART:' || strftime((day || ' ' || time)::TIMESTAMP, '%Y%m%dT%H%M%S') || chr(10) || 'DTEND:' || strftime((day || ' ' || time)::TIMESTAMP + INTERVAL 1 HOUR, '%Y%m%dT%H%M%S') END || chr(10) || 'SUMMARY:' || regexp_replace(title, '([,;])', '\\\1', 'g') || chr(10) || 'END:VEVENT', chr(10) ORDER BY day, uid) || chr(10) || 'END:VCALENDAR' AS ics
FROM """ + EVENTS.sql())
def calendar_text(spark, d):
    return sinks.ics(EVENTS.df(spark))


@query("citation_label", "P17 P03", """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'System note' WHEN role = 'user' THEN 'User, turn ' || turn ELSE 'Reply ' || conv_id || '.' || turn END AS label, contains(lower(text), 'the') OR contains(lower(text), 'und') AS any_word FROM conversations
""")
def citation_label(spark, d):
    c = table(spark, d, "conversations")
    label = rules.first_rule([(F.col("role") == "system", "System note"), (F.col("role") == "user", F.concat(F.lit("User, turn "), F.col("turn").cast("string")))], F.concat(F.lit("Reply "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", label.alias("label"), rules.any_of(F.lower("text"), ["the", "und"]).alias("any_word"))


@query("crop_geometry", "Z11", "SELECT p_partkey, p_size * 10 AS width, floor(p_retailprice)::BIGINT AS height, p_size BETWEEN 5 AND 40 AS valid FROM part")
def crop_geometry(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("width"), F.floor("p_retailprice").alias("height"), F.col("p_size").between(5, 40).alias("valid"))


@query("tool_call", "F01 F02", f"""
SELECT * FROM ({REGISTRY['topic_gap'].sql}) WHERE share_gap_pp > 0 ORDER BY share_gap_pp DESC, topic_ord LIMIT 3
""")
def tool_call(spark, d):
    """Arguments as texts are read by their types, unknown ones dropped."""
    return tools.call_tool(spark, d, "topics_by_under_preparation", {"n": "3", "unknown": 1})


@query("tool_errors", "F01", "SELECT * FROM (VALUES ('bad arguments for topic_summary: missing topic'), ('unknown tool nothing')) AS t(error)")
def tool_errors(spark, d):
    return tools.call_tool(spark, d, "topic_summary", {"n": 3}).union(tools.call_tool(spark, d, "nothing", None))


@query("tool_schemas", "F01")
def tool_schemas(spark, d):
    """The tools' typed parameters, by a table function."""
    tools.register(spark)
    return spark.sql("SELECT * FROM tool_schemas()")


@query("registered_functions", "F04")
def registered_functions(spark, d):
    """The engine's functions from SQL."""
    registration.register(spark)
    return spark.sql("""
        SELECT page_id, resolve_url(url, '../x#y') AS link, likeness(url, 'example') AS ratio, html_unescape('a &lt; b') AS plain, length(visible_text(html)) AS chars, size(record_spans('1. only')) AS records FROM {pages}
    """, pages=table(spark, d, "pages"))
