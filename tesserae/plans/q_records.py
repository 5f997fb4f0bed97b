"""Record parsing, lookups by interval and place, keep-best, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rulesets
from ..operators import dedup, records
from .registry import Inline, query, table

LONG = "explain in a few words why the result holds for all inputs of this kind and give an example"
EXAM = f"Exam\n1. First {LONG}\n2) Second {LONG} (5 points)\nConsider the graph below for questions 3-4\nwith weights.\n3: Third {LONG}\n4. {LONG}\n5. short\n#6. Sixth {LONG}"
TEXTS = Inline("doc string, text string", [
    ("a", EXAM), ("b", f"Problem 1. First {LONG}\nQuestion 2: second {LONG}\n"), ("c", f"no heads at all, {LONG}"), ("d", "short"), ("e", None), ("f", ""), ("g", f"1. only {LONG}"), ("h", f"1. first {LONG}\nUse the table for problems 9 to 7\nRefer to it for questions 1 through 14\nAssume X for question 2-2"),
    ("i", "1. " + "w" * 5990), ("j", "1. " + "w" * 6000),
])
NUMBERED = Inline("doc string, text string", [("a", "1. first [3 pts]\n2. second\n7. stray\n3. third [ 2.5 points ]\n1. other\n2. more"), ("b", "8\\. x\n1\\. y\n2\\. z [1 pt.]"), ("c", "1. a single question [4 pts]"), ("d", "2. no\n3. start"), ("e", "1) a\n1) b\n2) c"), ("f", None), ("g", "1. a\n2. b\n1. c\n2. d")])
#: The marks of a text as rows (off: the place of the match, counted from 0), found line by line; for checks.
SQL_LINES = r"""SELECT doc, text, k, line, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY k) - length(line) - 1 AS off
  FROM (SELECT doc, text, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM {rows})"""
SQL_SHARED = r"(?i)(?:assume|use|consider|refer\s+to)\b[^.\n]{0,80}?\b(?:question|problem)s?\s+(\d{1,2})\s*(?:-|–|—|to|through|thru)\s*(\d{1,2})"
SQL_HEAD = r"(?i)^\s*(?:problem|question|q|exercise|ex|#)?\s*(\d{1,2})[.\):]\s+"


@query("split_records", "X02 D12", rf"""
WITH l AS ({SQL_LINES.format(rows=TEXTS.sql())}),
h AS (SELECT doc, text, off, try_cast(regexp_extract(line, '{SQL_HEAD}', 1) AS INT) AS num FROM l WHERE regexp_matches(line || ' ', '{SQL_HEAD}')),
s AS (SELECT doc, off + strpos(line, regexp_extract(line, '{SQL_SHARED}', 0)) - 1 AS off FROM l WHERE regexp_matches(line, '{SQL_SHARED}')),
c AS (SELECT doc, off FROM h UNION SELECT doc, off FROM s),
b AS (SELECT doc, num, off, trim(substr(text, off::BIGINT + 1, (coalesce((SELECT min(c.off) FROM c WHERE c.doc = h.doc AND c.off > h.off), length(text)) - off)::BIGINT), ' ' || chr(10)) AS body FROM h)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY off) - 1)::INT AS place, num, body, off::INT AS start FROM b WHERE length(body) > 30 AND length(body) < 6000
UNION ALL SELECT doc, 0, 1, text, 0 FROM {TEXTS.sql()} t WHERE text IS NOT NULL AND text <> '' AND doc NOT IN (SELECT doc FROM h)
""")
def split_records(spark, d):
    return records.split_rows(TEXTS.df(spark), records.record_spans, records.RECORD)


@query("split_preambles", "X04", rf"""
WITH l AS ({SQL_LINES.format(rows=TEXTS.sql())}),
m AS (SELECT doc, text, off + strpos(line, regexp_extract(line, '{SQL_SHARED}', 0)) - 1 AS start, length(regexp_extract(line, '{SQL_SHARED}', 0)) AS n, try_cast(regexp_extract(line, '{SQL_SHARED}', 1) AS INT) AS lo, try_cast(regexp_extract(line, '{SQL_SHARED}', 2) AS INT) AS hi FROM l WHERE regexp_matches(line, '{SQL_SHARED}')),
h AS (SELECT doc, off - 1 AS off, try_cast(regexp_extract(line, '^\s*(\d{{1,2}})[.\):]\s+', 1) AS INT) AS num FROM l WHERE k > 1 AND regexp_matches(line, '^\s*\d{{1,2}}[.\):]\s+'))
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY start) - 1)::INT AS place, lo, hi, trim(substr(text, start::BIGINT + 1, (coalesce((SELECT min(off) FROM h WHERE h.doc = m.doc AND off >= start + n), least(length(text), start + n + 600)) - start)::BIGINT), ' ' || chr(10)) AS txt,
  start::INT AS start, coalesce((SELECT min(off) FROM h WHERE h.doc = m.doc AND off >= start + n AND num = hi + 1), least(length(text), start + 8000))::INT AS "end" FROM m WHERE hi >= lo AND hi - lo <= 12
""")
def split_preambles(spark, d):
    return records.split_rows(TEXTS.df(spark), records.preamble_spans, records.PREAMBLE)


@query("titled_records", "X08 Q12")
def titled_records(spark, d):
    return records.split_rows(TEXTS.df(spark), records.titled_spans, records.TITLED_RECORD)


SQL_RUNS = rf"""
WITH RECURSIVE l AS ({SQL_LINES.format(rows=NUMBERED.sql())}),
m AS (SELECT doc, text, off, try_cast(regexp_extract(line, '^[ \t]{{0,3}}(\d{{1,2}})[ \t]*\\?[.)][ \t]+', 1) AS INT) AS num, length(regexp_extract(line, '^[ \t]{{0,3}}\d{{1,2}}[ \t]*\\?[.)][ \t]+')) AS head FROM l WHERE regexp_matches(line, '^[ \t]{{0,3}}\d{{1,2}}[ \t]*\\?[.)][ \t]+\S')),
r AS (SELECT doc, text, off AS first, off, num, head FROM m WHERE num = 1
  UNION ALL SELECT r.doc, r.text, r.first, n.off, n.num, n.head FROM r JOIN m n ON n.doc = r.doc AND n.num = r.num + 1 AND n.off = (SELECT min(o.off) FROM m o WHERE o.doc = r.doc AND o.num = r.num + 1 AND o.off > r.off)),
best AS (SELECT doc, first FROM (SELECT doc, first, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, first) AS k, count(*) AS n FROM r GROUP BY doc, first) WHERE k = 1 AND n >= 2),
q AS (SELECT doc, num, trim(substr(text, (off + head)::BIGINT + 1, (coalesce(lead(off) OVER (PARTITION BY doc ORDER BY num), length(text)) - off - head)::BIGINT), ' ' || chr(10)) AS body FROM r JOIN best USING (doc, first))
"""
SQL_POINTS = r"try_cast(nullif(regexp_extract(body, '(?i)\[\s*([\d.]+)\s*(?:pt|pts|point|points)\.?\s*\]', 1), '') AS DOUBLE)"


@query("numbered_questions", "X09 W06", f"{SQL_RUNS} SELECT doc, (num - 1)::INT AS place, num, body, {SQL_POINTS} AS points FROM q")
def numbered_questions(spark, d):
    return records.split_rows(NUMBERED.df(spark), records.numbered_run, records.LISTED_RECORD)


@query("question_points", "A26", f"{SQL_RUNS} SELECT doc, sum(coalesce({SQL_POINTS}, 0))::DOUBLE AS points FROM q GROUP BY doc")
def question_points(spark, d):
    return numbered_questions(spark, d).groupBy("doc").agg(F.sum(F.coalesce("points", F.lit(0.0))).alias("points"))


GRADED = Inline("doc string, text string", [("a", "1.i trees 3 / 5 pts ok\n1.ii heaps 4.5 / 4.5 pts\n2.iv none here\n3.x late\nmore lines\n 0/2 pt"), ("b", "no blocks, 3 / 5 pts"), ("c", "")])


@query("graded_blocks", "X07", rf"""
WITH l AS ({SQL_LINES.format(rows=GRADED.sql())}),
h AS (SELECT doc, text, off, regexp_extract(line, '^\s*(\d+\.[ivx]+)\b', 1) AS label, length(regexp_extract(line, '^\s*\d+\.[ivx]+')) AS n FROM l WHERE regexp_matches(line, '^\s*\d+\.[ivx]+\b')),
b AS (SELECT doc, label, off, substr(text, (off + n)::BIGINT + 1, (coalesce(lead(off) OVER (PARTITION BY doc ORDER BY off), length(text)) - off - n)::BIGINT) AS body FROM h),
s AS (SELECT *, regexp_extract(body, '(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*pts?', 1) AS got, regexp_extract(body, '(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*pts?', 2) AS most FROM b)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY off) - 1)::INT AS place, label, try_cast(got AS DOUBLE) AS score, try_cast(most AS DOUBLE) AS max_score, trim(body, ' ' || chr(10)) AS body FROM s WHERE got <> ''
""")
def graded_blocks(spark, d):
    return records.split_rows(GRADED.df(spark), records.graded_blocks, "label string, score double, max_score double, body string")


@query("thin_captions", "W07")
def thin_captions(spark, d):
    import pyarrow as pa

    lines = "\n".join(f"{k // 60}:{k % 60:02d}\nline {k}" for k in range(40))
    rows = Inline("doc string, text string", [("a", lines), ("b", "")]).df(spark)
    return rows.select("doc", F.arrow_udf(lambda t: pa.array([records.thin_captions(x or "") for x in t.to_pylist()]), "string")("text").alias("text"))


@query("packed_pieces", "X14")
def packed_pieces(spark, d):
    import pyarrow as pa

    pack = F.arrow_udf(lambda t: pa.array([records.packed(x or "") for x in t.to_pylist()], pa.list_(pa.string())), "array<string>")
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(pack("text")).alias("piece", "part"))
    return pieces.select("doc_id", "piece", F.length("part").alias("chars"))


SUMMARIES = Inline("doc string, text string", [("a", "## 6 Formulas\nx = 1\ny = 2\n## 7 Other\nno\n## 8 Pitfalls\nlast"), ("b", "nothing"), ("c", "##6\n\n## 8. x\n"), ("d", "# 6 no\n### 8 no")])


@query("markdown_sections", "X10", rf"""
SELECT doc, coalesce(regexp_extract(text || chr(10) || '## ', '(?s)##\s*6[^\n]*\n(.*?)\n##\s', 1), '') AS six, coalesce(regexp_extract(text || chr(10) || '## ', '(?s)##\s*8[^\n]*\n(.*?)\n##\s', 1), '') AS eight FROM {SUMMARIES.sql()}
""")
def markdown_sections(spark, d):
    return SUMMARIES.df(spark).select("doc", records.sections(F.col("text"), "6").alias("six"), records.sections(F.col("text"), "8").alias("eight"))


HEADS = Inline("doc string, start int, length int", [("a", 0, 100), ("a", 40, 100), ("a", 70, 100), ("b", 5, 9)])


@query("record_bounds", "W02", f"SELECT doc, start, length, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start), length) AS \"end\" FROM {HEADS.sql()}")
def record_bounds(spark, d):
    return records.next_start(HEADS.df(spark), ["doc"], "start", "length")


ROWS = Inline("doc string, num int, off int", [("a", 1, 10), ("a", 3, 50), ("a", 4, 90), ("a", 2, 200), ("b", 1, 5)])
RANGES = Inline("doc string, pre_ord int, lo int, hi int, start int, end int, txt string", [("a", 1, 1, 3, 0, 100, "first"), ("a", 2, 3, 4, 40, 90, "second"), ("a", 3, 4, 9, 80, 91, "third")])


@query("preamble_range_join", "J11", f"""
SELECT r.doc, r.num, r.off, arg_min(p.txt, p.pre_ord) AS preamble FROM {ROWS.sql()} r
LEFT JOIN {RANGES.sql()} p ON r.doc = p.doc AND r.num BETWEEN p.lo AND p.hi AND r.off >= p.start AND r.off < p."end" GROUP BY ALL
""")
def preamble_range_join(spark, d):
    return records.first_interval(ROWS.df(spark), RANGES.df(spark), "doc")


BREAKS = Inline("doc string, off int, page int", [("a", 20, 2), ("a", 60, 3), ("a", 200, 9)])


@query("page_asof", "J12 Q11", f"SELECT r.doc, r.num, r.off, coalesce((SELECT arg_max(page, off) FROM {BREAKS.sql()} b WHERE b.doc = r.doc AND b.off <= r.off), 1) AS page FROM {ROWS.sql()} r")
def page_asof(spark, d):
    return records.as_of(ROWS.df(spark), BREAKS.df(spark), "doc", "off", "page", 1)


@query("events_asof", "J12", """
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, coalesce(prev, 'none') AS last_purchase FROM (
  SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
""")
def events_asof(spark, d):
    ev = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")), ignorenulls=True).over(w)
    return ev.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.coalesce(last, F.lit("none")).alias("last_purchase"))


PROBLEMS = Inline("topic string, path string, problem string, body string, answer string, row_ord int", [
    ("t", "x/a.pdf", "1", "Find the mean of A", None, 1), ("t", "y/a.pdf", "1", "find the MEAN, of a", "3", 2), ("t", "x/b_sol.pdf", "2", "other", None, 3), ("t", "x/b.pdf", "2", "other", None, 4), ("u", "x/a.pdf", "1", "Find the mean of A", None, 5),
])


@query("keep_best", "A14", f"""
SELECT topic, path, problem, row_ord FROM (SELECT *, row_number() OVER (PARTITION BY topic, regexp_replace(regexp_replace(lower(string_split(path, '/')[-1]), '\\.[^.]*$', ''), '[_ -]?sol(utions?)?$', ''), problem,
  substr(regexp_replace(lower(body), '[^a-z0-9]', '', 'g'), 1, 60) ORDER BY answer IS NULL, length(path), path, row_ord) AS k FROM {PROBLEMS.sql()}) WHERE k = 1
""")
def keep_best(spark, d):
    from ..functions.text import fingerprint, stem

    base = F.regexp_replace(F.lower(stem("path")), "[_ -]?sol(utions?)?$", "")
    best = dedup.keep_first(PROBLEMS.df(spark), ["topic", base, "problem", fingerprint("body")], [F.col("answer").isNull(), F.length("path"), "path", "row_ord"])
    return best.select("topic", "path", "problem", "row_ord")


def sql_words(words, sign):
    return " ".join(f"{sign} contains(s, '{w}')::INT" for w in words)


SQL_DIFF = rf"""greatest(0, least(10, least(2 * len(regexp_extract_all(s, '\([a-h]\)')), 4) + least(coalesce(try_cast(nullif(regexp_extract(s, '\((\d{{1,6}})\s*points?\)', 1), '') AS INT), 0) // 2, 3) + (n > 800)::INT + (n > 1500)::INT {sql_words(rulesets.HARD_WORDS, "+")} {sql_words(rulesets.EASY_WORDS, "-")}))::INT"""
SQL_LABEL = "CASE WHEN score <= 3 THEN 'easy' WHEN score <= 6 THEN 'medium' ELSE 'hard' END"
STEMS_OF = Inline("id int, stem string, n int", [(1, "(a) (b) (c) joint likelihood (9 points)", 1600), (2, "find the mean, median and mode", 10), (3, "ANOVA and regression with an interaction, p-value (1 point)", 900), (4, "", 0), (5, "(a) plain (3 points)", 801)])


@query("difficulty", "C04 Q24", f"""
SELECT doc_id, score, {SQL_LABEL} AS label FROM (SELECT doc_id, {SQL_DIFF} AS score FROM (SELECT doc_id, lower(substr(text, 1, 280)) AS s, length(text) AS n FROM documents))
UNION ALL SELECT -id, score, {SQL_LABEL} FROM (SELECT id, {SQL_DIFF} AS score FROM (SELECT id, lower(stem) AS s, n FROM {STEMS_OF.sql()}))
""")
def difficulty(spark, d):
    """By the stem, which is the first 280 characters of a body, and the body's length."""
    rows = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 280).alias("stem"), F.length("text").alias("n"))
    rows = rows.unionByName(STEMS_OF.df(spark).select((-F.col("id")).cast("long").alias("doc_id"), "stem", "n"))
    scored = rows.select("doc_id", records.difficulty(F.col("stem"), F.col("n")).alias("score"))
    return scored.withColumn("label", records.difficulty_label(F.col("score")))


@query("length_buckets", "C07 P05", """
SELECT doc_id, CASE WHEN n > 1500 THEN 'hard' WHEN n > 600 THEN 'medium' ELSE 'easy' END AS level, CASE WHEN n > 1500 THEN 9 WHEN n > 600 THEN 6 ELSE 3 END::INT AS points, 30 < n AND n < 6000 AS keeps
FROM (SELECT doc_id, length(text) AS n FROM documents)
""")
def length_buckets(spark, d):
    n = F.length("text")
    level = lambda a, b, c: F.when(n > 1500, a).when(n > 600, b).otherwise(c)
    return table(spark, d, "documents").select("doc_id", level("hard", "medium", "easy").alias("level"), level(9, 6, 3).alias("points"), ((n > 30) & (n < 6000)).alias("keeps"))


@query("source_likelihood", "C05 Q23", """
SELECT p_partkey, round(10 * CASE p_brand WHEN 'Brand#11' THEN 5 WHEN 'Brand#12' THEN 4 WHEN 'Brand#13' THEN 2 ELSE 1 END + CASE WHEN contains(lower(p_type), 'brass') THEN 30 ELSE 0 END + CASE WHEN contains(lower(p_type), 'steel') THEN 25 ELSE 0 END
  + CASE WHEN p_size >= 10 THEN 10 WHEN p_size >= 6 THEN 5 ELSE 0 END + 25 * p_retailprice / 2000, 1) AS score FROM part
""")
def source_likelihood(spark, d):
    low = F.lower("p_type")
    weight = F.when(F.col("p_brand") == "Brand#11", 5).when(F.col("p_brand") == "Brand#12", 4).when(F.col("p_brand") == "Brand#13", 2).otherwise(1)
    boost = F.when(low.contains("brass"), 30).otherwise(0) + F.when(low.contains("steel"), 25).otherwise(0)
    chapter = F.when(F.col("p_size") >= 10, 10).when(F.col("p_size") >= 6, 5).otherwise(0)
    return table(spark, d, "part").select("p_partkey", F.round(10 * weight + boost + chapter + 25 * F.col("p_retailprice") / 2000, 1).alias("score"))


ANSWERS = Inline("id int, body string", [(1, "What is the value of x in the equation? Answer: 4"), (2, "Answer: too early"), (3, "No marker here"), (4, "Some question text that is long enough. Solution: yes")])


@query("answer_split", "X05", f"""
SELECT id, CASE WHEN pos > 30 THEN trim(substr(body, 1, (pos - 1)::BIGINT)) ELSE body END AS question, CASE WHEN pos > 30 THEN trim(regexp_replace(substr(body, pos::BIGINT), '^(Answer|Solution):', '')) END AS answer
FROM (SELECT *, length(regexp_extract(body, '^(.*?)(?:Answer|Solution):', 1)) + CASE WHEN regexp_matches(body, '(Answer|Solution):') THEN 1 ELSE 0 END AS pos FROM {ANSWERS.sql()})
""")
def answer_split(spark, d):
    at = F.regexp_instr("body", F.lit("(Answer|Solution):"))
    rows = ANSWERS.df(spark).withColumn("at", at)
    tail = F.trim(F.regexp_replace(F.expr("substring(body, at)"), "^(Answer|Solution):", ""))
    return rows.select("id", F.when(F.col("at") > 30, F.trim(F.expr("substring(body, 1, at - 1)"))).otherwise(F.col("body")).alias("question"), F.when(F.col("at") > 30, tail).alias("answer"))


PATHS = Inline("path string", [("ch3/hw_ch4-5.pdf",), ("chapter_12.pdf",), ("notes.pdf",), ("Chapters 2, 3 and 7 review.pdf",)])


@query("chapters_from_path", "X18 J18", rf"""
SELECT path, try_cast(nullif(regexp_extract(lower(path), 'ch(?:apter)?[_ ]?(\d+)', 1), '') AS INT) AS chapter, list_transform(regexp_extract_all(regexp_extract(lower(path), 'chapters ([0-9, and]+)', 1), '\d+'), lambda x: x::INT) AS chapters FROM {PATHS.sql()}
""")
def chapters_from_path(spark, d):
    low = F.lower("path")
    one = F.nullif(F.regexp_extract(low, r"ch(?:apter)?[_ ]?(\d+)", 1), F.lit("")).cast("int")
    many = F.transform(F.regexp_extract_all(F.regexp_extract(low, "chapters ([0-9, and]+)", 1), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return PATHS.df(spark).select("path", one.alias("chapter"), many.alias("chapters"))


@query("pages_as_records", "X03", """
SELECT conv_id, CASE WHEN n > 1 THEN turn + 1 ELSE 1 END::BIGINT AS num, turn FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE length(text) > 30 AND length(text) < 6000
""")
def pages_as_records(spark, d):
    rows = table(spark, d, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    return rows.where((F.length("text") > 30) & (F.length("text") < 6000)).select("conv_id", F.when(F.col("n") > 1, F.col("turn") + 1).otherwise(1).cast("long").alias("num"), "turn")


STEMS = Inline("id int, stem string", [(1, "  Solve $x^2$  for   x \\n (5 points) "), (2, "plain"), (3, "a $y$ b $z$")])


@query("clean_stem", "X06", rf"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(stem, '\$([^$]*)\$', '\1', 'g'), '\(\d+ points?\)', '', 'g'), '\s+', ' ', 'g')) AS stem FROM {STEMS.sql()}
""")
def clean_stem(spark, d):
    from ..functions.text import squeeze, substitutions

    return STEMS.df(spark).select("id", squeeze(substitutions("stem", [(r"\$([^$]*)\$", "$1"), (r"\(\d+ points?\)", "")])).alias("stem"))


@query("assignment_tokens", "X17 J19", """
SELECT n_nationkey, ['hw' || n_nationkey, 'hw_' || n_nationkey, 'homework' || n_nationkey, 'assignment ' || n_nationkey] AS tokens FROM nation
""")
def assignment_tokens(spark, d):
    n = F.col("n_nationkey").cast("string")
    return table(spark, d, "nation").select("n_nationkey", F.array(*[F.concat(F.lit(p), n) for p in ("hw", "hw_", "homework", "assignment ")]).alias("tokens"))


QUESTION_TITLES = Inline("title string", [("12.",), ("MC11",), ("P2D",), ("P3",), ("mc4",), ("Essay (2)",), ("P10a_retry",), ("",)])


@query("page_matchers", "X19", r"""
SELECT title, list_concat(list_concat([regexp_replace(title, '([.()])', '\\\1', 'g')], CASE WHEN mc <> '' THEN ['\b' || mc || '\.'] ELSE [] END),
  CASE WHEN p <> '' THEN list_concat(['\bProblem\s+' || p || '\b', '(?:^|\n)\s*' || p || '\.\s*\(\d+\s*p', '(?:^|\n)\s*' || p || '\.\s+[A-Z(]'], CASE WHEN part <> '' THEN ['\(' || lower(part) || '\)'] ELSE [] END) ELSE [] END) AS matchers
FROM (SELECT title, regexp_extract(title, '(?i)^MC(\d+)', 1) AS mc, regexp_extract(title, '^P(\d+)', 1) AS p, regexp_extract(title, '^P\d+([A-Za-z]?)', 1) AS part FROM """ + QUESTION_TITLES.sql() + ")")
def page_matchers(spark, d):
    """Patterns that may find a question's page, derived from its title, the most literal first."""
    of = lambda rx: F.regexp_extract("title", rx, 1)
    some = lambda c, *xs: F.when(c != "", F.array(*xs)).otherwise(F.array().cast("array<string>"))
    mc, p, part = of(r"(?i)^MC(\d+)"), of(r"^P(\d+)"), of(r"^P\d+([A-Za-z]?)")
    own = F.array(F.regexp_replace("title", r"([.()])", r"\\$1"))
    numbered = some(p, F.concat(F.lit(r"\bProblem\s+"), p, F.lit(r"\b")), F.concat(F.lit(r"(?:^|\n)\s*"), p, F.lit(r"\.\s*\(\d+\s*p")), F.concat(F.lit(r"(?:^|\n)\s*"), p, F.lit(r"\.\s+[A-Z(]")))
    return QUESTION_TITLES.df(spark).select("title", F.concat(own, some(mc, F.concat(F.lit(r"\b"), mc, F.lit(r"\."))), numbered, some(part, F.concat(F.lit(r"\("), F.lower(part), F.lit(r"\)")))).alias("matchers"))
