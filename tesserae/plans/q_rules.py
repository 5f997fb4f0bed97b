"""Ordered rules: categories, strong topics, kinds of events, material, files and links, cache validity, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, rulesets, text
from ..operators import retrieve
from ..sources import readers
from .registry import Inline, query, table

FILES = Inline("path string", [
    (p,) for p in (
        "a/HW3 - key.pdf", "a/hw_12 solution.pdf", "b/HW3.pdf", "b/Homework.pdf", "c/Exam 1 solutions.pdf", "c/e2 solution.pdf", "c/midterm-graded.pdf", "d/Practice Exam 1.pdf",
        "d/extra_problems.pdf", "d/Review.pdf", "e/Exam 1.pdf", "e/final.pdf", "e/mid-term.pdf", "e/e1_form.pdf", "f/InClass 4.pdf", "g/z-table.pdf", "g/chisq.pdf", "h/CLRS.pdf", "h/ch2-sorting.pdf",
        "i/Lecture 5.pdf", "i/lec12.pdf", "i/ch7.pdf", "j/slides_final.pdf", "x/presentation/1VpSa5Tm.pdf", "x/slides/q.pdf", "x/Exams/q.pdf", "x/_textbook/q.pdf", "exams/q.pdf", "misc/readme.txt", "noslash",
    )
])


@query("categorize_case", "P01 D10 O7", f"""
SELECT path, name, coalesce({rules.sql_case(rulesets.CATEGORIES, 'name')}, {rules.sql_case(rulesets.CATEGORY_PATHS, 'lower(path)')}, 'other') AS category
FROM (SELECT path, string_split(path, '/')[-1] AS name FROM {FILES.sql()})
""")
def categorize_case(spark, d):
    """Nine ordered rules over the name, three others over the path, a default."""
    files = FILES.df(spark).withColumn("name", text.basename("path"))
    by_name = rules.regex_case(rulesets.CATEGORIES, F.col("name"), default=None)
    return files.withColumn("category", F.coalesce(by_name, rules.regex_case(rulesets.CATEGORY_PATHS, F.lower("path"))))


PHRASES = Inline("id int, body string", list(enumerate([
    "One-way ANOVA table", "multiple regression with an indicator variable", "simple regression of y on x", "chi-squared goodness of fit", "the Wilcoxon test", "categorical data in a two-way table",
    "a paired sample and its t-test", "the t statistic", "z score of 1.2", "state the null hypothesis", "a 95% confidence interval", "central limit theorem", "the MLE of theta", "covariance of X and Y",
    "a Poisson process", "exponential distribution", "find E(X)", "P(A | B) by Bayes", "A and B are independent", "the sample space", "draw a histogram", "nothing of the kind", "", "regression and ANOVA", "binomial t-test", "conditional density",
])))


@query("strong_first_match", "C02", f"SELECT id, {rules.sql_case(rulesets.STRONG_TOPICS, 'body')} AS strong FROM {PHRASES.sql()}")
def strong_first_match(spark, d):
    return PHRASES.df(spark).select("id", rules.regex_case(rulesets.STRONG_TOPICS, F.col("body"), default=None).alias("strong"))


@query("strong_documents", "C02", f"SELECT strong, count(*)::BIGINT AS n FROM (SELECT {rules.sql_case(rulesets.STRONG_TOPICS, 'text')} AS strong FROM documents) GROUP BY strong")
def strong_documents(spark, d):
    strong = rules.text_case(rulesets.STRONG_TOPICS, F.col("text"), default=None).alias("strong")
    return table(spark, d, "documents").select(strong).groupBy("strong").agg(F.count("*").alias("n"))


TITLES = Inline("uid int, title string", list(enumerate(["FINAL EXAM, all chapters", "Exam 2 review session", "Exam 3 (optional)", "Exam extra credit", "Exam 1", "Quiz 4", "HW 3", "new homework", "Project due", "Review of chapter 2", "Guest lecture", "show 1", ""])))


def sql_event(k: int) -> str:
    cases = " ".join(f"WHEN {' AND '.join(f'regexp_matches(lower(title), {rules.quoted(rx)})' for rx in need)} THEN {rules.quoted(out[k])}" for need, out in rulesets.EVENT_KINDS)
    return f"CASE {cases} ELSE {rules.quoted(rulesets.EVENT_DEFAULT[k])} END"


@query("event_kind", "P10", f"SELECT uid, {sql_event(0)} AS emoji, {sql_event(1)} AS label, {sql_event(2)} AS color FROM {TITLES.sql()}")
def event_kind(spark, d):
    low = F.lower("title")
    kind = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("emoji", "label", "color"), strict=True)])
    found = rules.first_rule([(rules.all_of(low, need), kind(out)) for need, out in rulesets.EVENT_KINDS], kind(rulesets.EVENT_DEFAULT))
    return TITLES.df(spark).select("uid", found.alias("k")).select("uid", "k.*")


@query("material_kind", "P12", f"SELECT path, coalesce({rules.sql_case(rulesets.MATERIAL_KINDS, 'lower(path)')}, 'other') AS kind FROM {FILES.sql()}")
def material_kind(spark, d):
    return FILES.df(spark).select("path", rules.regex_case(rulesets.MATERIAL_KINDS, F.lower("path")).alias("kind"))


HREF = r'href="([^"#]+)'
URLS = Inline("url string, freq int", [
    ("https://drive.google.com/drive/folders/1a", 1), ("https://drive.google.com/file/d/1a/view", 1), ("https://docs.google.com/presentation/d/2", 1), ("https://docs.google.com/document/d/2", 1), ("https://docs.google.com/spreadsheets/d/2", 1),
    ("https://docs.google.com/forms/d/2", 1), ("https://docs.google.com/drawings/d/2", 1), ("https://GitHub.com/a/b", 5), ("https://gitlab.com/a", 1), ("https://www.youtube.com/watch?v=1", 9), ("https://a.edu/files/hw.PDF", 1), ("https://a.com/x.tar.gz?dl=1", 1),
    ("https://a.edu/teaching/fall", 1), ("https://b.com/~prof/index.html", 1), ("https://prof.github.io/course", 1), ("https://prof.github.io/", 1), ("https://a.edu/", 2), ("https://a.edu/", 1), ("https://a.edu/a/b/c/d", 9), ("https://b.com/syllabus", 2), ("https://b.com/syllabus", 1), ("https://b.com/a/b/c/syllabus", 7), ("https://b.com/plain", 8), ("mailto:x@y", 1), ("/relative/lecture.pdf", 1),
])
SQL_PARTS = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)) AS path"
SQL_SHORT = "len(string_split(trim(path, '/'), '/')) <= 3"


def parts(df):
    """Adds host and path, both in lower case."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return df.withColumns({"host": F.lower(host), "path": F.lower(path)})


def link_action(url, host, path, freq):
    """skip, google_doc, download_file, full_scrape or single_page."""
    edu = rules.ends_with_any(host, (".edu", ".org"))
    short = F.size(F.split(F.btrim(path, F.lit("/")), "/")) <= 3
    return rules.first_rule([
        (host.isin(*rulesets.SKIPPED_HOSTS), "skip"),
        (rules.any_of(host, rulesets.DOCUMENT_HOSTS), "google_doc"),
        (rules.ends_with_any(path, rulesets.FILE_SUFFIXES), "download_file"),
        (rules.any_of(host, rulesets.CODE_HOSTS), "single_page"),
        (rules.any_of(path, rulesets.TEACHING_PATHS) | host.endswith(".github.io"), "full_scrape"),
        ((edu | rules.any_of(F.lower(url), rulesets.COURSE_WORDS)) & short & (freq >= 2), "full_scrape"),
    ], "single_page")


SQL_ACTION = f"""CASE WHEN list_contains([{', '.join(map(rules.quoted, rulesets.SKIPPED_HOSTS))}], host) THEN 'skip' WHEN {rules.sql_any('host', rulesets.DOCUMENT_HOSTS)} THEN 'google_doc'
  WHEN {rules.sql_any('path', rulesets.FILE_SUFFIXES, 'ends_with')} THEN 'download_file' WHEN {rules.sql_any('host', rulesets.CODE_HOSTS)} THEN 'single_page'
  WHEN {rules.sql_any('path', rulesets.TEACHING_PATHS)} OR ends_with(host, '.github.io') THEN 'full_scrape'
  WHEN (ends_with(host, '.edu') OR ends_with(host, '.org') OR {rules.sql_any('lower(url)', rulesets.COURSE_WORDS)}) AND {SQL_SHORT} AND freq >= 2 THEN 'full_scrape' ELSE 'single_page' END"""


@query("link_action_cases", "P06", f"SELECT url, freq, {SQL_ACTION} AS action FROM (SELECT *, {SQL_PARTS} FROM {URLS.sql()})")
def link_action_cases(spark, d):
    rows = parts(URLS.df(spark))
    return rows.select("url", "freq", link_action(F.col("url"), F.col("host"), F.col("path"), F.col("freq")).alias("action"))


@query("url_action", "P06 A18 A19", f"""
SELECT url, freq, {SQL_ACTION} AS action FROM (SELECT *, {SQL_PARTS} FROM (SELECT url, count(*)::BIGINT AS freq FROM (SELECT unnest(regexp_extract_all(html, '{HREF}', 1)) AS url FROM pages) GROUP BY url))
""")
def url_action(spark, d):
    """Links of all pages with how often they occur, which the action depends on."""
    found = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("url")).groupBy("url").agg(F.count("*").alias("freq"))
    return parts(found).select("url", "freq", link_action(F.col("url"), F.col("host"), F.col("path"), F.col("freq")).alias("action"))


SQL_KIND = "CASE " + " ".join(f"WHEN contains(host, '{h}')" + (f" AND contains(path, '{p}')" if p else "") + f" THEN '{k}'" for h, p, k in rulesets.URL_KINDS) + " WHEN ends_with(path, '.pdf') THEN 'pdf' ELSE 'web' END"


@query("url_kind", "P07", f"SELECT DISTINCT url, {SQL_KIND} AS kind FROM (SELECT *, {SQL_PARTS} FROM (SELECT url FROM {URLS.sql()} UNION ALL SELECT unnest(regexp_extract_all(html, '{HREF}', 1)) FROM pages))")
def url_kind(spark, d):
    found = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("url"))
    rows = parts(URLS.df(spark).select("url").unionAll(found))
    host, path = F.col("host"), F.col("path")
    kinds = [(host.contains(h) & (path.contains(p) if p else F.lit(True)), k) for h, p, k in rulesets.URL_KINDS]
    return rows.select("url", rules.first_rule([*kinds, (path.endswith(".pdf"), "pdf")], "web").alias("kind")).distinct()


OUTPUTS = Inline("path string, output string", [("a", "x" * 51), ("b", "x" * 50), ("c", "[vertex error: quota]" + "x" * 90), ("d", "x" * 500 + "[gemini error]"), ("e", "x" * 480 + "[claude error]"), ("f", None), ("g", "x" * 495 + "[claude error]")])
SQL_VALID = f"(output IS NOT NULL AND length(substr(output, 1, 500)) > 50 AND NOT {rules.sql_any('substr(output, 1, 500)', rulesets.ERROR_MARKS)})"


@query("cached_outputs", "P16 J04", f"SELECT o.path, coalesce({SQL_VALID}, FALSE) AS cached FROM {OUTPUTS.sql()} o UNION ALL SELECT 'missing', FALSE")
def cached_outputs(spark, d):
    """A cached output counts if it is there, longer than 50 characters, and its head has no mark of an error."""
    wanted = OUTPUTS.df(spark).select("path").union(spark.createDataFrame([("missing",)], "path string"))
    head = F.substring("output", 1, 500)
    valid = OUTPUTS.df(spark).where(F.col("output").isNotNull() & (F.length(head) > 50) & ~rules.any_of(head, rulesets.ERROR_MARKS))
    return wanted.join(valid.select("path", F.lit(True).alias("cached")), "path", "left").select("path", F.coalesce("cached", F.lit(False)).alias("cached"))


LOCAL = Inline("url string, size bigint", [("https://page/0", 0), ("https://page/1", 1)])


@query("size_equal_skip", "M10", """
SELECT page_id, octet_length(encode(html))::BIGINT AS expected, CASE WHEN size IS NULL THEN 'download' WHEN size = octet_length(encode(html)) THEN 'cached' ELSE 'changed' END AS action
FROM pages LEFT JOIN (SELECT page_id AS held, octet_length(encode(html)) - CASE WHEN contains(html, 'table') THEN 1 ELSE 0 END AS size FROM pages WHERE page_id < (SELECT max(page_id) // 2 FROM pages)) ON held = page_id
""")
def size_equal_skip(spark, d):
    """Joined by key: what is held in the expected size is skipped, another size or none is fetched again."""
    pages = table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("expected"), F.col("html").contains("table").alias("t"))
    half = pages.agg(F.floor(F.max("page_id") / 2).alias("half"))
    held = pages.crossJoin(F.broadcast(half)).where("page_id < half").select("page_id", (F.col("expected") - F.col("t").cast("int")).alias("size"))
    action = F.when(F.col("size").isNull(), "download").when(F.col("size") == F.col("expected"), "cached").otherwise("changed")
    return pages.join(held, "page_id", "left").select("page_id", "expected", action.alias("action"))


TYPES = Inline("id int, head string, content_type string", [(1, "%PDF-1.7", "text/html"), (2, "<html>", "text/html; charset=utf-8"), (3, "x", "Application/PDF"), (4, "plain", "text/plain"), (5, "<!DOCTYPE html>", None), (6, "PK\x03\x04", None), (7, "", "")])


@query("content_kind", "P15", f"""
SELECT id, CASE WHEN starts_with(head, '%PDF') OR contains(lower(coalesce(content_type, '')), 'application/pdf') THEN 'pdf' WHEN contains(lower(coalesce(content_type, '')), 'text/html') OR regexp_matches(lower(head), '^\\s*<(!doctype html|html)') THEN 'html' WHEN starts_with(head, 'PK' || chr(3) || chr(4)) THEN 'zip' ELSE 'other' END AS kind FROM {TYPES.sql()}
UNION ALL SELECT page_id, CASE WHEN regexp_matches(lower(substr(html, 1, 15)), '^\\s*<(!doctype html|html)') THEN 'html' ELSE 'other' END FROM pages
""")
def content_kind(spark, d):
    """By the first bytes, then by the declared type."""
    rows = TYPES.df(spark).select("id", F.col("head").cast("binary").alias("raw"), "content_type")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("raw"), F.lit(None).cast("string").alias("content_type"))
    return rows.unionByName(pages).select("id", readers.magic_kind("raw", "content_type").alias("kind"))


@query("search_newest", "P20", """
SELECT conv_id, turn FROM conversations WHERE contains(lower(concat_ws(' ', conv_id::VARCHAR, role, text)), 'the') ORDER BY conv_id DESC, turn DESC LIMIT 30
""")
def search_newest(spark, d):
    """Free text over several fields, the newest thirty first."""
    c = table(spark, d, "conversations")
    hit = F.lower(F.concat_ws(" ", F.col("conv_id").cast("string"), "role", "text")).contains("the")
    return c.where(hit).select("conv_id", "turn").orderBy(F.desc("conv_id"), F.desc("turn")).limit(30)


SITE = Inline("site string, kind string, path string, body string", [
    ("s", "ocr", "z notes", "n" * 40), ("s", "ocr", "Grading policy", "g" * 30), ("s", "ocr", "a schedule", "c" * 20), ("s", "page", "youtube.com/course", "y" * 20), ("s", "page", "site.edu/about", "a" * 25), ("s", "page", "site.edu/Syllabus", "b" * 10), ("t", "page", "only.org/x", "x" * 300), ("t", "ocr", "info", ""),
])
SQL_RANK = f"""CASE WHEN kind = 'ocr' THEN CASE WHEN {rules.sql_any('lower(path)', rulesets.IMPORTANT_NAMES)} THEN 0 ELSE 1 END
  ELSE 2 + CASE WHEN {rules.sql_any("string_split(lower(path), '/')[1]", rulesets.NOISY_HOSTS)} THEN 2 ELSE 0 END + CASE WHEN {rules.sql_any("string_split(lower(path), '/')[2]", rulesets.IMPORTANT_PAGES)} THEN 0 ELSE 1 END END"""


@query("importance_budget", "P21 W04 D22", f"""
SELECT site, place::INT AS place, path, substr(body, 1, (100 - before)::BIGINT) AS kept FROM (
  SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY site ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT *, row_number() OVER (PARTITION BY site ORDER BY {SQL_RANK}, path) AS place FROM {SITE.sql()})) WHERE before < 100
""")
def importance_budget(spark, d):
    """Important names first, noisy hosts last; then the texts in that order until the budget is spent."""
    low = F.lower("path")
    ocr = F.when(rules.any_of(low, rulesets.IMPORTANT_NAMES), 0).otherwise(1)
    page = 2 + F.when(rules.any_of(F.split(low, "/")[0], rulesets.NOISY_HOSTS), 2).otherwise(0) + F.when(rules.any_of(F.get(F.split(low, "/"), F.lit(1)), rulesets.IMPORTANT_PAGES), 0).otherwise(1)
    ranked = SITE.df(spark).withColumn("rank", F.when(F.col("kind") == "ocr", ocr).otherwise(page))
    placed = retrieve.first_n(ranked, ["site"], ["rank", "path"], 1 << 30)
    return retrieve.within_budget(placed, ["site"], ["place"], "body", 100).select("site", "place", "path", F.col("body").alias("kept"))


RAW = Inline("id int, raw string", list(enumerate([
    "a === b & c ≠ d", "# Title\n**bold** and `code` 5%", "x++ || y<<2", "", "see $$a = b$$ and x → y", "- one\n* two\n\n\n\nthree", "```py\ncode\n``` [link](http://x/y) a@b", "if (a !== b && c >= d) { e -= 1 } // $x$ *it*", "∀x ∈ A ∪ B: x ≤ y ⇒ z",
])))


def sql_substitutions(subject: str, sub: list[tuple[str, str]]) -> str:
    for rx, by in sub:
        subject = f"regexp_replace({subject}, {rules.quoted(rx)}, {rules.quoted(by)}, 'g')"
    return subject


@query("spoken_text", "2.12", f"SELECT id, trim({sql_substitutions('raw', rulesets.SPOKEN)}, ' ' || chr(10)) AS spoken, trim({sql_substitutions('raw', rulesets.REPLY_SPOKEN)}) AS reply FROM {RAW.sql()}")
def spoken_text(spark, d):
    """Symbols as they are read aloud, by forty ordered rules; and the reading form of chat replies."""
    return RAW.df(spark).select("id", text.strip(text.substitutions("raw", rulesets.SPOKEN)).alias("spoken"), F.trim(text.substitutions("raw", rulesets.REPLY_SPOKEN)).alias("reply"))
