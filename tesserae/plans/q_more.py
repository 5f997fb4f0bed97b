"""Nested walks, wide tables, placeholders, manifests, guards."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import rules
from ..sources import readers
from .registry import Inline, query, table

TREES = Inline("doc string, raw string", [("a", '{"x": ["https://v/1", {"y": "https://v/2", "z": 3}], "w": "no"}'), ("b", '[["https://v/1"], null]'), ("c", "broken")])


def leaves(raw: str | None, prefix: str) -> list[str]:
    """String leaves that begin with the prefix, depth first, each once."""
    try:
        stack, out = [json.loads(raw or "null")], []
    except ValueError:
        return []
    while stack:
        v = stack.pop()
        if isinstance(v, str) and v.startswith(prefix):
            out.append(v)
        elif isinstance(v, (dict, list)):
            stack.extend(reversed(list(v.values()) if isinstance(v, dict) else v))
    return list(dict.fromkeys(out))


@query("json_string_leaves", "S20", f"SELECT doc, unnest(regexp_extract_all(raw, '\"(https://[^\"]*)\"', 1)) AS leaf FROM {TREES.sql()} WHERE json_valid(raw)")
def json_string_leaves(spark, d):
    walk = F.arrow_udf(lambda c: pa.array([leaves(x, "https://") for x in c.to_pylist()], pa.list_(pa.string())), "array<string>")
    return TREES.df(spark).select("doc", F.explode(walk("raw")).alias("leaf"))


class Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        self.inside = tag in ("td", "th") and bool(self.rows)
        if self.inside:
            self.rows[-1].append("")

    def handle_data(self, data):
        if self.inside:
            self.rows[-1][-1] += data

    def handle_endtag(self, tag):
        self.inside = self.inside and tag not in ("td", "th")


def flattened_table(html: str | None, least: int = 7) -> list[str]:
    """A table of at least so many columns as lines "label. head=value, ...", empty cells and dashes left out; a narrower
    one gives none."""
    parser = Cells()
    parser.feed(html or "")
    if not parser.rows or len(parser.rows[0]) < least:
        return []
    head = [h.strip() for h in parser.rows[0]]
    cells = ([v.strip() for v in r] for r in parser.rows[1:] if r)
    return [f"{r[0]}. " + ", ".join(f"{h}={v}" for h, v in zip(head[1:], r[1:], strict=False) if v not in ("", "-")) for r in cells]


def html_row(tag: str, cells: list) -> str:
    return "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"


WIDE = Inline("doc string, html string", [
    ("a", "<table>" + html_row("th", [f"c{k}" for k in range(7)]) + html_row("td", ["one", 1, "", 3, "-", 5, 6]) + html_row("td", ["two", "", "", "", "", "", "x"]) + "</table>"), ("b", "<table>" + html_row("th", range(6)) + html_row("td", range(6)) + "</table>"), ("c", ""), ("d", "<table>" + html_row("th", range(9)) + "</table>"),
])


@query("wide_table_lines", "X16", f"""
WITH t AS (SELECT doc, regexp_extract_all(html, '<tr>(.*?)</tr>', 1) AS trs FROM {WIDE.sql()}),
r AS (SELECT doc, regexp_extract_all(trs[1], '<th>(.*?)</th>', 1) AS head, unnest(trs[2:]) AS tr FROM t WHERE len(trs) > 0),
c AS (SELECT doc, head, regexp_extract_all(tr, '<td>(.*?)</td>', 1) AS cells FROM r WHERE len(head) >= 7)
SELECT doc, cells[1] || '. ' || array_to_string(list_transform(list_filter(range(2, len(cells) + 1), lambda k: cells[k] <> '' AND cells[k] <> '-'), lambda k: head[k] || '=' || cells[k]), ', ') AS line FROM c
""")
def wide_table_lines(spark, d):
    flat = F.arrow_udf(lambda c: pa.array([flattened_table(x) for x in c.to_pylist()], pa.list_(pa.string())), "array<string>")
    return WIDE.df(spark).select("doc", F.explode(flat("html")).alias("line"))


VALUES = [("name", "Ada"), ("topic", "graphs")]


@query("placeholders", "Z17", "SELECT n_nationkey, replace(replace('{name} of ' || n_name || ' on {topic}', '{name}', 'Ada'), '{topic}', 'graphs') AS line FROM nation")
def placeholders(spark, d):
    line = F.concat(F.lit("{name} of "), "n_name", F.lit(" on {topic}"))
    for k, v in VALUES:
        line = F.replace(line, F.lit("{" + k + "}"), F.lit(v))
    return table(spark, d, "nation").select("n_nationkey", line.alias("line"))


@query("id_manifest", "Z07 Z03", """
SELECT o_custkey AS id, count(*)::BIGINT AS refs, any_value(c_name) IS NOT NULL AS cached, CASE WHEN any_value(c_acctbal) < 0 THEN 'negative balance' END AS error FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1
""")
def id_manifest(spark, d):
    """Ids met anywhere with their number; cached rows keep what is known, errors are a column and not an exception."""
    refs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("refs"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    out = refs.join(known, "id", "left")
    return out.select("id", "refs", F.col("c_name").isNotNull().alias("cached"), F.when(F.col("c_acctbal") < 0, "negative balance").alias("error"))


PATHS = Inline("path string", [("data/ok/a.txt",), ("data/../etc/passwd",), ("/abs/x",), ("data/.git/config",), ("data/sub/..hidden/b",)])


@query("path_guard", "P22", f"SELECT path, NOT (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') OR list_contains(string_split(path, '/'), '.git')) AS allowed FROM {PATHS.sql()}")
def path_guard(spark, d):
    parts = F.split("path", "/")
    bad = F.col("path").startswith("/") | F.array_contains(parts, "..") | F.array_contains(parts, ".git")
    return PATHS.df(spark).select("path", (~bad).alias("allowed"))


ITEMS = Inline("course int, part string, ord int, kind string, ref string, title string", [
    (1, "modules", 1, "File", "f1", "one"), (1, "modules", 2, "Page", "p1", "two"), (1, "modules", 3, "File", "f1", "again"), (1, "modules", 4, "ExternalUrl", "u1", "three"), (1, "modules", 5, "SubHeader", None, "head"), (1, "modules", 6, "Assignment", "a1", "work"), (1, "modules", 7, "Discussion", "d1", "talk"), (1, "modules", 8, "ExternalTool", "t1", "tool"), (1, "modules", 9, "Quiz", "q1", "unknown kind"),
    (1, "front_page", 1, "Page", "home", "front"), (1, "pages", 1, "Page", "p1", "again"), (1, "pages", 2, "Page", "p2", "more"), (1, "files", 1, "File", "f1", "third time"), (1, "files", 2, "File", "f2", "new"), (1, "files", 3, "File", "f3", None), (1, "assignments", 1, "Assignment", "a1", "again"), (1, "discussions", 1, "Discussion", "d2", "listed"), (1, "announcements", 1, "Discussion", "n1", "news"), (2, "files", 1, "File", "f1", "another course"),
])
PARTS = ["modules", "front_page", "pages", "files", "assignments", "discussions", "announcements"]
KINDS = ["File", "Page", "ExternalUrl", "Assignment", "Discussion", "ExternalTool"]


def sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("course_assets", "S10 U01", f"""
SELECT course, kind, ref, arg_min(coalesce(title, ref), (part_ord, ord)) AS title, arg_min(part, (part_ord, ord)) AS part, count(*)::BIGINT AS met FROM (SELECT *, list_position({sql_list(PARTS)}, part) AS part_ord FROM {ITEMS.sql()}) WHERE list_contains({sql_list(KINDS)}, kind) AND ref IS NOT NULL GROUP BY ALL
""")
def course_assets(spark, d):
    """Six kinds of module items, the front page and five listings in one table of assets for each course: an item met in
    several places counts once, the first place wins; other kinds and headings are left out."""
    items = ITEMS.df(spark).where(F.col("kind").isin(*KINDS) & F.col("ref").isNotNull())
    walks = None
    for k, part in enumerate(PARTS):  # one reader for each part of a course
        own = items.where(F.col("part") == part).withColumn("at", F.struct(F.lit(k).alias("part_ord"), "ord"))
        walks = own if walks is None else walks.unionByName(own)
    return walks.groupBy("course", "kind", "ref").agg(F.min_by(F.coalesce("title", "ref"), "at").alias("title"), F.min_by("part", "at").alias("part"), F.count("*").alias("met"))


@query("course_errors", "S10", f"SELECT course, kind, count(*)::BIGINT AS n FROM {ITEMS.sql()} WHERE NOT list_contains({sql_list(KINDS)}, kind) OR ref IS NULL GROUP BY ALL")
def course_errors(spark, d):
    """What the walk could not take, beside its assets."""
    return ITEMS.df(spark).where(~F.col("kind").isin(*KINDS) | F.col("ref").isNull()).groupBy("course", "kind").agg(F.count("*").alias("n"))


@query("file_scan", "S01 P22", """
SELECT t || '.parquet' AS name, TRUE AS filled FROM (SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS t)
""")
def file_scan(spark, d):
    """Files by extension below a folder, skipped folders left out, by the listing alone: contents are not read."""
    files = readers.list_files(spark, d, "*.parquet", ("_temporary", ".git"))
    top = F.regexp_extract("path", r"([^/]+\.parquet)(?:/|$)", 1)
    return files.groupBy(top.alias("name")).agg((F.sum("size") > 0).alias("filled"))


@query("paged_nations", "S09", "SELECT n_regionkey::VARCHAR AS root, n_name AS name FROM nation WHERE n_regionkey IN (1, 3)")
def paged_nations(spark, d):
    """A paginated source, one partition for each root, pages followed until there is none."""
    rows = [(str(r["n_regionkey"]), r["n_name"]) for r in table(spark, d, "nation").select("n_regionkey", "n_name").collect()]  # 25 rows stand for a service
    spark.dataSource.register(readers.PagedSource)
    served = spark.read.format("paged").option("roots", "1,3").option("client", "json").option("pages", json.dumps(readers.as_pages(rows, 2))).load()
    return served.select("root", F.get_json_object("json", "$.name").alias("name"))


@query("page_scan", "S02 S03")
def page_scan(spark, d):
    """Pages of binary files by a pluggable extractor; a page or a file that can't be read becomes a row with its error."""

    def extract(raw: bytes) -> list:
        if raw.startswith(b"bad"):
            raise ValueError("not a document")
        return [p.decode() if p != b"?" else ValueError("page") for p in raw.split(b"\f")]

    files = spark.createDataFrame([("a.pdf", b"one\f?\fthree"), ("b.pdf", b"bad"), ("c.txt", b"plain \xff text"), ("d.html", b"<p>seen</p><script>no</script>")], "path string, content binary")
    return readers.by_format(files, extract)


def office_file(paragraphs: list[str]) -> bytes:
    import io
    import zipfile

    out, space = io.BytesIO(), "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p[:3]}</w:t></w:r><w:r><w:t>{p[3:]}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("office_text", "S15", "SELECT n_nationkey || '.docx' AS path, n_name || chr(10) || 'region ' || n_regionkey AS text, NULL AS error FROM nation UNION ALL SELECT 'broken.docx', NULL, 'BadZipFile: File is not a zip file' UNION ALL SELECT 'x.rtf', 'by a converter', NULL")
def office_text(spark, d):
    """Office documents by their paragraphs, other formats by a converter of one's own, broken files as errors."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows stand for files
    files = [(f"{r[0]}.docx", office_file([r[1], f"region {r[2]}"])) for r in rows] + [("broken.docx", b"no zip"), ("x.rtf", b"{}")]
    df = spark.createDataFrame(files, "path string, content binary")
    return readers.by_format(df, converters={".rtf": lambda raw: ["by a converter"]}).select("path", "text", "error")
