"""Graphs, URLs and crawling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import registration, rules, rulesets
from ..operators import graph
from .registry import Inline, query, table

DAG = Inline("course int, key string, ch int, label string, prereqs array<string>", [
    (1, "a", 1, "Start", []), (1, "b", 2, "Left", ["a"]), (1, "c", 2, "Right", ["a", "ghost"]), (1, "d", 3, "Join", ["b", "c"]), (1, "e", 1, "Free", []), (2, "x", 1, "Loop one", ["y"]), (2, "y", 1, "Loop two", ["x"]), (2, "z", 5, "Alone", []), (2, "a", 9, "Same key", ["z", "b"]), (3, "d", 1, "Other course", ["c"]),
])
SQL_EDGES = f"(SELECT e.course, e.src, e.dst FROM (SELECT course, unnest(prereqs) AS src, key AS dst FROM {DAG.sql()}) e JOIN {DAG.sql()} n ON n.key = e.src AND n.course = e.course)"


@query("dag_neighbours", "G02 Z16 D11", f"""
SELECT n.course, n.key, coalesce((SELECT list_sort(list(src)) FROM {SQL_EDGES} e WHERE e.course = n.course AND dst = n.key), []) AS before, coalesce((SELECT list_sort(list(dst)) FROM {SQL_EDGES} e WHERE e.course = n.course AND src = n.key), []) AS after FROM {DAG.sql()} n
""")
def dag_neighbours(spark, d):
    nodes = DAG.df(spark)
    e = graph.edges_of(nodes)
    before = e.groupBy("course", F.col("dst").alias("key")).agg(F.array_sort(F.collect_list("src")).alias("before"))
    after = e.groupBy("course", F.col("src").alias("key")).agg(F.array_sort(F.collect_list("dst")).alias("after"))
    none, by = F.array().cast("array<string>"), ["course", "key"]
    return nodes.select(*by).join(before, by, "left").join(after, by, "left").select(*by, F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


@query("dag_layers", "G03 W11", f"""
WITH RECURSIVE p(key, depth) AS (SELECT key, 0 FROM {DAG.sql()} WHERE course = 1 UNION ALL SELECT e.dst, depth + 1 FROM p JOIN {SQL_EDGES} e ON e.src = p.key AND e.course = 1)
SELECT key, max(depth)::INT AS layer FROM p GROUP BY key
""")
def dag_layers(spark, d):
    """Longest path from a source, by a recursive query over the small graph."""
    nodes = DAG.df(spark).where("course = 1")
    return spark.sql("""
        WITH RECURSIVE p(key, depth) AS (SELECT key, 0 FROM {nodes} UNION ALL SELECT e.dst, depth + 1 FROM p JOIN {edges} e ON e.src = p.key)
        SELECT key, max(depth) AS layer FROM p GROUP BY key
    """, nodes=nodes, edges=graph.edges_of(nodes))


@query("layer_positions", "G04 W12", f"""
WITH RECURSIVE p(key, depth) AS (SELECT key, 0 FROM {DAG.sql()} WHERE course = 1 UNION ALL SELECT e.dst, depth + 1 FROM p JOIN {SQL_EDGES} e ON e.src = p.key AND e.course = 1),
l AS (SELECT key, max(depth) AS layer FROM p GROUP BY key)
SELECT key, layer::INT AS y, round((row_number() OVER (PARTITION BY layer ORDER BY key) - 0.5) * 10 / count(*) OVER (PARTITION BY layer), 6)::DOUBLE AS x FROM l
""")
def layer_positions(spark, d):
    w = Window.partitionBy("layer")
    x = (F.row_number().over(w.orderBy("key")) - 0.5) * 10 / F.count("*").over(w)
    return dag_layers(spark, d).select("key", F.col("layer").alias("y"), F.round(x, 6).alias("x"))


@query("dag_topo", "G01 Z04")
def dag_topo(spark, d):
    return graph.topological_order(DAG.df(spark))


@query("mermaid", "K10", f"""
SELECT course, string_agg(line, chr(10) ORDER BY kind, line) AS text FROM (SELECT DISTINCT course, 0 AS kind, 'graph TD' AS line FROM {DAG.sql()} UNION ALL SELECT course, 1, key || '["' || label || '"]' FROM {DAG.sql()} UNION ALL SELECT course, 2, src || ' --> ' || dst FROM {SQL_EDGES}) GROUP BY course
""")
def mermaid(spark, d):
    """A graph for each course."""
    nodes = DAG.df(spark)
    lines = nodes.select("course", F.lit(0).alias("kind"), F.lit("graph TD").alias("line")).distinct()
    lines = lines.union(nodes.select("course", F.lit(1), F.concat("key", F.lit('["'), "label", F.lit('"]')))).union(graph.edges_of(nodes).select("course", F.lit(2), F.concat_ws(" --> ", "src", "dst")))
    return lines.groupBy("course").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "line"))), lambda x: x["line"]), "\n").alias("text"))


LINKS = Inline("src string, ord int, dst string", [
    ("http://a.edu/", 1, "http://a.edu/b.html"), ("http://a.edu/", 2, "http://a.edu/c"), ("http://a.edu/", 3, "http://other.com/x"), ("http://a.edu/", 4, "http://a.edu/pic.png"), ("http://a.edu/", 5, "http://a.edu/b.html"),
    ("http://a.edu/c", 1, "http://a.edu/d.pdf"), ("http://a.edu/c", 2, "http://a.edu/"), ("http://a.edu/b.html", 1, "http://a.edu/e"), ("http://a.edu/b.html", 2, "http://a.edu/d.pdf"), ("http://a.edu/e", 1, "http://a.edu/f.HTML"), ("http://a.edu/f.HTML", 1, "http://a.edu/g"), ("http://other.com/x", 1, "http://a.edu/hidden"), ("http://a.edu/pic.png", 1, "http://a.edu/hidden2"), ("http://a.edu/e", 2, "http://b.edu/page.md"), ("http://b.edu/page.md", 1, "http://a.edu/h.tex"),
])
HOSTS = ("a.edu", "b.edu")
SQL_SUFFIX = "regexp_extract(lower(regexp_extract(dst, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '[^/](\\.[^./]*)$', 1)"
SQL_FOLLOW = f"regexp_extract(dst, '^[a-z]+://([^/?#]*)', 1) IN ('a.edu', 'b.edu') AND {SQL_SUFFIX} IN ('', {', '.join(map(rules.quoted, rulesets.CRAWLED_SUFFIXES))})"


def followed(dst: str = "dst"):
    """Whether a crawl follows a link: by its host, and by its extension if it has one."""
    host = F.regexp_extract(dst, "^[a-z]+://([^/?#]*)", 1)
    suffix = F.regexp_extract(F.lower(F.regexp_extract(dst, "^[a-z]+://[^/?#]*([^?#]*)", 1)), r"[^/](\.[^./]*)$", 1)
    return host.isin(*HOSTS) & suffix.isin("", *rulesets.CRAWLED_SUFFIXES)


@query("link_bfs", "G06 S16 D21", f"""
WITH RECURSIVE p(node, depth) AS (SELECT 'http://a.edu/', 0 UNION ALL SELECT l.dst, depth + 1 FROM p JOIN (SELECT * FROM {LINKS.sql()} WHERE {SQL_FOLLOW}) l ON l.src = p.node WHERE depth < 4) SELECT node, min(depth)::INT AS depth FROM p GROUP BY node
""")
def link_bfs(spark, d):
    """Reachability under filters of host and extension."""
    return graph.bounded_bfs(LINKS.df(spark), spark.createDataFrame([("http://a.edu/",)], "node string"), 4, followed())


@query("crawl_budget", "G06 S16 Q10")
def crawl_budget(spark, d):
    """The first five pages that a queue visits."""
    return graph.crawl_order(LINKS.df(spark), "http://a.edu/", followed(), 5)


HREF = r'href="([^"#]+)'
SQL_LINKS = rf"(SELECT page_id, link, regexp_extract(link, '^https?://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1), ''), link) AS path FROM (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages))"

def links(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    path = F.coalesce(F.nullif(F.regexp_extract("link", r"^https?://[^/?#]+([^?#]*)", 1), F.lit("")), F.col("link"))
    return found.select("page_id", "link", F.regexp_extract("link", r"^https?://([^/?#]+)", 1).alias("host"), path.alias("path"))


@query("homepage_score", "C08", rf"""
SELECT link, score::BIGINT AS score, score >= 30 AS accepted FROM (SELECT link, 10 * count(*) + CASE WHEN regexp_matches(link, '(?i)\.edu|/~|teach') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(link, '(?i)course|class|page') THEN 30 ELSE 0 END
 - 5 * len(list_filter(string_split(any_value(path), '/'), lambda x: x <> '')) - CASE WHEN contains(link, '?') THEN 20 ELSE 0 END AS score FROM {SQL_LINKS} GROUP BY link)
""")
def homepage_score(spark, d):
    n = links(spark, d).groupBy("link", "path").agg(F.count("*").alias("n"))
    c = F.col("link")
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    score = 10 * F.col("n") + F.when(c.rlike(r"(?i)\.edu|/~|teach"), 50).otherwise(0) + F.when(c.rlike("(?i)course|class|page"), 30).otherwise(0) - 5 * depth - F.when(c.contains("?"), 20).otherwise(0)
    return n.select("link", score.cast("long").alias("score"), (score >= 30).alias("accepted"))


DRIVE = Inline("url string", [("https://docs.example.com/document/d/AbC_1-x/edit",), ("https://drive.example.com/file/d/ZZ9/view",), ("https://drive.example.com/open?id=Q77&x=1",), ("https://elsewhere.org/",)])


@query("drive_ids", "P08 P09", r"""
SELECT url, id, kind, CASE kind WHEN 'document' THEN 'https://export/' || id || '?format=txt' WHEN 'file' THEN 'https://export/' || id || '?download' END AS export_url, CASE WHEN id IS NOT NULL THEN id || CASE kind WHEN 'document' THEN '.txt' ELSE '.bin' END END AS file FROM (
  SELECT url, coalesce(nullif(regexp_extract(url, '/d/([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(url, '[?&]id=([A-Za-z0-9_-]+)', 1), '')) AS id, CASE WHEN contains(url, '/document/') THEN 'document' WHEN contains(url, 'drive.') THEN 'file' END AS kind FROM """ + DRIVE.sql() + ")")
def drive_ids(spark, d):
    url = F.col("url")
    ident = F.coalesce(F.nullif(F.regexp_extract(url, "/d/([A-Za-z0-9_-]+)", 1), F.lit("")), F.parse_url(url, F.lit("QUERY"), F.lit("id")))
    kind = F.when(url.contains("/document/"), "document").when(url.contains("drive."), "file")
    rows = DRIVE.df(spark).select("url", ident.alias("id"), kind.alias("kind"))
    export = F.when(F.col("kind") == "document", F.concat(F.lit("https://export/"), "id", F.lit("?format=txt"))).when(F.col("kind") == "file", F.concat(F.lit("https://export/"), "id", F.lit("?download")))
    return rows.select("url", "id", "kind", export.alias("export_url"), F.concat("id", F.when(F.col("kind") == "document", ".txt").otherwise(".bin")).alias("file"))


@query("resolved_links", "2.12", f"""
SELECT DISTINCT page_id, regexp_replace(CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || link WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || link
  ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || link END, '#.*$', '') AS resolved FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages) WHERE NOT contains(link, '..') AND NOT starts_with(link, '?')
""")
def resolved_links(spark, d):
    """Links made absolute against their page, without fragment."""
    rows = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    rows = rows.where(~F.col("link").contains("..") & ~F.col("link").startswith("?"))
    return rows.select("page_id", F.arrow_udf(registration.resolved, "string")("url", "link").alias("resolved")).distinct()
