"""Text base: chunks, dedup, pages, HTML, links, categories, bundles, index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import dedup, index
from ..shared import spread, written
from .registry import Inline, query, table

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
DEDUPED = f"(SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1({SQUEEZED.format('text')}))"
CORPUS = f"(SELECT d.* FROM documents d JOIN {DEDUPED} USING (doc_id))"


def corpus(spark, d):
    """Documents without exact copies (up to white space); the first stays."""
    return dedup.keep_first_by_hash(spread(table(spark, d, "documents")), text.content_hash("text"), "doc_id")


def query_rows(spark, d, terms):
    """Narrow rows of the corpus for one query: one pass over the texts, exact copies left out, written once."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    rows = index.query_rows(docs, terms, "doc_id", extra={"content_hash": text.content_hash("text")})
    return written(dedup.first_by_hash(rows, "content_hash", "chunk_ord"))


BM25_TERMS = ["the", "tion", "de", "heit", "verein"]


@query("bm25_topk", "A07 T02 A06", f"""
WITH t AS (SELECT doc_id, {TOKENS} AS terms FROM {CORPUS}),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM t),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM t) WHERE term IN ('the', 'tion', 'de', 'heit', 'verein') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term), stats GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 40
""")
def bm25_topk(spark, d):
    scores = index.bm25_scores(query_rows(spark, d, BM25_TERMS))
    return scores.select(F.col("chunk_ord").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)


@query("inverted_index", "K05 A06 O9", f"SELECT term, doc_id AS chunk_ord, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL")
def inverted_index(spark, d):
    return index.postings(table(spark, d, "documents"), "doc_id")


@query("doc_lengths", "K05 A06", f"SELECT doc_id AS chunk_ord, len({TOKENS})::BIGINT AS dl FROM documents")
def doc_lengths(spark, d):
    return index.doc_stats(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


@query("term_statistics", "A06", f"SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(spark, d):
    return index.postings(table(spark, d, "documents"), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("chunk_documents", "X01 Q1", r"""
WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, (i // 1300)::INT AS chunk, substr(t, i + 1, 1500) AS chunk_text FROM (SELECT doc_id, t, unnest(range(0, length(t), 1300)) AS i FROM s)
""")
def chunk_documents(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(text.chunks("text")).alias("chunk", "chunk_text"))


LENGTHS = Inline("doc string, text string", [(f"n{n}", "x" * (n - 1) + "é") for n in (1, 1299, 1300, 1301, 1400, 1500, 1501, 2600, 2700)] + [("blank", " \n\t "), ("empty", ""), ("nbsp", "\u00a0 inside\u00a0"), ("astral", "😀" * 1400), ("none", None)])


@query("chunk_edges", "X01 Q1", f"""
WITH s AS (SELECT doc, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS t FROM {LENGTHS.sql()})
SELECT doc, (i // 1300)::INT AS chunk, length(substr(t, i + 1, 1500))::INT AS chars, md5(substr(t, i + 1, 1500)) AS digest FROM (SELECT doc, t, unnest(range(0, length(t), 1300)) AS i FROM s)
""")
def chunk_edges(spark, d):
    rows = LENGTHS.df(spark).select("doc", F.posexplode(text.chunks("text")).alias("chunk", "part"))
    return rows.select("doc", "chunk", F.length("part").alias("chars"), F.md5("part").alias("digest"))


@query("dedup_keep_first", "A13 O10 Q2", f"SELECT doc_id, sha1({SQUEEZED.format('text')}) AS content_hash FROM {CORPUS}")
def dedup_keep_first(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.content_hash("text").alias("content_hash"))
    return dedup.first_by_hash(rows, "content_hash", "doc_id").select("doc_id", "content_hash")


PAGED = Inline("doc string, body string", [("a", "--- page 2 ---\nsecond\n--- page 3 ---\n \n--- page 4 ---\nfourth"), ("b", "no marker"), ("c", "intro\n--- page 9 ---\nnine\n--- page 1 ---\none"), ("d", "")])


@query("page_split", "S05 D4", rf"""
WITH p AS (SELECT doc, body, regexp_extract_all(body, '--- page (\d+) ---', 1) AS nos, string_split_regex(body, '--- page \d+ ---') AS parts FROM {PAGED.sql()})
SELECT doc, page, page_text FROM (
  SELECT doc, nos[k]::INT AS page, regexp_replace(parts[k + 1], '^\s+|\s+$', '', 'g') AS page_text FROM (SELECT *, unnest(range(1, len(nos) + 1)) AS k FROM p)
  UNION ALL SELECT doc, 1, regexp_replace(body, '^\s+|\s+$', '', 'g') FROM p WHERE len(nos) = 0)
WHERE page_text <> ''
""")
def page_split(spark, d):
    body = F.col("body")
    numbers = F.regexp_extract_all(body, F.lit(r"--- page (\d+) ---"), F.lit(1))
    bodies = F.slice(F.split(body, r"--- page \d+ ---", -1), 2, 1 << 30)
    marked = F.zip_with(numbers, bodies, lambda n, b: F.struct(n.cast("int").alias("page"), text.strip(b).alias("page_text")))
    whole = F.array(F.struct(F.lit(1).alias("page"), text.strip(body).alias("page_text")))
    return PAGED.df(spark).select("doc", F.inline(F.when(F.size(numbers) > 0, marked).otherwise(whole))).where("page_text <> ''")


@query("html_strip", "S06", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS visible FROM pages
""")
def html_strip(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", text.html_to_text("html").alias("visible"))


@query("html_tree_text", "S06", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<nav\b.*?</nav>|<footer\b.*?</footer>|<svg\b.*?</svg>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS visible FROM pages WHERE NOT contains(html, '&')
UNION ALL SELECT -1, 'a < b & c' UNION ALL SELECT -2, '' UNION ALL SELECT -3, 'open only'
""")
def html_tree_text(spark, d):
    """Visible text by a parser: dropped elements with all they hold, entities decoded, broken mark-up borne."""
    pages = table(spark, d, "pages").where(~F.col("html").contains("&")).select("page_id", "html")
    odd = spark.createDataFrame([(-1, "<p>a &lt; b &amp; c</p><nav>no <b>menu</b></nav>"), (-2, ""), (-3, "<div>open only<script>var x")], "page_id int, html string")
    rows = spread(pages).unionByName(odd.select(F.col("page_id").cast("long").alias("page_id"), "html"))
    return rows.select("page_id", text.squeeze(F.arrow_udf(markup.visible_texts, "string")("html")).alias("visible"))


HREF = r'href="([^"#]+)'


@query("page_links", "S21 U05", f"SELECT DISTINCT unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages")
def page_links(spark, d):
    return table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link")).distinct()


@query("link_frequency", "A18", f"SELECT link, count(*)::BIGINT AS n, count(DISTINCT page_id)::BIGINT AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages) GROUP BY link")
def link_frequency(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    per_page = links.groupBy("link", "page_id").agg(F.count("*").alias("k"))
    return per_page.groupBy("link").agg(F.sum("k").alias("n"), F.count("*").alias("n_pages"))


@query("ocr_need", "P13", r"""
SELECT doc_id, round(ratio, 6) AS ratio, length(t) < 400 OR strpos(t, chr(65533)) > 0 OR ratio < 0.55 AS needs_ocr
FROM (SELECT doc_id, text AS t, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Za-z0-9 \t\n\r]', '', 'g')) / length(text) ELSE 0.0 END AS ratio FROM documents)
""")
def ocr_need(spark, d):
    docs = table(spark, d, "documents").withColumn("ratio", text.letter_share("text"))
    need = (F.length("text") < 400) | F.col("text").contains("�") | (F.col("ratio") < 0.55)
    return docs.select("doc_id", F.round("ratio", 6).alias("ratio"), need.alias("needs_ocr"))


@query("bundle_concat", "K01 A11 D3", """
SELECT lang, source, doc_id // 1000 AS part, count(*)::BIGINT AS n_docs, sum(length(text))::BIGINT AS chars,
       sha1(string_agg('## ' || doc_id || chr(10) || text, chr(10) ORDER BY doc_id)) AS bundle_sha1
FROM documents GROUP BY ALL
""")
def bundle_concat(spark, d):
    """Texts of a category in order, in parts of a thousand ids: no group grows with the corpus."""
    part = F.struct("doc_id", F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("body"))
    ordered = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["body"])
    groups = table(spark, d, "documents").groupBy("lang", "source", F.floor(F.col("doc_id") / 1000).alias("part"))
    bundles = groups.agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars"), F.array_join(ordered, "\n").alias("bundle"))
    return bundles.select("lang", "source", "part", "n_docs", "chars", F.sha1("bundle").alias("bundle_sha1"))


@query("minimum_length", "S04", "SELECT doc_id, lang, length(text)::INT AS chars FROM documents WHERE length(text) >= CASE lang WHEN 'en' THEN 500 WHEN 'de' THEN 80 ELSE 200 END")
def minimum_length(spark, d):
    least = F.when(F.col("lang") == "en", 500).when(F.col("lang") == "de", 80).otherwise(200)
    return table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("chars")).where(F.col("chars") >= least)


@query("scalar_functions", "2.12", r"""
SELECT doc_id, length(text) // 4 AS token_estimate, substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 60) AS fingerprint,
  coalesce(nullif(substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), ''), 'file') AS slug,
  coalesce(nullif(trim(substr(regexp_replace(text, '[^a-zA-Z0-9._-]+', '_', 'g'), 1, 120), '_'), ''), 'untitled') AS safe_name,
  substr(sha256(text), 1, 24) AS memo_key, substr(sha1(text), 1, 12) AS short_hash, md5(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '#+', 'number', 'g')) AS spoken
FROM documents
""")
def scalar_functions(spark, d):
    spoken = text.substitutions("text", [(r"\d+", "#"), ("#+", "number")])
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", text.token_estimate("text").alias("token_estimate"), text.fingerprint("text").alias("fingerprint"), text.slug("text").alias("slug"), text.safe_name("text").alias("safe_name"), F.substring(F.sha2("text", 256), 1, 24).alias("memo_key"), F.substring(F.sha1("text"), 1, 12).alias("short_hash"), F.md5(spoken).alias("spoken"))


NAMES = Inline("id int, name string", list(enumerate(["Héllo, World! -- v2_final", "___", "", "a/b/c.pdf", "Ünï cödé  and   blanks", "x" * 70 + " y", "-lead and trail-", "keep_under__scores"])))


@query("slug_variants", "2.12", f"""
SELECT id, coalesce(nullif(lower(trim(substr(regexp_replace(trim(regexp_replace(name, '[^\\w\\sÀ-ÿ-]', '', 'g')), '[\\s_-]+', '-', 'g'), 1, 60), '-')), ''), 'untitled') AS dashed,
  replace(name, '/', '__') AS flat, replace(replace(name, '/', '__'), '__', '/') AS nested, CASE WHEN starts_with(name, 'a/b/') THEN substr(name, 5) END AS below FROM {NAMES.sql()}
""")
def slug_variants(spark, d):
    name = F.col("name")
    return NAMES.df(spark).select("id", text.dashed(name).alias("dashed"), text.flat_path(name).alias("flat"), text.nested_path(text.flat_path(name)).alias("nested"), text.relative_path(name, F.lit("a/b")).alias("below"))


@query("page_file_names", "2.12", r"""
SELECT page_id, substr(CASE WHEN ends_with(n, '.html') THEN n ELSE n || '.html' END, 1, 200) AS file FROM (SELECT page_id, trim(regexp_replace(CASE WHEN ends_with(r, '/') THEN r || 'index' ELSE r END, '[^a-zA-Z0-9._-]+', '_', 'g'), '_') AS n FROM (
  SELECT page_id, CASE WHEN r = '' THEN '/' WHEN starts_with(r, '?') THEN '/' || r ELSE r END AS r FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS r FROM pages)))
""")
def page_file_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_file_name("url").alias("file"))


DECODED = Inline("id int, raw string", [(1, "a%20b%2Fc"), (2, "Tom &amp; &quot;Jerry&quot; &lt;3 &#39;x&#39;"), (3, "plain"), (4, ""), (5, "%C3%A9t%C3%A9&gt;")])


@query("decoded_text", "2.12", f"""
SELECT id, CASE WHEN contains(raw, '&') AND NOT contains(raw, '%') THEN raw ELSE url_decode(raw) END AS url, replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS html FROM {DECODED.sql()}
""")
def decoded_text(spark, d):
    """Percent signs and entities; those of the basic set by replacement, the ampersand last."""
    url = F.when(F.col("raw").contains("&") & ~F.col("raw").contains("%"), F.col("raw")).otherwise(F.url_decode("raw"))
    html = F.col("raw")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return DECODED.df(spark).select("id", url.alias("url"), html.alias("html"))


MAIL_DATES = Inline("raw string", [("Tue, 3 Mar 2026 09:15:00 -0500",), ("28 Feb 2024 23:59 +0000",), ("Mon, 31 Feb 2026 01:00:00 +0000",), ("yesterday",), ("",)])
LOOSE_DATES = Inline("raw string", [("2026-03-04",), (" 3/4 ",), ("3/4/25",), ("2/30/2026",), ("Mar 4",), ("March 4, 2027",), ("sept. 9",), ("Foo 4",), ("13/1",), ("",)])


@query("mail_days", "2.12", f"SELECT raw, coalesce(strftime(try_strptime(regexp_extract(raw, '^(?:[A-Za-z]{{3}},\\s*)?(\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}}) \\d{{1,2}}:\\d{{2}}', 1), '%-d %b %Y'), '%Y-%m-%d'), '0000-00-00') AS day FROM {MAIL_DATES.sql()}")
def mail_days(spark, d):
    return MAIL_DATES.df(spark).select("raw", text.mail_day("raw").alias("day"))


@query("loose_dates", "2.12 X11", f"""
SELECT raw, coalesce(try_strptime(trim(raw), '%Y-%m-%d'), try_strptime(CASE WHEN regexp_matches(trim(raw), '^\\d+/\\d+$') THEN trim(raw) || '/2026' END, '%m/%d/%Y'), try_strptime(CASE WHEN regexp_matches(trim(raw), '^\\d+/\\d+/\\d\\d$') THEN trim(raw) END, '%m/%d/%y'), try_strptime(CASE WHEN regexp_matches(trim(raw), '^\\d+/\\d+/\\d{{4}}$') THEN trim(raw) END, '%m/%d/%Y'),
  try_strptime(regexp_extract(trim(raw), '^([A-Za-z]{{3}})[a-z]*\\.?\\s+\\d', 1) || ' ' || regexp_extract(trim(raw), '^[A-Za-z]+\\.?\\s+(\\d+)', 1) || ' ' || coalesce(nullif(regexp_extract(trim(raw), ',\\s*(\\d{{4}})$', 1), ''), '2026'), '%b %-d %Y'))::DATE AS day FROM {LOOSE_DATES.sql()}
""")
def loose_dates(spark, d):
    return LOOSE_DATES.df(spark).select("raw", text.parsed_day("raw", 2026).alias("day"))


@query("json_and_maps", "2.12", """
SELECT n_nationkey, to_json({'a': n_regionkey, 'b': n_name})::VARCHAR AS dumped, CASE WHEN n_regionkey = 1 THEN 'one' ELSE 'other' END AS named, n_name || '/' || CASE WHEN n_nationkey > 10 THEN 'late' ELSE 'early' END AS merged FROM nation
""")
def json_and_maps(spark, d):
    """JSON with keys in order, a map's value with a default, and a merge in which the later map wins."""
    names = F.create_map(F.lit(1), F.lit("one"))
    base, late = F.create_map(F.lit("when"), F.lit("early"), F.lit("who"), F.col("n_name")), F.create_map(F.lit("when"), F.lit("late"))
    merged = F.when(F.col("n_nationkey") > 10, F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(late, k)), late)).otherwise(base)
    dumped = F.to_json(F.struct(F.col("n_regionkey").alias("a"), F.col("n_name").alias("b")))
    return table(spark, d, "nation").select("n_nationkey", dumped.alias("dumped"), F.coalesce(F.try_element_at(names, F.col("n_regionkey").cast("int")), F.lit("other")).alias("named"), F.concat_ws("/", merged["who"], merged["when"]).alias("merged"))


RUNS = 40


@query("token_runs", "P14 W05", rf"""
WITH t AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents)),
g AS (SELECT doc_id, word, pos - row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS grp FROM t),
r AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, word, grp, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, coalesce(longest, 0)::INT AS longest_run, coalesce(longest, 0) >= {RUNS} AS degenerate FROM documents d LEFT JOIN r USING (doc_id)
""")
def token_runs(spark, d):
    """The longest run of one word by a fold over the words of each text: no shuffle."""
    words = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc, w):
        run = F.when(w == acc["word"], acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    longest = F.aggregate(words, start, step, lambda acc: acc["most"])
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", longest.alias("longest_run"))
    return docs.withColumn("degenerate", F.col("longest_run") >= RUNS)


LLM_JSON = Inline("raw string", [('```json\n[{"q": "a"}, {"q": "b"}]\n```',), ('[{"q": "a"}, {"q": "b"}, {"q": "c',), ("not json",), ('[{"q": "z"}]',)])


@query("json_salvage", "X15 S07 Z15", r"""
WITH a AS (SELECT raw, trim(regexp_replace(raw, '```(json)?', '', 'g'), ' ' || chr(10)) AS t FROM """ + LLM_JSON.sql() + r"""),
b AS (SELECT raw, CASE WHEN json_valid(t) THEN t WHEN strpos(t, '}') > 0 AND json_valid(regexp_extract(t, '(?s)^(.*\})', 1) || ']') THEN regexp_extract(t, '(?s)^(.*\})', 1) || ']' ELSE '[]' END AS j FROM a)
SELECT raw, json_array_length(j)::INT AS n, json_extract_string(j, '$[0].q') AS first_q FROM b
""")
def json_salvage(spark, d):
    schema = "array<struct<q:string>>"
    bare = F.trim(F.regexp_replace("raw", "```(json)?", ""), F.lit(" \n"))
    cut = F.concat(F.regexp_extract(bare, r"(?s)^(.*\})", 1), F.lit("]"))
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    items = F.coalesce(ok(bare), ok(cut), F.array().cast(schema))
    return LLM_JSON.df(spark).select("raw", F.size(items).alias("n"), F.get(items, F.lit(0))["q"].alias("first_q"))
