"""Queries against their SQL on rows that the test tables don't have."""

import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tesserae.functions import rules, rulesets
from tesserae.plans import catalog


def both(spark, folder, name, **tables):
    """The query's rows in Spark and in DuckDB, sorted."""
    duck = duckdb.connect()
    for t, rows in tables.items():
        path = f"{folder}/{t}.parquet"
        pq.write_table(rows, path)
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = duck.sql(catalog.oracle_sql()[name])
    out = catalog.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, out.collect()), key=repr), sorted(want.fetchall(), key=repr)


def letters(spark, folder, lines, orders=((1, 10), (2, 10), (3, 11)), parts=((5, "nut"), (6, "bolt"), (7, None)), customers=((10, "Ann"), (11, "Bo"))):
    """lines: (order, part, line, quantity, price, discount)"""
    cols = lambda rows, *types: [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    big, real = pa.int64(), pa.float64()
    return both(
        spark, folder, "regrade_letter",
        lineitem=pa.table([*cols(lines, big, big, pa.int32(), real, real, real), pa.array(["R"] * len(lines))], ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]),
        orders=pa.table(cols(orders, big, big), ["o_orderkey", "o_custkey"]),
        part=pa.table(cols(parts, big, pa.string()), ["p_partkey", "p_name"]),
        customer=pa.table(cols(customers, big, pa.string()), ["c_custkey", "c_name"]),
    )


def test_letter_rounds_products_as_sql_does(spark, tmp_path):
    halves = [(1, 5, k, 1.0, p / 100, d / 100) for k, (p, d) in enumerate((p, d) for p in range(100_050, 100_950, 50) for d in (1, 3, 5, 7, 9))]
    got, want = letters(spark, tmp_path, [(1 + k % 3, *row[1:]) for k, row in enumerate(halves)] + [(2, 5, 900, 1.0, 1.005, 1.0), (3, 6, 900, 1.0, 2.675, 1.0)])
    assert len(want) == 3 and got == want


def test_letter_of_odd_rows(spark, tmp_path):
    lines = [(1, 5, 1, 2.5, 10.0, 0.1), (1, 6, 2, 3.5, 10.0, None), (1, 7, 3, 1.0, 10.0, 0.1), (2, 7, 1, 1.0, 10.0, 0.1), (3, 5, 1, None, 10.0, 0.1), (3, 6, None, 1.0, 10.0, 0.1), (3, 6, 4, 0.6, 10.0, 0.1)]
    got, want = letters(spark, tmp_path, lines, orders=((1, 10), (1, 10), (2, 10), (3, 11), (None, 10)))
    assert len(want) == 3 and got == want
    assert {k: v for _, k, v in got}[2] is None


def test_letter_of_a_total_beyond_a_long(spark, tmp_path):
    got, want = letters(spark, tmp_path, [(1, 5, 1, 1.0, 9e16, 1.0), (1, 6, 2, 1.0, 9e16, 1.0), (2, 5, 1, 1.0, -9e16, 1.0), (2, 5, 2, 1.0, -9e16, 1.0), (3, 5, 1, 1.0, 10.0, 0.1)])
    assert got == want and got[0][2].endswith("Total: 18000000000000000000")


def test_strong_topics_by_the_rules_of_sql(spark, tmp_path):
    words = ["CI for", "z.test", "t test", "histogram", "R2", "sum of squares", "null hypothesis", "stem-leaf", "rank sum", "sign test", "Bayes", "MSE", "95%", "paired, then a t test", "least squares", "Kruskal", "chi-squared", "F = MS", "regression", "type I error", "P(A|B)", "P(k|s)", "Cov(", "E[X]"]
    around = ["", " ", "é", "中", "١", "_", "a", "́", "ſ", "K", "-", "\n"]
    texts = [a + w + b for w in words for a in around for b in around]
    texts += [w.replace(" ", c).replace("-", c) for w in words for c in "\n\r\x0b\x0c\t\x85 \xa0\x1c"]
    texts += [w.replace(x, y) for w in words for x, y in (("s", "ſ"), ("k", "K"), ("K", "K"), ("i", "ı"), ("I", "İ"), ("A", "ſ"))] + [None, ""]
    for k in range(0, len(texts), 500):  # counts of few texts each, so that differences don't level out
        got, want = both(spark, tmp_path, "strong_documents", documents=pa.table({"text": pa.array(texts[k : k + 500], pa.string())}))
        assert got == want
    case = rules.sql_case(rulesets.STRONG_TOPICS, "text")
    pq.write_table(pa.table({"text": pa.array(texts, pa.string())}), f"{tmp_path}/texts.parquet")
    found = spark.read.parquet(f"{tmp_path}/texts.parquet").select("text", rules.regex_case(rulesets.STRONG_TOPICS, F.col("text"), default=None))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(duckdb.sql(f"SELECT text, {case} FROM '{tmp_path}/texts.parquet'").fetchall(), key=repr)


def test_patterns_for_java_match_as_in_sql(spark, tmp_path):
    patterns = [rx for rx, _ in (*rulesets.CATEGORIES, *rulesets.CATEGORY_PATHS, *rulesets.STRONG_TOPICS, *rulesets.MATERIAL_KINDS)] + [r"(?i)^\w$", "(?i)[^s]", r"a.b$", r"(?i)\bs", r"k\b", r"\S\s[\s]", r"(?i)[A-Z]\b", r"(?i)^[a -s]+$", "(?i)^exam[s -]", "(?i)^exam[s-]*[.]"]
    texts = ["ſ", "K", "é", "a\rb", "a\nb", "a b\n", "a b", "és", "ks é", "x\x0b y", "x  y", "éexamé", "exam_1", "hwKey", "claſs notes", "Key hw", "ékey", "final é", "s", "exam.solution", "exam!key", "exam -ſolution", "hw3.key", "midterm(é)solution"]
    pq.write_table(pa.table({"text": pa.array(texts, pa.string())}), f"{tmp_path}/texts.parquet")
    got = spark.read.parquet(f"{tmp_path}/texts.parquet").select("text", *[F.col("text").rlike(rules.java(rx)).alias(f"c{k}") for k, rx in enumerate(patterns)])
    want = duckdb.sql(f"SELECT text, {', '.join(f'regexp_matches(text, {rules.quoted(rx)})' for rx in patterns)} FROM '{tmp_path}/texts.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_strong_topics_of_long_lines(spark, tmp_path):
    """Patterns that match nothing in one long line: RE2 reads it once, backtracking once for each word."""
    texts = ["paired " * 60_000, "matched é " * 60_000 + "t test", "stem " * 60_000, "é" * 200_000 + " 95% ", "F " + " " * 200_000 + "= MS", None, ""]
    began = time.monotonic()
    got, want = both(spark, tmp_path, "strong_documents", documents=pa.table({"text": pa.array(texts, pa.string())}))
    assert got == want and time.monotonic() - began < 30
    path = str(tmp_path / "documents.parquet")
    found = spark.read.parquet(path).select("text", rules.text_case(rulesets.STRONG_TOPICS, F.col("text"), default="none"))
    case = rules.sql_case(rulesets.STRONG_TOPICS, "text")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(duckdb.sql(f"SELECT text, coalesce({case}, 'none') FROM '{path}'").fetchall(), key=repr)
