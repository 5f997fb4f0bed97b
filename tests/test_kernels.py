"""Grouped kernels against plain statements of their rules."""

import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import markup, registration
from tesserae.operators import graph, records, retrieve, telemetry
from tesserae.plans import q_retrieval, tools
from tesserae.plans.registry import REGISTRY


def test_merge_takes_turns_and_skips_inside_a_turn():
    dense = [("d1", "A"), ("d2", "A"), ("d3", "A"), ("d4", "B"), ("d5", "C")]
    words = [(f"k{k}", f"K{k}") for k in range(1, 5)]
    assert [x for x, _ in retrieve.merge_lists([dense, words], 6, 2, True)] == ["d1", "k1", "d2", "k2", "d4", "k3"]


def test_fill_ignores_the_cap_and_without_fill_there_may_be_fewer():
    one = [(f"x{k}", "A") for k in range(6)]
    assert len(retrieve.merge_lists([one], 5, 2, False)) == 2
    assert [x for x, _ in retrieve.merge_lists([one], 5, 2, True)] == ["x0", "x1", "x2", "x3", "x4"]


@given(st.lists(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("XYZ")), max_size=8), min_size=1, max_size=3), st.integers(1, 8), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_merge_properties(lists, k, cap):
    out = retrieve.merge_lists(lists, k, cap, False)
    assert len({x for x, _ in out}) == len(out) <= k
    assert all(sum(s == t for _, s in out) <= cap for t in "XYZ")


@given(st.dictionaries(st.sampled_from("abcdefg"), st.lists(st.sampled_from("abcdefg"), max_size=3), min_size=1))
@settings(max_examples=60, deadline=None)
def test_topological_order_respects_edges(prereqs):
    order = graph.topological([(ord(k) % 3, k, ps) for k, ps in prereqs.items()])
    place = {k: i for i, k in enumerate(order)}
    for k in order:
        assert all(place[p] < place[k] for p in prereqs[k] if p in prereqs)


def test_topological_prefers_chapter_then_key_and_drops_cycles():
    assert graph.topological([(2, "b", []), (1, "z", []), (1, "c", ["b"]), (1, "x", ["y"]), (1, "y", ["x"])]) == ["z", "b", "c"]


def test_record_bounds_by_length():
    body = "w" * 28
    assert [r["num"] for r in records.record_spans(f"1. {body[1:]}\n2. {body}")] == [2]
    assert records.record_spans("1. " + "w" * 5997) == []
    assert records.record_spans("no head") == [{"num": 1, "body": "no head", "start": 0}]


def test_an_introduction_at_the_end_of_a_record_ends_it():
    text = f"1. first {'w' * 40}\nConsider the graph for questions 2-3\n2. second {'w' * 40}"
    assert [r["body"] for r in records.record_spans(text)] == [f"1. first {'w' * 40}", f"2. second {'w' * 40}"]


def test_preambles_drop_reversed_and_wide_ranges():
    text = "Use for problems 5-3 no\nAssume for problems 1-14 no\nConsider this for questions 1 to 2: shared\n1. a\n2. b\n3. c"
    found = records.preamble_spans(text)
    assert [(r["lo"], r["hi"]) for r in found] == [(1, 2)]
    assert text[found[0]["end"] :].strip() == "3. c" and found[0]["txt"] == "Consider this for questions 1 to 2: shared"
    alone = records.preamble_spans("Use it for question 1-2 " + "x" * 9000)[0]
    assert len(alone["txt"]) == 623 and alone["end"] == 8000


def test_titled_records_by_length():
    body = "w" * 70
    found = records.titled_spans(f"Problem 1: Sorting lists\n{body}\n2. Trees and heaps\n{body}\n3. Short one\nno")
    assert [r["label"] for r in found] == ["1. Sorting lists", "2. Trees and heaps"]


def slow_run(numbers):
    """Every start at 1 goes on with the next higher number; the longest counts, the first of equals."""
    best = []
    for k, n in enumerate(numbers):
        if n == 1:
            run = [k]
            for j in range(k + 1, len(numbers)):
                if numbers[j] == len(run) + 1:
                    run.append(j)
            best = run if len(run) > len(best) else best
    return best


@given(st.lists(st.integers(0, 4), max_size=14))
@settings(max_examples=300, deadline=None)
def test_longest_run_equals_the_rule(numbers):
    assert records.longest_run(numbers) == slow_run(numbers)


def test_numbered_run_takes_the_first_longest():
    assert [q["num"] for q in records.numbered_run("1. a\n2. b\n9. x\n1. c\n2. d")] == [1, 2]
    assert [(q["body"], q["points"]) for q in records.numbered_run("1. a [4 pts]\n2\\. b")] == [("a [4 pts]", 4.0), ("b", None)]
    assert records.numbered_run("1. a single question") == [] and records.numbered_run("") == []


def test_visible_text_drops_elements_and_decodes():
    assert markup.visible_text("<p>a &amp; b</p><nav>no<p>no</p></nav><svg><b>no</b></svg>c") == "a & b\nc"
    assert markup.visible_text(None) is None and markup.visible_text("<div>x<script>y") == "x"


def test_likeness_boosts_what_holds_the_query():
    assert telemetry.likeness("comp", "Comp Arch", None) == 1.0
    assert 0.3 < telemetry.likeness("statistcs", "statistics") < 1 and telemetry.likeness("@@", "abc", None) == 0


def slow_crawl(links, start, pages):
    queue, out = [start], []
    while queue and len(out) < pages:
        node = queue.pop(0)
        if node not in out:
            out.append(node)
            queue += [dst for src, _, dst in sorted(links) if src == node]
    return out


def test_crawl_visits_in_the_order_of_a_queue(spark):
    r = random.Random(3)
    links = sorted({(f"n{r.randint(0, 15)}", k, f"n{r.randint(0, 15)}") for k in range(60)})
    df = spark.createDataFrame(links, "src string, ord int, dst string")
    for pages in (1, 5, 40):
        got = sorted((x["place"], x["node"]) for x in graph.crawl_order(df, "n0", F.lit(True), pages).collect())
        assert [n for _, n in got] == slow_crawl(links, "n0", pages)


def test_clause_search_equals_a_plain_version(spark, sf):
    """BM25 by its formula for each clause, lists cut and merged by turns."""
    docs = {x["doc_id"]: (x["text"], x["source"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    terms = {i: re.findall("[a-z0-9]+", t.lower()) for i, (t, _) in docs.items()}
    n, avg = len(terms), sum(map(len, terms.values())) / len(terms)
    df = Counter(w for ws in terms.values() for w in set(ws))
    tf = {i: Counter(ws) for i, ws in terms.items()}

    def ranked(text, size):
        words = set(re.findall("[a-z0-9]+", text.lower()))
        score = {}
        for i, counts in tf.items():
            for w in words & counts.keys():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                score[i] = score.get(i, 0) + idf * counts[w] * 2.5 / (counts[w] + 1.5 * (0.25 + 0.75 * (len(terms[i]) or 1) / avg))
        return [(str(i), docs[i][1]) for i in sorted(score, key=lambda i: (-round(score[i], 9), i))[:size]]

    want = []
    for q, text in q_retrieval.ASKED.rows:
        parts = [c.strip() for c in re.split(r"(?i)[?;,]|\band\b", text) if len(c.split()) >= 3]
        lists = [ranked(text, 12)] + ([ranked(c, max(2, 12 // len(parts))) for c in parts] if len(parts) > 1 else [])
        want += [(q, k + 1, i) for k, (i, _) in enumerate(retrieve.merge_lists([x for x in lists if x], 12, 2, False))]
    got = sorted((x["query_id"], x["rank"], x["id"]) for x in q_retrieval.multi_clause_search(spark, sf).collect())
    assert got == sorted(want) and {q for q, *_ in got} == {"a", "b"}


def test_pages_that_cannot_be_read_leave_a_row(spark, sf):
    rows = sorted(((x["path"], x["page"], x["text"], x["error"]) for x in REGISTRY["page_scan"].run(spark, sf).collect()), key=repr)
    assert rows == [("a.pdf", 1, "one", None), ("a.pdf", 2, None, "ValueError: page"), ("a.pdf", 3, "three", None), ("b.pdf", None, None, "ValueError: not a document"), ("c.txt", 1, "plain  text", None), ("d.html", 1, "seen", None)]


def test_tools_have_schemas_and_give_errors_as_rows(spark, sf):
    rows = tools.schema_rows()
    assert len({r[0] for r in rows}) == 10 and ("topic_summary", "counts of a topic", "topic", "str", True, "the topic") in rows
    assert {tuple(r) for r in REGISTRY["tool_schemas"].run(spark, sf).collect()} == set(rows)
    for name, args, part in (("recent_mistakes", {"n": "many"}, "bad arguments"), ("problems_for_topic", {}, "missing topic"), ("none", {}, "unknown tool")):
        assert part in tools.call_tool(spark, sf, name, args).first()["error"]
    for name in tools.TOOLS:
        got = tools.call_tool(spark, sf, name, {"topic": "unity", "assignment": "1", "question": "a", "n": 2, "other": 1})
        assert "error" not in got.columns, name


def test_registered_functions_by_name(spark):
    assert set(registration.register(spark)) == set(registration.FUNCTIONS)
    row = spark.sql("SELECT resolve_url('http://a/b/c', '../d#e') AS u, html_unescape('&lt;&eacute;') AS h, numbered_run('1. a\\n2. b')[1].num AS n").first()
    assert tuple(row) == ("http://a/d", "<é", 2)


def test_captions_keep_a_stamp_after_fifteen_lines():
    lines = "\n".join(f"0:{k:02d}\nw{k}" for k in range(31))
    assert records.thin_captions(lines).count("[") == 3


@given(st.text(alphabet="ab. \n", max_size=300))
@settings(max_examples=50, deadline=None)
def test_packing_loses_no_letters(text):
    out = records.packed(text, 40)
    assert "".join(out).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_schedule_equals_a_step_by_step_one(spark):
    r = random.Random(5)
    arrivals = sorted(r.choice((0, 5, 7.5, 20, 21, 60, 100)) * 1.0 for _ in range(30))
    want: list[float] = []
    for a in arrivals:
        want.append(max(a, want[-1] + 12) if want else a)
    df = spark.createDataFrame([("x", k, a) for k, a in enumerate(arrivals)], "region string, n int, arrival double")
    assert [x["start"] for x in telemetry.scheduled(df, "region", "arrival", ["n"], 12.0).orderBy("n").collect()] == want
