"""Queries without SQL against plain versions over whole tables, and the pipeline against the stages' definitions."""

import datetime
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm import slow
from tests.llm.test_operators import documents, slow_line_dedup, slow_links, slow_tiles
from tesserae.llm import class_lm, decontaminate, entries, language, pii, sentencepiece_scan, toxicity
from tesserae.llm.common import crc_mod, learning


def plain_words(text):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", (text or "").lower()).split()


# --- 1 ---


def slow_contaminated(docs, items):
    out = set()
    for i, t in items:
        item = plain_words(t)
        for d, text in docs:
            doc = plain_words(text)
            found = slow_tiles(item, doc, min(5, len(item))) if item else []
            matched = sum(n for n, _, _ in found)
            if found and matched >= 0.6 * len(item) - 1e-9:
                out.add((d, i, len(found), matched, len(item)))
    return out


def test_contaminated_equals_brute_force(spark):
    r = random.Random(21)
    vocabulary = "a b c d e f g h".split()
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice((1, 2, 3, 4, 5, 9, 14))))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "!!"), (93, items[3][1]), (93, items[3][1]), (94, items[3][1].upper())]
    docs = []
    for k in range(40):
        parts = [r.choice(items)[1] or "" for _ in range(2)] + [" ".join(r.choice(vocabulary) for _ in range(12))]
        docs.append((k, " x. ".join(" ".join(p.split()[:: r.choice((1, 1, -1))]) for p in parts)))
    docs += [(99, None), (98, ""), (97, "a " * 200), (96, docs[0][1])]
    got = decontaminate.contaminated(spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, coverage double").repartition(3), spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string"))
    rows = [(x["doc_id"], x["item_id"], x["n_tiles"], x["matched_words"], x["item_words"]) for x in got.collect()]
    assert set(rows) == slow_contaminated(docs, items)
    assert sum(x[1] == 93 for x in rows) == 2 * len({x for x in rows if x[1] == 93})  # a row for each row of the benchmark


def test_blocks_of_the_benchmark_give_the_same(spark, sf, monkeypatch):
    docs, bench = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and whole


# --- 2 ---


def some_values(r, n):
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def valid_card():
        body = digit(r.choice((12, 14, 15)))
        return body + str(-slow.luhn(body, 1) % 10)

    def spaced(s):
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    kinds = [
        valid_card, lambda: spaced(valid_card()), lambda: digit(16), lambda: f"+1 ({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"{digit(3)}-{digit(3)}-{digit(4)}", lambda: f"{digit(3)}.{digit(3)}.{digit(4)}",
        lambda: ".".join(str(r.randint(0, 280)) for _ in range(4)), lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", lambda: f"{r.randint(0, 9999):04}-{r.randint(0, 13):02}-{r.randint(0, 32):02}", lambda: f"{r.randint(0, 32):02}/{r.randint(0, 13):02}/{r.randint(0, 9999):04}",
        lambda: f"{r.randint(1, 12):02}.{r.randint(1, 31):02}.{r.choice((1, 199, 200, 1999, 2000, 2024, 9799, 9800, 9999)):04}", lambda: r.choice(("29-02-2024", "02/29/1996", "2000-02-29", "29.02.0004", "02-29-9996", "1900-02-29")),
        lambda: f"Ab{digit(2)}.x_{digit(1)}@mail{digit(1)}.example.com", lambda: f"{spaced(valid_card())} {digit(2)}/{digit(2)}", lambda: f"order {digit(2)} {valid_card()}", lambda: digit(30), lambda: "word",
    ]
    return [r.choice(kinds)() for _ in range(n)]


def test_pseudonyms_equal_a_plain_version(spark):
    r = random.Random(22)
    texts = [r.choice((" ", ", ", " x ")).join(some_values(r, r.randint(1, 4))) for _ in range(700)] + [None, "", "a" * 50_000, "1 " * 3000]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "k2").orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        assert (row["text"], row["n_pii"]) == slow.pseudonymise(text, "k2"), text


def test_dates_move_one_to_one(spark):
    r = random.Random(23)
    old = {f"{a:02}/{b:02}/{y:04}" for a in range(1, 13) for b in range(1, 13) for y in (1, 1998, 2024, 9999)}
    old |= {f"{d:02}-{m:02}-{y}" for d in range(13, 32) for m in range(1, 13) for y in (1996, 1998) if slow.as_date(y, m, d)} | {f"{m:02}-{d:02}-{y}" for d in range(13, 32) for m in range(1, 13) for y in (1996, 1998) if slow.as_date(y, m, d)}
    old |= {str(datetime.date(1, 1, 1) + datetime.timedelta(r.randrange(3_652_059))) for _ in range(4700)} | {"9950-03-04", "0001-01-01", "9999-12-31", "9799-12-31", "9800-01-01", "0199-12-31", "0200-01-01"}
    old = sorted(old)
    assert len(old) > 6000
    new = [x["text"] for x in pii.pseudonymise(spark.createDataFrame(list(enumerate(old)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert len(set(new)) == len(old)
    for a, b in zip(old, new, strict=True):
        assert regex.sub("[0-9]", "0", a) == regex.sub("[0-9]", "0", b)
        one, two = (int(x) for x in regex.split("[-/]", b)[:2])
        if a[2:3] in "-/" and a[:4].isdigit() is False:  # readings stay: day first, month first, or both
            was = tuple(int(x) > 12 for x in regex.split("[-/]", a)[:2])
            assert (one > 12, two > 12) == was
            assert slow.as_date(int(b[6:]), two, one) or slow.as_date(int(b[6:]), one, two)
        else:
            assert datetime.date.fromisoformat(b)


# --- 3 ---


def test_toxicity_query_equals_a_plain_version(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.learn(docs, labels, learning(crc_mod("doc_id", 3), 1)[0])
    assert lexicon.words and lexicon.slope > 0
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    for x in entries.op3_toxicity(spark, sf).collect():
        want = slow.toxicity_score(texts[x["doc_id"]], lexicon)
        assert abs(x["score"] - want) < 1e-9 and x["predicted"] == int(want >= 0.7)
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1)


def test_toxicity_of_odd_rows(spark):
    lexicon = toxicity.Lexicon(words={"idiot": 5.0}, slope=2.0, offset=-3.0)
    rows = [(None, "you idiot"), (1, None), (1, ""), (2, "you idiot"), (2, "you idiot"), (3, "fine " * 20_000 + "idiot"), (4, "1d10t!")]
    got = toxicity.score(spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, toxicity int"), lexicon).collect()
    assert [round(x["toxicity"], 9) for x in got] == [round(float(slow.toxicity_score(t, lexicon)), 9) for _, t in rows]
    assert [x["toxic_hits"] for x in got] == [1, 0, 0, 1, 1, 1, 1]


# --- 4 ---


def test_class_scores_equal_a_plain_version(spark, sf):
    docs = documents(spark, sf)
    known, _ = learning(crc_mod("doc_id", 7), 2)
    model = class_lm.train(docs.where(known))
    words = {x["word"]: (x["n"], x["class"]) for x in model.counts.collect()}
    got = {x["doc_id"]: x for x in class_lm.score(docs, model).collect()}
    end = int(model.class_of[0])
    assert any(x["n_known"] < x["n_tokens"] for x in got.values())
    for x in docs.collect():
        total, before = 0.0, end
        for w in [*(x["text"] or "").encode().lower().decode().split(), ""] if (x["text"] or "").isascii() else [*regex.split(r"[\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), x["text"] or "").strip(" \t\n\x0b\x0c\r")), ""]:
            n, c = words.get(w, (0, None))
            c = int(model.class_of[class_lm.shape(w)]) if c is None else c
            total += model.transition[before, c] + np.log10(n + model.alpha) - model.log_room[c]
            before = c
        if x["text"]:
            assert abs(got[x["doc_id"]]["score"] - total) < 1e-6 * abs(total)
    held = [x for x in got.values() if zlib.crc32(str(x["doc_id"]).encode()) % 7 == 2]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_class_model_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "a b a"), (3, "a b a"), (4, "a " * 30_000)], "doc_id long, text string")
    model = class_lm.train(docs)
    got = sorted((x["doc_id"] or -1, x["n_tokens"], x["n_known"]) for x in class_lm.score(docs, model).collect())
    assert got == [(-1, 3, 3), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (4, 30_001, 30_001)]


# --- 7 ---


def test_languages_equal_a_plain_version(spark, sf):
    docs = documents(spark, sf)
    model = language.learn(docs, learning(crc_mod("doc_id", 4), 2)[0])
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    for x in entries.op7_language(spark, sf).collect():
        words = slow.words_of(texts[x["doc_id"]])
        if not words:
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        counts = np.bincount(slow.best_labels([slow.word_scores(w, model) for w in words]), minlength=len(model.languages))
        assert x["lang_pred"] == model.languages[int(counts.argmax())] and abs(x["score"] - counts.max() / len(words)) < 0.02


def test_scripts_and_words_without_letters(spark):
    words = language.words_of(language.pa.array(["việt người ὀδός где ქართული 日本の ابجد", "́", " ́ ́á 1 ̂", "", None]))
    names = [language.SCRIPTS[k] for k in words.scripts]
    assert names == ["Latin", "Latin", "Greek", "Cyrillic", "Georgian", "Kana", "Arabic", "Latin"] and words.n_words.tolist() == [7, 0, 1, 0, 0]
    model = language.learn(spark.createDataFrame([(1, "việt người", "vi"), (2, "the end", "en")], "doc_id long, text string, lang string"), F.lit(True))
    rows = spark.createDataFrame([(None, "́", 1), (2, "người việt", 1), (2, "người việt", 1), (3, None, 1), (4, "12 34", 1)], "doc_id long, text string, lang_pred int")
    assert [x["lang_pred"] for x in language.identify(rows, model).collect()] == ["und", "vi", "vi", "und", "und"]


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark, sf):
    docs = documents(spark, sf)
    model = language.learn(docs, F.lit(True))
    one, many = ({x["doc_id"]: (x["lang_pred"], x["lang_score"]) for x in language.identify(docs.repartition(n), model).collect()} for n in (1, 13))
    assert one == many


# --- 8 ---


def test_sentencepiece_query_equals_the_library(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {x["doc_id"]: x["text"] for x in documents(spark, sf).collect()}
    for x in entries.op8_sentencepiece(spark, sf).collect():
        ids = np.array(sp.encode(texts[x["doc_id"]] or ""), "<u4")
        assert (x["n_pieces"], x["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_tree_of_products_equals_a_pass_over_all(spark, monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(sentencepiece_scan, "FAN_IN", 3)
    for n in (1, 2, 3, 4, 11):
        sizes = [1, *r.integers(2, 5, n - 1), 1]
        path = [0, *[int(r.integers(0, k)) for k in sizes[1:-1]], 0]
        matrices = [np.full((a, b), -np.inf) for a, b in zip(sizes, sizes[1:], strict=False)]
        for m, a, b in zip(matrices, path, path[1:], strict=False):
            m[a, b] = 0.0
        rows = spark.createDataFrame([(7, k, *(int(x) if not isinstance(x, bytes) else x for x in sentencepiece_scan.packed_matrix(m).values())) for k, m in enumerate(matrices)], f"key long, node int, {sentencepiece_scan.MATRIX_DDL}")
        got = sorted((x["node"], x["start_state"], x["end_state"]) for x in sentencepiece_scan.tree_choice(rows, n - 1).collect())
        assert got == [(k, path[k], path[k + 1]) for k in range(n)]


# --- 9, 10: odd rows ---


def test_lines_of_odd_rows(spark):
    from tesserae.llm import line_dedup

    line = "a line that is long enough to count as one of many"
    rows = [(k, f"{line}\nx{k}") for k in range(6)] + [(None, line), (3, f" {line.upper()} \nagain"), (7, None), (8, ""), (9, "z" * 100_000)]
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, n_lines string").repartition(4)
    got = sorted(((x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in line_dedup.line_dedup(docs).collect()), key=repr)
    want = [(k, f"x{k}", 2, 1) for k in range(5)] + [(5, f"{line}\nx5", 2, 0), (3, "again", 2, 1), (None, line, 1, 0), (7, "", 1, 0), (8, "", 1, 0), (9, "z" * 100_000, 1, 0)]
    assert got == sorted(want, key=repr)


def test_filters_in_several_passes_find_the_same(spark, sf, monkeypatch):
    from tesserae.llm import line_dedup

    whole = sorted((x["doc_id"], x["n_dropped"]) for x in line_dedup.line_dedup(documents(spark, sf)).collect())
    monkeypatch.setattr(line_dedup, "filter_bits", lambda docs, least: (1 << 20, 4))
    assert sorted((x["doc_id"], x["n_dropped"]) for x in line_dedup.line_dedup(documents(spark, sf)).collect()) == whole


def test_rows_of_one_doc_id_keep_their_own_links(spark):
    from tesserae.llm import jaccard_join

    r = random.Random(24)
    text = lambda: [f"w{r.randint(0, 999)}" for _ in range(80)]
    a, b = text(), text()
    rows = [(3, " ".join(a)), (3, " ".join(b)), (7, " ".join([*a, "more"])), (8, " ".join([*b, "other"])), (9, " ".join(b)), (3, " ".join(a)), (None, " ".join(a)), (5, None), (5, "")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, class_id int").repartition(3)
    got = sorted((x["doc_id"], x["class_id"], x["n_links"]) for x in jaccard_join.near_duplicates(docs).collect())
    assert got == [(3, 3, 2), (3, 3, 2), (3, 3, 2), (5, 5, 0), (5, 5, 0), (7, 3, 2), (8, 3, 2), (9, 3, 2)]
    kept = sorted(((x["doc_id"], x["text"]) for x in jaccard_join.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(3, " ".join(a)), (3, " ".join(b)), (None, " ".join(a)), (5, None), (5, "")], key=repr)


def test_heavy_keys_join_like_others(spark, monkeypatch):
    from tesserae.llm import common

    monkeypatch.setattr(common, "HEAVY_SHARE", 4)
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(200)], "key long, v long")
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    got = {tuple(x) for x in common.join_counted(rows, per_key, "key", 200).collect()}
    assert got == {tuple(x) for x in rows.join(per_key.drop("n"), "key").collect()} and len(got) == 200


# --- pipeline ---


def stages():
    import corpus_pipeline

    return corpus_pipeline


def slow_pipeline(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.learn(docs, labels, learning(crc_mod("doc_id", 3), 1)[0])
    rows = {x["doc_id"]: x.asDict() for x in docs.collect()}
    rows = {i: x for i, x in rows.items() if slow.toxicity_score(x["text"], lexicon) < 0.7}
    lines = slow_line_dedup([(i, x["text"]) for i, x in rows.items()], 40, 5)
    rows = {i: x | {"text": lines[i][2], "n_chars": len(lines[i][2])} for i, x in rows.items()}
    classes = slow_links([(i, x["text"]) for i, x in rows.items()])
    rows = {i: x for i, x in rows.items() if classes[i][0] == i}
    items = [plain_words(x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, x in list(rows.items()):
        doc = plain_words(x["text"])
        if any(len({tuple(doc[k : k + 5]) for k in range(len(doc))} & {tuple(item[k : k + 5]) for k in range(len(item) - 4)}) and sum(n for n, _, _ in slow_tiles(item, near(item, doc), 5)) >= 0.6 * len(item) - 1e-9 for item in items):
            del rows[i]
    return {i: (x["text"], x["n_chars"], x["lang"], x["source"], sp.encode(x["text"])) for i, x in rows.items()}


def near(item, doc):
    """The words of a document that shared windows of five cover, others put out."""
    windows = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
    keep = {k + j for k in range(len(doc) - 4) if tuple(doc[k : k + 5]) in windows for j in range(5)}
    out = [w if k in keep else None for k, w in enumerate(doc)]
    return [w for k, w in enumerate(out) if w is not None or (k and out[k - 1] is not None)]


def test_pipeline_equals_its_stages_by_definition(spark, sf):
    got = {x["doc_id"]: (x["text"], x["n_chars"], x["lang"], x["source"], list(x["piece_ids"])) for x in stages().run(spark, sf).collect()}
    want = slow_pipeline(spark, sf)
    assert set(got) == set(want)
    assert got == want


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_rows(spark, sf, empty):
    import corpus_pipeline

    long_line = "a line that is long enough to count, and that six documents hold"
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "the same words here"), (3, "the same words here"), (4, "The SAME words, here"), (5, "b" * 70_000)] + [(k, f"{long_line}\nnumber {k} " + " ".join(f"w{k}x{j}" for j in range(30))) for k in range(10, 16)]
    docs = spark.createDataFrame([] if empty else [(i, t, "en", "s", len(t or ""), 1.5, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, toxicity double, set_key string, decoded string")
    start = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf))
        assert docs.columns[: len(start.columns)] == start.columns, name
    got = sorted(((x["doc_id"], x["text"], x["n_chars"]) for x in docs.collect()), key=repr)
    if empty:
        assert got == []
        return
    own = {k: rows[8 + k - 10][1].split("\n", 1)[1] for k in range(10, 16)}
    want = [(None, "no id", 5), (None, "", 0), (1, "", 0), (2, "", 0), (3, "the same words here", 19), (5, "b" * 70_000, 70_000)] + [(k, own[k], len(own[k])) for k in range(10, 15)] + [(15, rows[13][1], len(rows[13][1]))]
    assert got == sorted(want, key=repr)


def test_cluster_without_a_shared_folder_raises(monkeypatch):
    from types import SimpleNamespace

    from tesserae.shared import shared_dir

    conf = SimpleNamespace(get=lambda k, d: d)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a")))
    assert shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", applicationId="b"))).startswith("file:///")
    given = SimpleNamespace(get=lambda k, d: "hdfs:///shared/")
    assert shared_dir(SimpleNamespace(conf=given, sparkContext=SimpleNamespace(applicationId="c"))).startswith("hdfs:///shared/tesserae-")
