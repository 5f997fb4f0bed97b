"""The ten operators on small fixtures: brute force, round trips, held-out accuracy, and odd rows."""

import datetime
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tesserae.llm import class_lm, components, decontaminate, entries, jaccard_join, language, line_dedup, onebit_search, pii, sentencepiece_scan, token_files, toxicity, words
from tesserae.llm.shingles import shingle_sets, window_hashes

ODD = [(1, None, "x"), (2, "", "x"), (3, "same words in this very short text", "x"), (3, "same words in this very short text", "x"), (4, "\n \t\n", None), (5, "a" * 70_000, "y"), (6, "word " * 15_000, "y")]
ODD_DDL = "doc_id long, text string, score string"  # score: a name that operators use as well


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD_DDL)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- 1 ---


def slow_tiles(item, doc, k):
    """The definition: again and again the longest unmarked match, ties by place."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return out
        n, i, j = best
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        out.append(best)


def test_tiles_equal_the_definition():
    r = random.Random(3)
    for _ in range(150):
        item, doc = ([r.randint(0, 3) for _ in range(r.randint(0, 18))] for _ in range(2))
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert got == slow_tiles(item, doc, 3)
        if len(doc) >= 3 and len(item) >= 3:
            item, doc = np.array(item, np.uint64) + np.uint64(1), np.array(doc, np.uint64) + np.uint64(1)
            places = np.flatnonzero(np.isin(window_hashes(doc, 3), window_hashes(item, 3)))
            assert decontaminate.doc_tiles(item, doc, places, 3) == got


def test_tiles_of_repetitive_texts_take_little():
    item, doc = np.ones(10_000, np.uint64), np.ones(200_000, np.uint64)
    assert decontaminate.tiles(item, doc) == [(10_000, 0, 0)]
    mixed = np.tile(np.array([1, 1, 2], np.uint64), 20_000)
    assert sum(n for n, _, _ in decontaminate.tiles(mixed[:3000], mixed)) == 3000


def test_contaminated_finds_reordered_passages(spark, odd, empty):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    half = passage.split()
    docs = spark.createDataFrame([(1, "start " + " ".join(half[6:]) + " middle " + " ".join(half[:6]).upper() + "!"), (2, "one two three four five"), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (8, "too short"), (9, None)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["n_tiles"], r["coverage"]) for r in got] == [(1, 7, 2, 1.0)]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.keep_uncontaminated(docs, bench).count() == 3


# --- 2 ---


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms_are_valid_linked_and_one_to_one(spark):
    cards = ["4944339490429605", "4932 6213 0151 6018"]
    ips = [f"10.{a}.{b}.7" for a in range(12) for b in range(12)]
    dates = [str(datetime.date(2020, 1, 1) + datetime.timedelta(k)) for k in range(200)]
    rows = [(k, f"x {v} y, again {v}.") for k, v in enumerate([cards[0], *ips, *dates, "ab.12@x.example.com", "+1 (988) 555-2485", "123-45-6789"])]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    new = [re.fullmatch(r"x (.*) y, again (.*)\.", t).groups() for t in out]
    assert all(a == b for a, b in new)
    assert luhn(new[0][0]) and new[0][0] != cards[0]
    moved = [a for a, _ in new[1 : 1 + len(ips)]]
    assert len(set(moved)) == len(ips) and all(max(map(int, m.split("."))) < 256 for m in moved)
    moved = [a for a, _ in new[1 + len(ips) : 1 + len(ips) + len(dates)]]
    assert len({datetime.date.fromisoformat(m) for m in moved}) == len(dates)
    assert re.fullmatch(r"[a-z]{2}\.\d\d@x\.example\.com", new[-3][0]) and re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", new[-2][0])


def test_invalid_numbers_stay(spark, odd, empty):
    text = "300.1.1.1 2021-02-29 4944339490429606 000-12-3456 12345 no@host"
    assert pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()["text"] == text
    out = {(r["doc_id"], r["text"], r["n_pii"]) for r in pii.pseudonymise(odd, "k").collect()}
    assert (1, None, 0) in out and (2, "", 0) in out and len(out) == 6
    assert pii.pseudonymise(empty, "k").count() == 0


def test_phones_outside_the_number_plan_move_one_to_one(spark):
    old = [f"+1 ({a:03}) {e:03}-7713" for a, e in [(17, 555), (0, 0), (199, 999), (200, 199), (999, 0), (100, 200), (212, 555)]] + [f"{a:03}-{a % 7 * 30:03}-0000" for a in range(200)]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(old)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = [r["text"] for r in rows]
    assert all(r["n_pii"] == 1 for r in rows) and all(a != b for a, b in zip(old, new, strict=True))
    assert all(re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) for a, b in zip(old, new, strict=True))
    valid = lambda s: all(x[0] >= "2" for x in re.findall("[0-9]{3}", s.removeprefix("+1"))[:2])
    assert [valid(s) for s in old] == [valid(s) for s in new] and len({re.sub("[^0-9]", "", s)[-10:] for s in new}) == len(new)


def test_cards_among_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/25", "order 12 4111111111111111", f"12 34 56 {card}", f"{card} 5500 0000 0000 0004", f"{card} 192.168.1.1", f"{card} 2024-01-02", "77 4111111111111111 ab.12@x.example.com", "123 988 555 2485", "1 " * 2000 + card]
    count = [1, 1, 1, 2, 2, 2, 2, 1]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r["n_pii"] for r in rows[:8]] == count
    assert not any("4111" in r["text"] or "192.168" in r["text"] or "2024" in r["text"] or "988" in r["text"] for r in rows)
    assert rows[0]["text"].endswith(" 12/25") and luhn(rows[0]["text"][:19].replace(" ", "")) and rows[1]["text"].startswith("order 12 4")
    assert all(len(r["text"]) == len(t) for r, t in zip(rows, texts, strict=True) if "192" not in t)


# --- 3 ---


def test_folding_undoes_lookalikes_and_digits():
    assert toxicity.fold(pa.array(["You 1D10T, ｉｄｉｏｔ; іdіоt! 2024 abc$$$", None])) == [" you idiot idiot idiot 2024 abc ", "  "]


def test_exceptions_and_length():
    lex = toxicity.Lexicon(words={"trash": 4.0}, stems={"moro": 4.0}, exceptions={"trash can": -4.0})
    auto = lex.automaton()
    s, w, h = lex.scores(toxicity.fold(pa.array(["the trash can", "you trash", "moronic", "a sumoro", "you trash " + "word " * 3000, ""])), auto)
    assert w.tolist() == [0.0, 4.0, 4.0, 0.0, 4.0, 0.0] and h.tolist() == [0, 1, 1, 0, 1, 0]
    assert s[1] > s[4] > s[0] == s[5]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = entries.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = out[out["predicted"] == 1]
    assert (hit["toxic"] == 1).mean() >= 0.9 and len(hit) >= 0.7 * (out["toxic"] == 1).sum()


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lex = toxicity.learn(odd, labels)
    assert toxicity.score(odd, lex).count() == 7 and toxicity.score(empty, lex).count() == 0
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


# --- 4 ---


def test_language_model_counts_and_tail(spark, sf, monkeypatch):
    monkeypatch.setattr(class_lm, "VOCABULARY_SWEEPS", 0)  # with sweeps, the head decides which neighbours' classes count
    docs = documents(spark, sf)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in docs.collect()]
    c = Counter(w for _, ws in rows for w in ws)
    n, v = sum(c.values()), len(c)
    model = class_lm.train(docs, head=800)
    assert (model.tokens, model.types) == (n, v)
    got = {r["doc_id"]: r for r in class_lm.score(docs, model).collect()}
    full = {r["doc_id"]: r for r in class_lm.score(docs, class_lm.train(docs)).collect()}
    for i, ws in rows:
        assert got[i]["n_tokens"] == got[i]["n_known"] == len(ws)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(got[i]["score"], full[i]["score"], rel_tol=1e-9)
    assert sum(g["score"] for g in got.values()) > sum(g["base_score"] for g in got.values())


def test_language_model_is_normalised(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "b a c")], "doc_id long, text string")
    m = class_lm.train(docs)
    assert np.allclose((10**m.transition).sum(axis=1), 1)


def test_exchange_beats_its_start():
    r = np.random.default_rng(1)
    pairs = r.integers(0, 50, (40, 40))
    pairs[:, 0] = pairs[0] = 5

    def likelihood(of):
        m = np.zeros((8, 8))
        np.add.at(m, (of[:, None].repeat(40, 1), of[None].repeat(40, 0)), pairs)
        return class_lm.xlogx(m).sum() - class_lm.xlogx(m.sum(0)).sum() - class_lm.xlogx(m.sum(1)).sum()

    one, many = (class_lm.exchange(pairs, 8, sweeps=s) for s in (0, 6))
    assert likelihood(many) > likelihood(one) and (many[1:] != 0).all()


def test_words_get_the_class_of_their_contexts(spark, monkeypatch):
    r = random.Random(4)
    frequent = [f"the{k}" for k in range(3)], [f"go{k}" for k in range(3)]
    # further words of both kinds with the same last letters; seen five times each
    rare = [f"n{k}xyz" for k in range(40)], [f"v{k}xyz" for k in range(40)]
    monkeypatch.setattr(class_lm, "UNITS_WORDS", 8)
    monkeypatch.setattr(class_lm, "UNITS", 272)  # a multiple of BLOCKS
    texts = [f"a {w} b c {v} d" for _ in range(300) for w, v in [(r.choice(frequent[0]), r.choice(frequent[1]))]]
    texts += [f"a {w} b c {v} d" for _ in range(5) for w, v in zip(*rare, strict=True)] + ["a oncexyz b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = class_lm.train(docs, head=8)
    got = {x["word"]: (x["n"], x["class"]) for x in model.counts.collect()}
    assert {w: n for w, (n, _) in got.items()} == Counter(w for t in texts for w in [*t.split(), ""])
    kinds = [{got[w][1] for w in ws} for ws in rare]
    assert all(len(k) == 1 for k in kinds) and kinds[0] != kinds[1]
    # transitions are counted with these classes
    of = {w: c for w, (_, c) in got.items()}
    pairs = Counter((of[a], of[b]) for t in texts for a, b in zip(["", *t.split()], [*t.split(), ""], strict=True))
    head = spark.sparkContext.broadcast((model.head, model.head_n, model.head_class))
    counted = class_lm.class_pairs_of(docs, head, model.class_of, model.counts)
    assert {(int(a), int(b)): int(counted[a, b]) for a, b in zip(*np.nonzero(counted), strict=True)} == pairs


def test_language_model_odd_rows(spark, odd, empty):
    assert class_lm.score(odd, class_lm.train(odd)).count() == 7
    nothing = class_lm.train(empty)
    assert class_lm.score(odd, nothing).count() == 7 and class_lm.score(empty, nothing).count() == 0


# --- 5 ---


def slow_search(rows, k=5):
    """Cosines by the definition, in plain Python numbers."""
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in sorted((r for r in good if r[0] % 50 == 0), key=lambda r: r[0]):
        near = [(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), i) for i, b in good if i != q and len(a) == len(b)]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(near, key=lambda t: (-round(t[0], 12), t[1]))[:k])]
    return out


def found_by(vectors, k=5):
    index = onebit_search.build_index(vectors)
    rows = onebit_search.nearest(index, onebit_search.usable(vectors).where("vec_id % 50 = 0"), k).orderBy("query_id", "rank").collect()
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows]


def test_search_equals_brute_force_in_every_dimension(spark, monkeypatch):
    monkeypatch.setattr(onebit_search, "BLOCK_ROWS", 70)
    monkeypatch.setattr(onebit_search, "QUERY_ROWS", 2)
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[50:90] = x[50]  # ties, of a query as well
    x[200:330] += 6 * x[200]  # a cluster
    rows = [(k, x[k].tolist()) for k in range(400)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (950, [])]
    rows += [(k, v) for k in range(1000, 1060) for v in [r.standard_normal(3).tolist()]] + [(1100, [1e300, 1e300]), (1101, [1e300, 1.0]), (1150, [5.0])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = found_by(vectors)
    want = slow_search([(i, v if v is None else [x / 1e300 for x in v] if i in (1100, 1101) else v) for i, v in rows])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert {q for q, *_ in got} >= {1000, 1050, 1100} and 1150 not in {q for q, *_ in got}


def test_search_keeps_samples_off_the_driver_and_sends_queries_once_to_a_part(spark, monkeypatch):
    driver, fit, scan, sent = os.getpid(), onebit_search.centroids_of, onebit_search.scanned, []

    def elsewhere(*args):
        assert os.getpid() != driver
        return fit(*args)

    def counted(*args):
        sent.append(args[1].count())
        return scan(*args)

    monkeypatch.setattr(onebit_search, "centroids_of", elsewhere)
    monkeypatch.setattr(onebit_search, "scanned", counted)
    for name, n in (("BLOCK_ROWS", 64), ("QUERY_ROWS", 2), ("LEAST_PARTS", 2), ("PART_BLOCKS", 8), ("WAVE_BYTES", 500)):
        monkeypatch.setattr(onebit_search, name, n, raising=False)
    rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(8).standard_normal((400, 16)))]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [g[:3] for g in got] == [w[:3] for w in slow_search(rows)]
    assert sum(sent) <= 2 * 8 * 2  # eight queries, two parts, at home and elsewhere; there are seven blocks or more


def test_of_equal_vectors_the_least_ids_are_enough():
    r = np.random.default_rng(7)
    x = r.integers(0, 2, (300, 3)).astype(np.float64)
    ids = r.permutation(300)
    want = sorted(int(k) for row in np.unique(x, axis=0) for same in [np.flatnonzero((x == row).all(axis=1))] for k in same[np.argsort(ids[same])][:4])
    assert onebit_search.first_of_equals(ids, x, 4).tolist() == want


def test_bounds_hold():
    r = np.random.default_rng(6)
    x, q = (onebit_search.units_of(r.standard_normal((n, 70))) for n in (2000, 20))
    turn = onebit_search.rotation(70)
    codes, scalars = onebit_search.encode_codes(x, turn)
    assert codes.shape == (2000, 2)
    upper, exact = onebit_search.Queries(q, turn).upper(codes, scalars, onebit_search.EPSILON), q @ x.T
    assert (upper >= exact).mean() > 0.9999
    assert np.abs(onebit_search.Queries(q, turn).upper(codes, scalars, 0.0) - exact).mean() < 0.15


def test_search_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert found_by(spark.createDataFrame([], schema)) == []
    assert found_by(spark.createDataFrame([(50, [1.0, 2.0])], schema)) == []
    two = found_by(spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0])], schema))
    assert [x[:3] for x in two] == [(0, 1, 50), (0, 2, 50), (50, 1, 0)]


# --- 6 ---


def test_coder_round_trip_and_checkpoints():
    r = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 1), (7, 3), (600_000, 900)):
        ids = (r.zipf(1.3, n) % top).astype(np.uint16) if n else np.zeros(0, np.uint16)
        t = token_files.Tables(token_files.scaled(np.bincount(ids, minlength=1 << 16)))
        raw = token_files.encode_file([1], [ids], t)
        assert np.array_equal(token_files.decode_file(raw, t)[2], ids)
    whole, _ = token_files.decode_block(memoryview(raw), 20 + 16, t)
    tail, _ = token_files.decode_block(memoryview(raw), 20 + 16, t, from_checkpoint=1)
    assert np.array_equal(whole[2 * token_files.CHECKPOINT_STEPS * token_files.LANES :], tail)
    with pytest.raises(ValueError):
        token_files.decode_file(raw[:-9] + b"x" + raw[-8:], t)


def test_frequencies_keep_rare_ids():
    f = token_files.scaled(np.array([10**9, 1, 0, 1]))
    assert f.sum() == 1 << token_files.SCALE and (f > 0).tolist() == [True, True, False, True]


def encoded_whole(e, texts):
    return [np.append(x, np.uint16(e.end_id)).tobytes() for x in e.whole(texts)]


def test_pieces_equal_the_library(monkeypatch):
    e = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = ["", " ", "a  b", "a   b ", "x \n y", "\n x", " <|endoftext|> a", "\x00 a \x00b", "\xa0 \xa0x", " \xa0 \xa0\n\x1f.\x1c1"] + ["".join(r.choice("ab \n.é1") for _ in range(r.randint(0, 40))) for _ in range(600)]
    assert e.encode(pa.array(texts)).to_pylist() == encoded_whole(e, texts)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff"]  # all white space and what looks like it
    texts = ["".join(r.choice([r.choice(spaces), " ", r.choice("a.1'sé")]) for _ in range(r.randint(1, 12))) for _ in range(20_000)]
    monkeypatch.setattr(token_files, "CACHE_BYTES", 2 << 20)
    for k in range(0, len(texts), 2000):
        assert e.encode(pa.array(texts[k : k + 2000])).to_pylist() == encoded_whole(e, texts[k : k + 2000])


def test_token_files(spark, odd, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    count = lambda ids: {"last": int(ids[-1])}
    got = token_files.token_files(odd, path, count, "last long").orderBy("start").collect()
    assert [g["doc_id"] for g in got] == [1, 2, 3, 3, 4, 5, 6] and all(g["last"] == 0 for g in got)
    assert [g["start"] for g in got] == [0, *np.cumsum([g["n_tokens"] for g in got])[:-1].tolist()]
    assert token_files.token_files(empty, path, count, "last long").count() == 0
    none = spark.createDataFrame([(None, "b"), (None, "b"), (-5, "a")], "doc_id long, text string")
    assert [g["doc_id"] for g in token_files.token_files(none, path, count, "last long").orderBy("start").collect()] == [None, None, -5]


def test_token_file_digests(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in entries.op6_token_files(spark, sf).collect()}
    start = 0
    for r in documents(spark, sf).orderBy("doc_id").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# --- 7 ---


def slow_viterbi(scores, penalty):
    best = [list(scores[0])]
    for s in scores[1:]:
        best.append([s[b] + max(best[-1][a] - (penalty if a != b else 0) for a in range(len(s))) for b in range(len(s))])
    return max(best[-1])


def test_viterbi_reaches_the_best_value(spark, sf):
    m = language.learn(documents(spark, sf), F.lit(True))
    texts = pa.array(["The thing and the other. Ungheit schaft der und einer nicht", "de", "", "que los ando mente", "日本 the"])
    w = language.words_of(texts)
    scores, (labels, _) = m.scores(w), m.labels(w)
    at = 0
    for n in w.n_words.tolist():
        if n:
            own, s = labels[at : at + n], scores[at : at + n].astype(float)
            value = sum(s[k, x] for k, x in enumerate(own)) - language.SWITCH_PENALTY * sum(a != b for a, b in zip(own, own[1:], strict=False))
            assert math.isclose(value, slow_viterbi(s.tolist(), language.SWITCH_PENALTY), rel_tol=1e-5)
        at += n


def test_language_held_out_and_odd_rows(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    out = entries.op7_language(spark, d).join(documents(spark, d).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97
    m = language.learn(documents(spark, d), F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, m).collect()}
    assert got[1] == got[2] == got[4] == "und" and language.identify(empty, m).count() == 0
    none = language.learn(documents(spark, d), F.lit(False))
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}


# --- 8 ---


@pytest.fixture(scope="module")
def lat():
    return sentencepiece_scan.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_words_equal_the_library(lat, library):
    r = random.Random(6)
    texts = ["", " ", "a  b", " lead", "▁x ▁▁ y", "日本語 é", "\x00a\n\t", "😀😀x"] + ["".join(r.choice("ab ▁é\n😀theing.,日") for _ in range(r.randint(1, 60))) for _ in range(500)]
    assert sentencepiece_scan.WordEncoder(lat).encode(pa.array(texts)).to_pylist() == library.encode(texts)


def test_chunks_equal_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "CHUNK", 50)
    monkeypatch.setattr(sentencepiece_scan, "GIANT", 200)
    r = random.Random(7)
    texts = ["".join(r.choice(a) for _ in range(700)) for a in ("abtheing", "ab theing. ", "😀日a")] + ["x" * 500, "short one", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_scan.decode(sentencepiece_scan.encode(docs, path), path).orderBy("doc_id").collect()
    assert [list(o["piece_ids"]) for o in out] == [library.encode(t or "") for t in texts]
    assert [o["decoded"] for o in out] == [t or "" for t in texts]


def test_scan_is_associative():
    r = np.random.default_rng(8)
    a, b, c = (np.where(r.random((4, 4)) < 0.5, 0.0, -np.inf) for _ in range(3))
    f = sentencepiece_scan.combine
    assert np.array_equal(f(f(a, b), c), f(a, f(b, c)))


def test_sentencepiece_odd_rows(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert sentencepiece_scan.encode(odd, path).count() == 7 and sentencepiece_scan.encode(empty, path).count() == 0


# --- 9 ---


def slow_line_dedup(rows, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    lost = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in lost or lost[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(9)
    pool = ["Short", "  A rather long shared line, Number One ", "a rather long shared line, number one", "ÉÉ é another shared line of text", "unique"]
    rows = [(i, "\n".join(r.choice(pool) + (str(i) if r.random() < 0.3 else "") for _ in range(r.randint(1, 6)))) for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(7)
    got = {g["doc_id"]: (g["n_lines"], g["n_dropped"], g["text"]) for g in line_dedup.line_dedup(docs, 20, 3).collect()}
    assert got == slow_line_dedup(rows, 20, 3)


def test_line_dedup_odd_rows(odd, empty):
    assert line_dedup.line_dedup(odd).count() == 7 and line_dedup.line_dedup(empty).count() == 0


# --- 10 ---


def slow_links(rows):
    sets = {}
    for i, t in rows:
        w = regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", (t or "").lower()).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links, root = Counter(), {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                for k in root:
                    if root[k] in (a, b):
                        root[k] = min(a, b)
    return {i: (root[i], links[i]) for i in sets}


def near_rows():
    r = random.Random(10)
    rows = []
    for base in range(6):
        words = [r.choice("abcdefghijklmnop") + str(r.randint(0, 99)) for _ in range(120)]
        for _ in range(9):
            own = words[:]
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                own[r.randrange(120)] = "edit" + str(r.randint(0, 999))
            rows.append((len(rows), " ".join(own)))
    return [*rows, (90, None), (91, ""), (92, "two words"), (93, "Two, words!")]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 4)
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string")
    got = {g["doc_id"]: (g["class_id"], g["n_links"]) for g in jaccard_join.near_duplicates(docs).collect()}
    assert got == slow_links(near_rows())
    kept = {g["doc_id"] for g in jaccard_join.keep_one(docs).collect()}
    assert kept == {i for i, (c, _) in got.items() if c == i}


def test_pruning_keeps_what_the_threshold_needs():
    least = jaccard_join.least_matches()
    assert least == sorted(least) and least[0] >= 1 and least[-1] < 0.8 * jaccard_join.BANDS * jaccard_join.BAND


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (5, 5)]
    got = {g["node"]: g["root"] for g in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100}


def test_near_duplicates_odd_rows(odd, empty):
    assert jaccard_join.near_duplicates(odd).count() == 7 and jaccard_join.near_duplicates(empty).count() == 0


def test_word_table_equals_a_dictionary(monkeypatch):
    r, table, known = random.Random(12), words.WordTable(), {}
    for k in range(30):
        some = list({"".join(r.choice("abé日") for _ in range(r.choice((0, 1, 3, 6, 40)))) for _ in range(3000)})
        found = table.find(pa.array(some, pa.string()))
        assert found.tolist() == [known.get(w, -1) for w in some]
        new = [w for w in some if w not in known]
        numbers = np.arange(len(known), len(known) + len(new))
        table.add(pa.array(new, pa.string()), numbers)
        known |= {w: int(n) for w, n in zip(new, numbers, strict=True) if len(w.encode()) <= words.LONGEST}


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "hashes_of", lambda w: (np.full(len(w), 5, np.uint64), np.ones(len(w), np.int64)))
    table = words.WordTable()
    table.add(pa.array(["a", "b"]), np.array([1, 2]))
    assert table.find(pa.array(["a", "b", "c"])).tolist() == [1, -1, -1]


def test_shingles_ignore_case_and_marks():
    a, b, c = shingle_sets(pa.array(["One, two three FOUR five six", "one two three four five six", "one two"]), 5)
    assert np.array_equal(a, b) and len(a) == 2 and len(c) == 1


# --- pipeline ---


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = documents(spark, sf)
    toxic = {r["doc_id"] for r in entries.op3_toxicity(spark, sf).where("predicted = 1").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in out}
    assert ids and not ids & toxic and len(ids) == len(out) and ids <= {r["doc_id"] for r in docs.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in out)
