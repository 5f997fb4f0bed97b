"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length.

Folding: lower case, everything but letters and digits becomes one space, letters of other scripts that look Latin
become Latin, digits that stand for letters inside a word become those letters. Entries are whole words and stems
(a stem matches at the start of a word); exception phrases of two words take back the weight of the word they hold.
The lexicon is learned from labelled texts by counting the distinct contexts (word before, word after) of each word in
either class, so copies of one text count once. score = sigmoid(a * weight / log2(2 + words / 50) + b).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, learning, slices, small_batches, worker_cache, written

#: Labelled rows used for learning, per class: a bound in expectation, by the hash of doc_id.
SAMPLE_PER_CLASS = 5000
STEM_SIZES = range(4, 9)
MIN_CONTEXTS = 4
MIN_LOG_ODDS = 2.5

# Characters that look like Latin letters, and digits that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Plain insults, used with a moderate weight where the labels say nothing about them.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
SEED_WEIGHT = 3.0
#: Harmless phrases around entries, beside those that the labels show.
EXCEPTIONS = ("trash can", "trash bin", "sore loser", "class clown", "circus clown", "clown fish", "pond scum")

FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {c: chr(c - 0xFEE0).lower() for c in range(0xFF10, 0xFF5B)}
LEET = str.maketrans(DIGITS)


def fold(texts: pa.Array) -> list[str]:
    """Folded texts with a space at either end; nulls become a space."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    odd = np.asarray(pc.match_substring_regex(low, r"[\p{Greek}\p{Cyrillic}ɡı\x{FF10}-\x{FF5A}]|\pL\pM*[0-9@$]+\pL|[0-9@$]\pL|\pL[0-9@]").to_numpy(zero_copy_only=False))
    if odd.any():
        rows = low.to_pylist()
        for i in np.flatnonzero(odd):
            rows[i] = " ".join(unleet(w) for w in rows[i].translate(FOLD).split())
        low = pa.array(rows, pa.string())
    plain = pc.replace_substring_regex(low, r"[^\pL\pM\pN]+", " ")
    return [f" {t.strip()} " for t in plain.to_pylist()]


def unleet(word: str) -> str:
    """Digits and signs between or before letters stand for letters; signs at the end are decoration."""
    core = word.rstrip("$@!.,;:")
    if core.isalpha() or not any(c.isalpha() for c in core):
        return word
    return core.translate(LEET) + " "


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    slope: float = 2.0
    offset: float = -3.0

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for table, shape in ((self.words, " {} "), (self.stems, " {}"), (self.exceptions, " {} ")):
            for k, w in table.items():
                key = shape.format(k)
                out.add_word(key, out.get(key, 0.0) + w)
        if len(out):
            out.make_automaton()
        return out

    def level(self, weight: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return weight / np.log2(2 + n_words / 50)

    def scores(self, texts: list[str], automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, summed weight and number of matches of folded texts."""
        weight, hits, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, t in enumerate(texts):
            words[i] = max(0, t.count(" ") - 1)
            if len(automaton):
                found = [w for _, w in automaton.iter(t)]
                weight[i], hits[i] = sum(found), sum(1 if w > 0 else -1 for w in found)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.level(np.maximum(weight, 0), words) + self.offset, -50, 50))), weight, np.maximum(hits, 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: Column | None = None, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(text, toxic) of labelled documents for which rows holds, about per_class of each class at most."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if rows is None else rows)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")  # some: 2 * per_class rows or so


def learn(docs: DataFrame, labels: DataFrame, rows: Column | None = None) -> Lexicon:
    """A lexicon from the labelled documents for which rows (a condition on doc_id) holds.

    Without labelled rows of both classes: the seed words alone."""
    small_batches(docs.sparkSession)
    lexicon = Lexicon(words=dict.fromkeys(SEED, SEED_WEIGHT), exceptions={e: -SEED_WEIGHT for e in EXCEPTIONS})

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        for b in (part for batch in batches for part in slices(batch, 1000)):
            for toxic, t in zip(b.column(1).to_pylist(), fold(b.column(0)), strict=True):
                if w := t.split():
                    yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic] * len(w), pa.int32()), "before": ["", *w[:-1]], "word": w, "after": [*w[1:], ""]})

    sample = written(labelled_sample(docs, labels, rows))
    seen = written(sample.mapInArrow(contexts, "toxic int, before string, word string, after string").distinct())
    is_toxic, is_clean = F.col("toxic") == 1, F.col("toxic") == 0
    totals = seen.agg(F.count_if(is_toxic), F.count_if(is_clean)).first()
    if not totals[0] or not totals[1]:
        return lexicon
    ratio = totals[1] / totals[0]
    odds = lambda t, c: F.log((t + 0.2) * ratio / (c + 0.2 + 0.02 * t))
    counts = seen.groupBy("word").agg(F.count_if(is_toxic).alias("t"), F.count_if(is_clean).alias("c"))
    counts = counts.where(F.length("word") >= 3)
    words = counts.where((F.col("t") >= MIN_CONTEXTS) & (odds(F.col("t"), F.col("c")) > MIN_LOG_ODDS))
    stem = F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEM_SIZES])).alias("word")
    stems = counts.select(stem, "t", "c").where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("forms"))
    stems = stems.where((F.col("t") >= 3 * MIN_CONTEXTS) & (F.col("forms") >= 4) & (odds(F.col("t"), F.col("c")) > MIN_LOG_ODDS + 1) & (F.col("c") <= 0.05 * F.col("t")))
    weight = odds(F.col("t"), F.col("c")).alias("w")
    for r in stems.select("word", weight).orderBy(F.length("word"), "word").collect():  # a bounded sample gives bounded lists
        if not any(r["word"][:k] in lexicon.stems for k in STEM_SIZES):
            lexicon.stems[r["word"]] = r["w"]
    for r in words.select("word", weight).collect():
        if not any(r["word"][:k] in lexicon.stems for k in STEM_SIZES):
            lexicon.words[r["word"]] = r["w"]
    entry = F.broadcast(docs.sparkSession.createDataFrame(list(lexicon.words.items()), "word string, w double"))
    near = seen.join(entry, "word")
    pairs = near.select(F.concat_ws(" ", "before", "word").alias("pair"), "toxic", "w").union(near.select(F.concat_ws(" ", "word", "after"), "toxic", "w"))
    harmless = pairs.groupBy("pair").agg(F.count_if(is_toxic).alias("t"), F.count_if(is_clean).alias("c"), F.max("w").alias("w")).where("c >= 3 and c > 4 * t")
    for r in harmless.collect():
        if " " in r["pair"].strip():
            lexicon.exceptions[r["pair"]] = -r["w"]
    rows = np.array(sample.mapInArrow(measured(lexicon), "level double, toxic int").toPandas(), float)
    lexicon.slope, lexicon.offset = logistic(rows[:, 0], rows[:, 1])
    return lexicon


def measured(lexicon: Lexicon):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        automaton = lexicon.automaton()
        for b in (part for batch in batches for part in slices(batch, 1000)):
            texts = fold(b.column(0))
            _, weight, _ = lexicon.scores(texts, automaton)
            level = lexicon.level(np.maximum(weight, 0), np.array([max(0, t.count(" ") - 1) for t in texts]))
            yield pa.RecordBatch.from_arrays([pa.array(level), b.column(1)], ["level", "toxic"])

    return f


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not negative) and offset of a ridge-penalised logistic fit, classes weighted alike, by Newton steps."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([(weight * (p - y) * x).sum() + ridge * a, (weight * (p - y)).sum() + ridge * 0.1 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + ridge, (v * x).sum()], [(v * x).sum(), v.sum() + ridge * 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return max(0.0, float(a)), float(b)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """docs with ``toxicity`` (0 to 1) and ``toxic_hits``, the number of matches that count.

    A null or empty text has no match and the score of such a text; repeated rows get equal scores; other columns pass
    through (columns of these two names are replaced)."""
    automata: list = []
    small_batches(docs.sparkSession)

    def f(texts: pa.Array) -> pa.Array:
        worker_cache("toxicity")
        if not automata:
            automata.append(lexicon.automaton())
        parts = [lexicon.scores(fold(part), automata[0]) for part in slices(texts, 1000)]
        s, h = (np.concatenate([np.zeros(0), *[p[j] for p in parts]]) for j in (0, 2))
        return pa.StructArray.from_arrays([pa.array(s), pa.array(h.astype(np.int64))], ["score", "hits"])

    out = docs.withColumn("_tox", F.arrow_udf(f, "score double, hits long")(text_col))
    return out.withColumns({"toxicity": F.col("_tox.score"), "toxic_hits": F.col("_tox.hits")}).drop("_tox")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score stays below the threshold; their columns unchanged. A null or empty text stays. Rows
    without doc_id are scored like all others, but no label is theirs; repeated rows have one score."""
    lexicon = learn(docs, labels, learning(crc_mod("doc_id", 3), 1)[0])
    return score(docs, lexicon).where(F.col("toxicity") < threshold).select(*docs.columns)
