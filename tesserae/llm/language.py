"""Language identification: script ranges narrow the candidates, a Viterbi pass with a switching penalty labels spans.

Learned from a bounded sample: for each language the log-probabilities of hashed byte trigrams of its words (a word
between spaces), and the scripts it is written in. A word's score in a language is the sum over its trigrams; languages
without the word's script are ruled out, unless no language has it. The best label sequence maximises the words' scores
less SWITCH_PENALTY for each change of language. Batches run through the recursion together, one word of every text at
a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, worker_cache

#: Documents of each language used for learning (a bound in expectation, by the hash of doc_id).
SAMPLE_PER_LANGUAGE = 3000
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
SCRIPT_SHARE = 0.02
RULED_OUT = -1e4
#: Numbers of a block of looked-up grams.
BLOCK_CELLS = 1 << 22

# Where runs of code points of one script begin (Unicode blocks). Common characters, marks and signs count as
# Latin (0), which every other script in a word outweighs; a word of several scripts has the one named last in SCRIPTS.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Indic", "Thai", "Tibetan", "Georgian", "Ethiopic", "Khmer", "Hangul", "Han", "Kana", "other")
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0750, "Arabic"), (0x0780, "other"), (0x0860, "other"), (0x0870, "Arabic"), (0x0900, "Indic"), (0x0E00, "Thai"), (0x0F00, "Tibetan"),
    (0x1000, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "other"),
    (0x1AB0, "Latin"), (0x1B00, "other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2C00, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x2D00, "Georgian"), (0x2D30, "other"), (0x2D80, "Ethiopic"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Latin"), (0x2E80, "Han"), (0x3000, "Latin"), (0x3005, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Latin"), (0x3400, "Han"), (0xA000, "other"), (0xA640, "Cyrillic"),
    (0xA6A0, "other"), (0xA700, "Latin"), (0xA800, "other"), (0xA8E0, "Indic"), (0xA900, "other"), (0xA960, "Hangul"), (0xA980, "other"),
    (0xAB00, "Ethiopic"), (0xAB30, "Latin"), (0xAB70, "other"), (0xAC00, "Hangul"), (0xD800, "other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Latin"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Latin"), (0x10000, "other"), (0x20000, "Han"), (0x32000, "other"),
)
N_SCRIPTS = len(SCRIPTS)
STARTS = np.array([at for at, _ in SCRIPT_STARTS], np.int64)
SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS], np.uint8)


def scripts_of(raw: np.ndarray) -> np.ndarray:
    """The script of the character that begins at each byte of UTF-8; bytes inside a character have the first script."""
    out = np.zeros(len(raw), np.uint8)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
        point = raw[lead].astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            more = raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) & 0x3F
            point = np.where(size > k, point << 6 | more, point)
        out[lead] = SCRIPT_AT[np.searchsorted(STARTS, point, "right") - 1]
    return out


@dataclass
class Words:
    """Words of a batch of texts in one buffer: each is a space and its letters, a space closes the buffer."""

    raw: np.ndarray
    starts: np.ndarray
    n_words: np.ndarray

    @property
    def grams(self) -> np.ndarray:
        """The hashed trigram that begins at each byte; the last two bytes begin none. Behind a word's space comes another
        space, whatever word follows: a word's trigrams depend on nothing but the word."""
        r = self.raw.astype(np.uint32)
        third = np.where(r[1:-1] == 0x20, np.uint32(0x20), r[2:])
        h = (r[:-2] * np.uint32(0x9E3779B1)) ^ (r[1:-1] * np.uint32(0x85EBCA6B)) ^ (third * np.uint32(0xC2B2AE35))
        return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.uint16)

    @property
    def scripts(self) -> np.ndarray:
        return np.maximum.reduceat(scripts_of(self.raw), self.starts) if len(self.starts) else np.zeros(0, np.uint8)


def words_of(texts: pa.Array) -> Words:
    """Runs of letters and marks that begin with a letter, in lower case."""
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\A\pM+|(?:[^\pL\pM]+\pM*)+", " "))
    raw = np.frombuffer("".join(f" {t}" if t else "" for t in plain.to_pylist()).encode() + b"  ", np.uint8)
    spaces = pc.count_substring(plain, " ").to_numpy(zero_copy_only=False)
    n = np.where(pc.not_equal(plain, "").to_numpy(zero_copy_only=False), spaces + 1, 0).astype(np.int64)
    starts = np.flatnonzero(raw == 0x20)[: n.sum()]
    return Words(raw, starts, n)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages, float32
    allowed: np.ndarray  # N_SCRIPTS x languages, bool

    def scores(self, w: Words) -> np.ndarray:
        """words x languages; the grams are looked up in blocks of a bounded size."""
        grams, size = w.grams, max(1, BLOCK_CELLS // (len(self.languages) or 1))
        out = np.empty((len(w.starts), len(self.languages)), np.float32)
        at = 0
        while at < len(w.starts):
            end = max(at + 1, int(np.searchsorted(w.starts, w.starts[at] + size)))
            stop = w.starts[end] if end < len(w.starts) else len(grams)
            out[at:end] = np.add.reduceat(self.logp[grams[w.starts[at] : stop]], w.starts[at:end] - w.starts[at], axis=0)
            at = end
        out[~self.allowed[w.scripts]] += np.float32(RULED_OUT)
        return out

    def labels(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word, its language on the best path, and its margin over the second language."""
        if not len(w.starts):
            return np.zeros(0, np.uint8), np.zeros(0, np.float32)
        scores = self.scores(w)
        order = np.argsort(-w.n_words, kind="stable")
        sizes = w.n_words[order]
        first = (np.cumsum(w.n_words) - w.n_words)[order]
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts with at least so many words
        back = np.zeros(scores.shape, np.uint8)
        own = np.arange(scores.shape[1], dtype=np.uint8)
        value = scores[first[: live[0]]].copy()
        for t in range(1, sizes[0]):
            n, at = live[t], first[: live[t]] + t
            value_n = value[:n]
            top = value_n.argmax(axis=1).astype(np.uint8)
            jump = np.take_along_axis(value_n, top[:, None].astype(np.int64), 1) - np.float32(SWITCH_PENALTY)
            stay = value_n >= jump
            back[at] = np.where(stay, own, top[:, None])
            value[:n] = np.where(stay, value_n, jump) + scores[at]
        out = np.zeros(len(scores), np.uint8)
        label = value.argmax(axis=1).astype(np.uint8)
        for t in range(sizes[0] - 1, -1, -1):
            at = first[: live[t]] + t
            out[at] = label[: live[t]]
            if t:
                label[: live[t]] = back[at, label[: live[t]]]
        two = np.sort(scores, axis=1)
        margin = two[:, -1] - two[:, -2] if scores.shape[1] > 1 else np.ones(len(scores), np.float32)
        return out, margin


def learn(docs: DataFrame, rows: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """From the documents with a language for which rows holds. Without any: a model that knows no language."""
    small_batches(docs.sparkSession)
    known = docs.where(rows & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))]), F.col("lang"))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + N_SCRIPTS), np.int64)
        worker_cache("language")
        for batch in batches:
            for b in slices(batch, 1000, 1):
                for i, lang in enumerate(languages):
                    w = words_of(b.column(1).filter(pc.equal(b.column(0), lang)))
                    if len(w.starts):
                        total[i, :BUCKETS] += np.bincount(w.grams, minlength=BUCKETS)
                        total[i, BUCKETS:] += np.bincount(w.scripts, minlength=N_SCRIPTS)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])

    total = np.zeros((len(languages), BUCKETS + N_SCRIPTS))
    summed = sample.mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    total[summed["i"], summed["j"]] = summed["n"]
    grams, scripts = total[:, :BUCKETS] + 0.5, total[:, BUCKETS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, logp, allowed)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``lang_score`` and ``lang_spans``.

    lang_pred is the language of most words (ties: the first by name), lang_score the share of these words, lang_spans
    an array of (lang, first_word, n_words) in text order. A null or empty text, one without a letter, or a model
    without languages gives ``und``, 0 and no span. Other columns pass through; columns of these names are replaced."""
    names = np.array(model.languages, object)
    small_batches(docs.sparkSession)

    def f(texts: pa.Array) -> pa.Array:
        worker_cache("language")
        langs, scores, spans = [], [], []
        for part in slices(texts, 1000):
            w = words_of(part)
            if not len(names):
                w = Words(w.raw, w.starts[:0], w.n_words * 0)
            labels, _ = model.labels(w)
            at = 0
            for n in w.n_words:
                own = labels[at : at + n]
                at += n
                if not n:
                    langs.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                counts = np.bincount(own, minlength=len(names))
                langs.append(names[counts.argmax()])
                scores.append(float(counts.max() / n))
                cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
                begins = [0, *cuts.tolist()]
                spans.append([{"lang": names[own[b]], "first_word": b, "n_words": e - b} for b, e in zip(begins, [*begins[1:], int(n)], strict=True)])
        span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], ["lang", "score", "spans"])

    out = docs.withColumn("_lid", F.arrow_udf(f, "lang string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>")(text_col))
    return out.withColumns({"lang_pred": F.col("_lid.lang"), "lang_score": F.col("_lid.score"), "lang_spans": F.col("_lid.spans")}).drop("_lid")
