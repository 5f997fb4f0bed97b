"""Brown class bigrams: exchange clustering puts words into classes; class transitions and word emissions score texts.

Counts come from all training texts. The classes are found on units: the UNITS_WORDS most frequent words, the end of a
text, and for all other words one of UNITS_SHAPES groups by their last letters. Unit pairs are counted per task in one
matrix, and the matrices are summed in a tree with a fan-in of 64, so what a task or the driver holds doesn't depend on
the corpus. Then every other word seen MIN_COUNT times or more goes to the class that its own counted contexts (classes
before and after it) gain most from; contexts and (word, n, class) stay distributed tables. In VOCABULARY_SWEEPS further
passes (none by default) they all choose anew, by the classes that the HEAD most frequent words have by then. The last letters decide only
for words seen less often or never. Class transitions are counted anew with these classes.

    log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class)

Transitions are smoothed towards the class frequencies, emissions by an additive constant that leave-one-out picks.
The HEAD most frequent words (a fixed number) are broadcast; counts and classes of the rest come from a join on the word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, worker_cache, written
from .words import WordTable

UNITS_WORDS = 767
UNITS_SHAPES = 256
UNITS = 1 + UNITS_WORDS + UNITS_SHAPES  # unit 0: the end
CLASSES = 64
#: Passes over the vocabulary after the first, in which all words outside the units choose anew. One lowers held-out
#: perplexity by 3 % for a quarter more work.
VOCABULARY_SWEEPS = 0
#: Words seen so often have a class of their own contexts.
MIN_COUNT = 2
SWEEPS = 6
HEAD = 1 << 18
FAN_IN = 64
BLOCKS = 16
TRANSITION_PRIOR = 20.0
#: The end of a text in tables of words; no word is empty.
END = ""


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (without the ends), A-Z in lower case, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, rows = parts.flatten(), pc.list_parent_indices(parts)
    real = pc.not_equal(flat, "")
    return flat.filter(real), np.bincount(np.asarray(rows.filter(real)), minlength=len(texts))


def with_ends(values: np.ndarray, n_words: np.ndarray, end: int) -> np.ndarray:
    """The texts' values one after the other, an end behind each."""
    return np.insert(values, np.cumsum(n_words), end)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("class lm")
        for b in batches:
            words, n_words = tokens_of(b.column(0))
            found = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field(0), pa.array([END])]), pa.concat_arrays([found.field(1), pa.array([len(n_words)])])], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shape(word: str) -> int:
    return 1 + UNITS_WORDS + zlib.crc32(word[-3:].encode()) % UNITS_SHAPES


def shapes(words: pa.Array) -> np.ndarray:
    """shape() of all words; endings are few."""
    ends = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    return np.array([shape(e) for e in ends.dictionary.to_pylist()] or [0], np.int64)[np.asarray(ends.indices)]


def units_of(words: pa.Array, top: pa.Array) -> np.ndarray:
    """top: the words of units 1, 2, ..."""
    found = pc.fill_null(pc.index_in(words, value_set=top), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(found >= 0, found + 1, shapes(words))


def unit_pairs(docs: DataFrame, top: pa.Array) -> np.ndarray:
    """UNITS x UNITS counts of neighbouring units; each text starts after an end."""
    rows = UNITS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(UNITS * UNITS, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            words, n_words = tokens_of(b.column(0))
            coded = words.dictionary_encode()
            units = units_of(coded.dictionary, top)[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
            units = with_ends(units, n_words, 0)
            before = np.concatenate([[0], units[:-1]])
            total += np.bincount(before * UNITS + units, minlength=UNITS * UNITS)
        at = TaskContext.get().partitionId()
        for k, part in enumerate(np.split(total, BLOCKS)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "node": pa.array([at], pa.int64()), "counts": [zlib.compress(part.tobytes(), 1)]})

    def merge(pdf):
        import pandas as pd

        total = np.zeros(rows * UNITS, np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(raw), np.int64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "node": [pdf["node"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema, source = "block int, node long, counts binary", docs.select("text")
    parts, tree = source.rdd.getNumPartitions(), source.mapInArrow(count, schema)
    while True:
        tree = tree.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("block", "node").applyInPandas(merge, schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    out = np.zeros((UNITS, UNITS), np.int64)
    for r in tree.select("block", "counts").collect():  # BLOCKS rows, UNITS^2 numbers in all
        out[r["block"] * rows : (r["block"] + 1) * rows] = np.frombuffer(zlib.decompress(r["counts"]), np.int64).reshape(rows, UNITS)
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit: units move to the class that gains most likelihood, until a sweep moves none.

    The end (unit 0) is class 0 and stays alone; ties go to the smaller class."""
    n = pairs.astype(np.float64)
    freq = n.sum(axis=0)
    order = np.argsort(-freq, kind="stable")
    order = order[order != 0]
    of = np.zeros(len(n), np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.zeros((len(n), classes))
    member[np.arange(len(n)), of] = 1
    right, left = n @ member, (member.T @ n).T  # unit -> class after it, class before it
    m = member.T @ right
    for _ in range(sweeps):
        moves = 0
        for w in order:
            if not freq[w]:
                continue
            a, own = of[w], n[w, w]
            r, le = right[w].copy(), left[w].copy()
            m[a] -= r
            m[:, a] -= le
            m[a, a] += own
            r[a] -= own
            le[a] -= own
            base = xlogx(m)
            rows = xlogx(m + r[None, :]) - base
            cols = xlogx(m + le[:, None]) - base
            d = np.arange(classes)
            both = xlogx(m[d, d] + r + le + own) - base[d, d]
            out_n, in_n = m.sum(axis=1), m.sum(axis=0)
            gain = rows.sum(axis=1) - rows[d, d] + cols.sum(axis=0) - cols[d, d] + both
            gain -= xlogx(out_n + r.sum() + own) - xlogx(out_n) + xlogx(in_n + le.sum() + own) - xlogx(in_n)
            gain[0] = -np.inf
            b = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
            m[b] += r
            m[:, b] += le
            m[b, b] += own
            if b != a:
                moves += 1
                of[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w]
                left[:, b] += n[w]
        if not moves:
            break
    return of


#: An entry of a word's contexts: the class before it, or CLASSES + the class after it, and how often.
CONTEXT = np.dtype([("at", "u1"), ("n", "<u4")])


def contexts(docs: DataFrame, top: pa.Array, of: np.ndarray, head=None) -> DataFrame:
    """(word, contexts) for each word outside top: packed counts in a list, summed in a tree so that no list is long.

    The neighbours' classes are those of their units; with head, a broadcast of words, counts and classes, its words have
    the classes there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_cache("class lm")
        at_node, table = TaskContext.get().partitionId(), head and numbered(head.value[0])
        for b in batches:
            words, n_words = tokens_of(b.column(0))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            units, index = units_of(coded.dictionary, top), np.asarray(coded.indices).astype(np.int64)
            class_of = of[units]
            if table:
                place = table.find(coded.dictionary)
                class_of = np.where(place >= 0, head.value[2][place], class_of)
            classes, index = with_ends(class_of[index], n_words, of[0]), with_ends(np.where(units[index] > UNITS_WORDS, index, -1), n_words, -1)
            at = np.flatnonzero(index >= 0)
            before, after = np.where(at > 0, classes[at - 1], of[0]), classes[at + 1]  # an end is behind each word
            keys, n = np.unique(np.concatenate([index[at] * 2 * CLASSES + before, (index[at] * 2 + 1) * CLASSES + after]), return_counts=True)
            word, packed = packed_contexts(keys, n)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word)), pa.array(np.full(len(word), at_node)), packed], ["word", "node", "contexts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = summed_contexts(b.column(2), b.num_rows)
            row, at = np.nonzero(counts)
            word, packed = packed_contexts(row * 2 * CLASSES + at, counts[row, at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(word)), b.column(1).take(pa.array(word)), packed], ["word", "node", "contexts"])

    source, schema = docs.select("text"), "word string, node long, contexts binary"
    parts, tree = source.rdd.getNumPartitions(), source.mapInArrow(count, schema)
    while parts > FAN_IN:
        lists = tree.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("word", "node").agg(F.collect_list("contexts").alias("contexts"))
        parts, tree = -(-parts // FAN_IN), lists.mapInArrow(merge, schema)
    return tree.groupBy("word").agg(F.collect_list("contexts").alias("contexts"))


def packed_contexts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words and their packed entries; keys: ascending, word * 2 * CLASSES + place."""
    entries = np.zeros(len(keys), CONTEXT)
    entries["at"], entries["n"] = keys % (2 * CLASSES), n
    word, first = np.unique(keys // (2 * CLASSES), return_index=True)
    offsets = np.append(first, len(keys)).astype(np.int32) * CONTEXT.itemsize
    return word, pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])


def summed_contexts(lists: pa.Array, n_rows: int) -> np.ndarray:
    """rows x 2 * CLASSES: the sums of each row's packed counts."""
    flat = lists.flatten()
    entries = np.frombuffer(b"".join(flat.to_pylist()), CONTEXT)
    rows = np.repeat(np.asarray(pc.list_parent_indices(lists)).astype(np.int64), np.asarray(pc.binary_length(flat)) // CONTEXT.itemsize)
    return np.bincount(rows * 2 * CLASSES + entries["at"], entries["n"], n_rows * 2 * CLASSES).reshape(n_rows, 2 * CLASSES)


def assigned(found: DataFrame, pairs: np.ndarray, of: np.ndarray) -> DataFrame:
    """(word, n, class) from contexts(); pairs: of classes.

    To first order in a word's counts, the likelihood that exchange maximises gains by moving the word into a class the
    sum of its contexts' log probabilities given that class."""
    m = pairs + TRANSITION_PRIOR * (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
    gain = np.log(np.concatenate([m / m.sum(axis=0), (m / m.sum(axis=1, keepdims=True)).T]))  # context x class

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = summed_contexts(b.column(1), b.num_rows)
            n = counts[:, :CLASSES].sum(axis=1).astype(np.int64)
            best = 1 + np.round(counts @ gain[:, 1:], 6).argmax(axis=1)  # class 0 is the end's; ties go to the smaller class
            rare = np.flatnonzero(n < MIN_COUNT)
            best[rare] = of[shapes(b.column(0).take(pa.array(rare)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(best.astype(np.int32))], ["word", "n", "class"])

    return found.mapInArrow(choose, "word string, n long, class int")


def numbered(words: pa.Array) -> WordTable:
    """The places of the words."""
    out = WordTable()
    out.add(words, np.arange(len(words)))
    return out


class Coder:
    """Texts as classes: those of the head at once, those of other words (-1) as rows to be joined."""

    def __init__(self, words: pa.Array, classes: np.ndarray, of: np.ndarray):
        self.places_of, self.classes, self.of = numbered(words), classes, of  # words[0]: the end

    def code(self, texts: pa.Array) -> None:
        words, self.n_words = tokens_of(texts)
        coded = words.dictionary_encode()
        self.dictionary = coded.dictionary
        index = np.asarray(coded.indices).astype(np.int64)
        places = self.places_of.find(coded.dictionary)
        self.index = with_ends(index, self.n_words, -1)
        self.places = with_ends(places[index] if len(index) else index, self.n_words, 0)
        self.now = np.where(self.places >= 0, self.classes[self.places], -1)
        self.before = np.concatenate([self.classes[:1], self.now[:-1]])
        self.rows = np.repeat(np.arange(len(texts)), self.n_words + 1)

    def tail(self, keys: np.ndarray) -> dict[str, pa.Array]:
        at = np.flatnonzero(self.now < 0)
        used, inverse = np.unique(self.index[at], return_inverse=True)
        words = self.dictionary.take(pa.array(used))
        other = self.of[shapes(words)].astype(np.int32)
        numbers = {"pos": at, "other": other[inverse], "before": self.before[at], "after": self.now[at + 1] if len(at) else at}
        return {"key": pa.array(keys[self.rows[at]]), "word": words.take(pa.array(inverse))} | {c: pa.array(x.astype(np.int32)) for c, x in numbers.items()}


TAIL = "key long, word string, pos int, other int, before int, after int"


def placed(tail: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of Coder.tail with n and class from counts; before is known then, after stays -1 before a row of its own."""
    rows = tail.join(counts, "word", "left").select("key", "pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", "other").alias("class"), "before", "after")
    last = F.lag("class").over(Window.partitionBy("key").orderBy("pos"))
    return rows.withColumn("before", F.when(F.col("before") < 0, last).otherwise(F.col("before")))


def class_pairs_of(docs: DataFrame, head, of: np.ndarray, counts: DataFrame) -> np.ndarray:
    """CLASSES x CLASSES counts of neighbouring classes; head: a broadcast of words, counts and classes."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, _, classes = head.value
        coder, at = Coder(words, classes, of), TaskContext.get().partitionId() << 36
        total = np.zeros(CLASSES * CLASSES, np.int64)
        worker_cache("class lm")
        for batch in batches:
            for b in slices(batch, 2000):
                coder.code(b.column(0))
                known = (coder.now >= 0) & (coder.before >= 0)
                total += np.bincount(coder.before[known] * CLASSES + coder.now[known], minlength=CLASSES * CLASSES)
                rows = coder.tail(at + np.arange(b.num_rows))
                at += b.num_rows
                if len(rows["key"]):
                    yield pa.RecordBatch.from_pydict(rows | {"n_pairs": pa.nulls(len(rows["key"]), pa.int64())})
        found = np.flatnonzero(total)
        numbers = {"before": found // CLASSES, "after": found % CLASSES}
        nothing = {"key": pa.nulls(len(found), pa.int64()), "word": pa.nulls(len(found), pa.string()), "pos": pa.nulls(len(found), pa.int32()), "other": pa.nulls(len(found), pa.int32())}
        yield pa.RecordBatch.from_pydict(nothing | {c: pa.array(x.astype(np.int32)) for c, x in numbers.items()} | {"n_pairs": pa.array(total[found])})

    rows = written(docs.select("text").mapInArrow(local, TAIL + ", n_pairs long"))
    tail = placed(rows.where("word IS NOT NULL").drop("n_pairs"), counts)
    pair = lambda a, b: F.struct(F.col(a).alias("before"), F.col(b).alias("after"))
    steps = tail.select(F.explode(F.array(pair("before", "class"), F.when(F.col("after") >= 0, pair("class", "after")))).alias("p")).where("p IS NOT NULL")
    steps = steps.select("p.before", "p.after", F.lit(1).cast("long").alias("n_pairs"))
    out = np.zeros((CLASSES, CLASSES))
    for r in rows.where("word IS NULL").select("before", "after", "n_pairs").union(steps).groupBy("before", "after").agg(F.sum("n_pairs").alias("n")).collect():  # CLASSES^2 rows
        out[r["before"], r["after"]] = r["n"]
    return out


@dataclass
class Model:
    class_of: np.ndarray  # by unit
    transition: np.ndarray  # log10 P(class | class before)
    alpha: float
    log_room: np.ndarray  # by class: log10 of the emissions' denominator
    tokens: int  # N
    types: int  # V
    head: pa.Array  # the end and the most frequent words
    head_n: np.ndarray
    head_class: np.ndarray
    counts: DataFrame | None = None  # (word, n, class)


def spectrum_of(counts: DataFrame) -> list:
    """(lowest count, words, tokens) for groups of words with equal counts, from 1024 on with similar ones, the lowest
    first: some 4,000 rows at most."""
    n = F.col("n")
    group = F.when(n < 1024, n).otherwise(1024 + F.floor((F.log2(n) - 10) * 64))
    return counts.groupBy(group.alias("group")).agg(F.min("n").alias("least"), F.count("*").alias("words"), F.sum("n").alias("tokens")).orderBy("group").collect()


def head_of(counts: DataFrame, spectrum: list, size: int) -> tuple[pa.Array, np.ndarray, int]:
    """The words and counts of the most frequent words, at most size, by count and word; and their least count.

    The bound is found from the spectrum, so nothing is sorted but the words that are kept."""
    least, total = 1 << 62, 0
    for r in reversed(spectrum):
        if total + r["words"] > size:
            break
        least, total = r["least"], total + r["words"]
    rows = counts.where((F.col("n") >= least) & (F.col("word") != END)).select("word", "n").toArrow()
    if rows.num_rows < UNITS_WORDS:  # more words than fit have equal counts: some of these by their text
        more = counts.where((F.col("n") < least) & (F.col("word") != END)).orderBy(F.desc("n"), "word").limit(UNITS_WORDS - rows.num_rows)
        rows = pa.concat_tables([rows, more.select("word", "n").toArrow()])
    rows = rows.combine_chunks().sort_by([("n", "descending"), ("word", "ascending")])
    words = pa.concat_arrays(rows.column("word").chunks) if rows.num_rows else pa.array([], pa.string())
    return words.cast(pa.string()), rows.column("n").to_numpy(), least


def best_alpha(spectrum: list, tokens: int, types: int) -> float:
    """The additive constant with the best leave-one-out likelihood."""
    if not tokens:
        return 1.0
    n, m = (np.array([r[c] for r in spectrum], np.float64) for c in ("tokens", "words"))

    def fit(a: float) -> float:
        return float((n * np.log(n / m - 1 + a)).sum() - tokens * np.log(max(tokens - 1, 0) + a * (types + 1)))

    return max((0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0), key=fit)


def train(docs: DataFrame, head: int = HEAD) -> Model:
    """From all texts of docs. No text at all: every token is unknown."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = written(word_counts(docs))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, types = int(totals[0]), int(totals[1])
    spectrum = spectrum_of(counts)
    words, n, _ = head_of(counts, spectrum, max(head, UNITS_WORDS))
    top = words.slice(0, UNITS_WORDS)
    pairs = unit_pairs(docs, top)
    of = exchange(pairs)
    member = np.zeros((UNITS, CLASSES))
    member[np.arange(UNITS), of] = 1
    top_rows = F.broadcast(spark.createDataFrame([(w, int(of[k])) for k, w in enumerate([END, *top.to_pylist()])], "word string, class int"))
    kept = F.broadcast(spark.createDataFrame(pa.table({"word": words})))  # HEAD words at most
    head_words, head_n = pa.concat_arrays([pa.array([END]), words]), np.concatenate([[int(pairs[:, 0].sum())], n]).astype(np.int64)
    all_counts, shared = counts, None
    for _ in range(1 + VOCABULARY_SWEEPS):
        rest = assigned(contexts(docs, top, of, shared), member.T @ pairs @ member, of)
        counts = written(all_counts.join(top_rows, "word").select("word", "n", "class").union(rest))
        class_at = dict(zip(*(x.to_pylist() for x in counts.join(kept, "word").select("word", "class").toArrow().columns), strict=True))
        head_class = np.array([of[0], *(class_at[w] for w in words.to_pylist())], np.int64)
        shared = spark.sparkContext.broadcast((head_words, head_n, head_class))
    words, n = head_words, head_n
    class_pairs = class_pairs_of(docs, shared, of, counts)
    class_n, class_types = class_pairs.sum(axis=0), np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.count("*").alias("n")).collect():  # CLASSES rows
        class_types[r["class"]] = r["n"]
    prior = (class_n + 1) / (class_n.sum() + CLASSES)
    transition = (class_pairs + TRANSITION_PRIOR * prior) / (class_pairs.sum(axis=1, keepdims=True) + TRANSITION_PRIOR)
    alpha = best_alpha(spectrum, tokens, types)
    room = class_n + alpha * (class_types + 1)
    return Model(of, np.log10(transition), alpha, np.log10(room), tokens, types, words, n, head_class, counts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, n_known, base_score, score.

    A null or empty text is one end. Rows are scored one by one, so repeated rows (and repeated or null doc_ids) give a
    result each; other columns don't matter. base_score is the additively smoothed unigram log10 probability."""
    counts = model.counts
    small_batches(docs.sparkSession)
    head = docs.sparkSession.sparkContext.broadcast((model.head, model.head_n, model.head_class))  # HEAD words and the end at most
    of, transition, alpha, room = model.class_of, model.transition, model.alpha, model.log_room
    base_room = float(np.log10(model.tokens + model.types + 1))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words_h, n_h, classes = head.value
        coder = Coder(words_h, classes, of)
        at = TaskContext.get().partitionId() << 36
        worker_cache("class lm")
        for batch in batches:
            for b in slices(batch, 2000, 1):
                coder.code(b.column(1))
                before, now, known = coder.before, coder.now, coder.places >= 0
                n = n_h[coder.places]
                part = np.where(known, np.log10(n + alpha) - room[now], 0) + np.where(known & (before >= 0), transition[before, now], 0)
                sums = lambda x, size=b.num_rows: np.bincount(coder.rows, x, size)
                keys = at + np.arange(b.num_rows)
                at += b.num_rows
                none = {c: pa.nulls(b.num_rows, pa.int32()) for c in ("pos", "other", "before", "after")}
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "word": pa.nulls(b.num_rows, pa.string()), **none, "doc_id": b.column(0).cast(pa.int64()), "n_tokens": pa.array((coder.n_words + 1).astype(np.int64)), "n_known": pa.array(sums(known & (n > 0)).astype(np.int64)), "base": pa.array(sums(np.where(known, np.log10(n + 1.0), 0) - base_room)), "score": pa.array(sums(part))})
                rows = coder.tail(keys)
                if size := len(rows["key"]):
                    yield pa.RecordBatch.from_pydict(rows | {c: pa.nulls(size, pa.int64()) for c in ("doc_id", "n_tokens", "n_known")} | {c: pa.nulls(size, pa.float64()) for c in ("base", "score")})

    def steps(before: pa.Array, now: pa.Array, after: pa.Array) -> pa.Array:
        a, b, c = (np.asarray(x).astype(np.int64) for x in (before, now, after))
        return pa.array(transition[a, b] - room[b] + np.where(c >= 0, transition[b, c], 0))

    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(local, TAIL + ", doc_id long, n_tokens long, n_known long, base double, score double"))
    rare = placed(rows.where(F.col("word").isNotNull()), counts).withColumn("step", F.arrow_udf(steps, "double")("before", "class", "after"))
    n = F.col("n")
    rare = rare.select("key", (n > 0).cast("long").alias("n_known"), F.log10(n + 1.0).alias("base"), (F.col("step") + F.log10(n + F.lit(alpha))).alias("score"))
    rare = rare.groupBy("key").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("n_known", "base", "score")])
    out = rows.where(F.col("word").isNull()).join(rare, "key", "left")
    add = lambda c: (F.col(c) + F.coalesce(F.col(f"rare_{c}"), F.lit(0))).alias({"base": "base_score"}.get(c, c))
    return out.select("doc_id", "n_tokens", add("n_known"), add("base"), add("score"))
