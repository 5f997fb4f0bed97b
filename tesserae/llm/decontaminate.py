"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items become hashes; windows of MIN_MATCH words that a document shares with an item are
the seeds that join the two. For each document and item with a seed, the longest common stretch of unmarked words is
marked in both, again and again, until none of MIN_MATCH words is left; the tiles don't overlap and may lie in any order,
so reordered passages count in full. The longest length is found by running Karp-Rabin over prefix hashes, halving the
range of lengths, so repetitive texts take no more than their words times a logarithm for each length that has tiles.
Coverage is the share of the item's words under tiles.

The benchmark's distinct texts are dealt into blocks of BLOCK_BYTES; each block is broadcast and all documents are scanned
against it, so memory stays bounded whatever the benchmark's size. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, worker_cache, written
from .shingles import window_hashes, word_hashes

MIN_MATCH = 5
COVERAGE = 0.6
BLOCK_BYTES = 4 << 20
BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, n_tiles int, matched_words long, item_words long, coverage double"


class Rolling:
    """Karp-Rabin hashes of the windows of any length of a sequence of words, from prefix hashes."""

    def __init__(self, words: np.ndarray):
        self.words, self.marked = words, np.zeros(len(words) + 1, bool)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), BASE)]), dtype=np.uint64)
            # sums of word * BASE^-place: a window's, times BASE^place, doesn't depend on where it lies
            inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), np.uint64(pow(int(BASE), -1, 1 << 64)))]), dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * inverse[:-1], dtype=np.uint64)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of that size without a marked word."""
        ahead = np.flatnonzero(np.concatenate([self.marked[:-1], [True]]))  # places of marked words, and the end
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place = np.arange(n)
        place = place[ahead[np.searchsorted(ahead, place)] >= place + size]
        with np.errstate(over="ignore"):
            return place, (self.sums[place + size] - self.sums[place]) * self.powers[place]

    def free(self, at: int, size: int) -> bool:
        """Whether a window is unmarked, if no tile is shorter than it: such a tile would cover one of its ends."""
        return not (self.marked[at] or self.marked[at + size - 1])


def longest(a: Rolling, b: Rolling, k: int, most: int) -> int:
    """The greatest length from k to most of a stretch that both have unmarked, by its hash; 0: none."""
    low, high = k - 1, most
    while low < high:
        mid = (low + high + 1) // 2
        if np.isin(a.windows(mid)[1], b.windows(mid)[1]).any():
            low = mid
        else:
            high = mid - 1
    return low if low >= k else 0


def mark_all(a: Rolling, b: Rolling, size: int) -> list[tuple[int, int, int]]:
    """Marks the common stretches of that size, the greatest there is: by place in a, then in b."""
    (place_a, hash_a), (place_b, hash_b) = a.windows(size), b.windows(size)
    order = np.argsort(hash_b, kind="stable")
    hash_b, place_b = hash_b[order], place_b[order]
    low, high = np.searchsorted(hash_b, hash_a, "left"), np.searchsorted(hash_b, hash_a, "right")
    at: dict[int, int] = {}  # of each group of equal hashes in b, the first place that may be free
    out = []
    for i, lo, hi in zip(*(x[low < high].tolist() for x in (place_a, low, high)), strict=True):
        if not a.free(i, size):
            continue
        k = at.get(lo, lo)
        while k < hi:
            j = int(place_b[k])
            if not b.free(j, size):
                k += 1
                continue
            if np.array_equal(a.words[i : i + size], b.words[j : j + size]):
                a.marked[i : i + size] = True
                b.marked[j : j + size] = True
                out.append((size, i, j))
            break
        at[lo] = k
    return out


def tiles(item: np.ndarray, doc: np.ndarray, k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, place in item, place in doc), longest first, ties by place in item, then in doc."""
    a, b, out = Rolling(item), Rolling(doc), []
    most = min(len(item), len(doc))
    while size := longest(a, b, k, most):
        out += mark_all(a, b, size)
        most = size - 1  # no stretch of this size is left
    return out


def covered(places: np.ndarray, k: int) -> np.ndarray:
    """The words under windows of k words at these (ascending) places; all tiles lie there."""
    ends = np.append(places[1:], np.iinfo(np.int64).max)
    size = np.minimum(k, ends - places)
    return np.repeat(places, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def doc_tiles(item: np.ndarray, doc: np.ndarray, places: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """tiles() for a document whose seeds lie at these places: what lies between is left out."""
    at = covered(places, k)
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    wall = np.setdiff1d(np.arange(1, len(item) + 2, dtype=np.uint64), item)[0]  # no word of the item
    where = np.insert(at, cuts, -1)
    found = tiles(item, np.where(where < 0, wall, doc[where]), k)
    return [(n, i, int(where[j])) for n, i, j in found]


class Block:
    """Items' words and their seeds, for lookup; an item of fewer than k words is one seed."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int):
        words, n = word_hashes(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        self.ids, self.words, self.k = ids, [words[e - m : e] for e, m in zip(ends, n, strict=True)], k
        self.sizes = sorted({min(k, len(w)) for w in self.words} - {0})
        self.tables = {}
        for size in self.sizes:
            own = [i for i, w in enumerate(self.words) if min(k, len(w)) == size]
            seeds = [np.unique(window_hashes(self.words[i], size)) for i in own]
            keys, owner = np.concatenate(seeds), np.repeat(own, [len(s) for s in seeds])
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << BITS, bool)
            bits[keys >> np.uint64(64 - BITS)] = True
            self.tables[size] = keys[order], owner[order], bits

    def met(self, words: np.ndarray, n_words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
        """(text, item, places of its seeds in the text, words of a seed) for each item of which a text has a seed."""
        ends = np.cumsum(n_words)
        for size, (keys, owner, bits) in self.tables.items():
            windows = window_hashes(words, size)
            at = np.flatnonzero(bits[windows >> np.uint64(64 - BITS)])
            low = np.searchsorted(keys, windows[at], "left")
            some = keys[np.minimum(low, len(keys) - 1)] == windows[at]
            at = at[some]
            doc = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[doc] if len(at) else np.zeros(0, bool)
            at, doc = at[inside], doc[inside]
            for d, own in zip(*grouped(doc, at), strict=True):
                found, inverse = np.unique(windows[own], return_inverse=True)
                lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                n = hi - lo
                seed = np.repeat(np.arange(len(found)), n)
                item = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                order = np.argsort(item, kind="stable")
                for i, seeds in zip(*grouped(item[order], seed[order]), strict=True):
                    mark = np.zeros(len(found), bool)
                    mark[seeds] = True
                    yield d, i, own[mark[inverse]] - (ends[d] - n_words[d]), size


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct keys of an ascending array, and the values of each."""
    if not len(keys):
        return [], []
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first].tolist(), np.split(values, first[1:])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, k: int = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, n_tiles, matched_words, item_words, coverage) of all pairs with at least that coverage.

    Words are runs of letters, marks and digits in lower case. Null and empty texts match nothing; an item of fewer than
    k words must occur whole. Repeated rows of docs or benchmark give a row each. An empty table on either side gives an
    empty result. Only doc_id and text, item_id and text are read."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    distinct = items.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))
    size, repeated = distinct.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)) > 1).first()
    distinct = distinct.withColumn("key", F.xxhash64("text"))
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for block in range(blocks):
        rows = distinct.where(F.pmod("key", F.lit(blocks)) == block).select("item_id", "text").collect()  # BLOCK_BYTES or so
        if rows:
            part = docs.mapInArrow(scanning(spark, rows, coverage, k), "number int, " + SCHEMA)
            if repeated:  # each row of the benchmark gets its own
                same = spark.createDataFrame([(n, r["text"]) for n, r in enumerate(rows)], "number int, text string")
                each = F.broadcast(same).join(items, "text").select("number", F.col("item_id").alias("own_id"))  # BLOCK_BYTES or so
                part = part.join(each, "number").withColumn("item_id", F.col("own_id"))
            part = part.select(*[f.split()[0] for f in SCHEMA.split(", ")])
            parts.append(part if blocks == 1 else written(part))
    out = parts[0] if parts else spark.createDataFrame([], SCHEMA)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scanning(spark, rows: list, coverage: float, k: int):
    shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontaminate")
        own = Block(*shared.value, k)
        for batch in batches:
            for b in slices(batch, 1000, 1):
                words, n_words = word_hashes(b.column(1))
                ends, out = np.cumsum(n_words), []
                for d, i, places, size in own.met(words, n_words):
                    found = doc_tiles(own.words[i], words[ends[d] - n_words[d] : ends[d]], places, size)
                    matched, total = sum(n for n, _, _ in found), len(own.words[i])
                    if matched >= coverage * total - 1e-9:
                        out.append((i, b.column(0)[d].as_py(), own.ids[i], len(found), matched, total, matched / total))
                if out:
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                    names = ["number", "doc_id", "item_id", "n_tiles", "matched_words", "item_words", "coverage"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        give_back()

    return scan


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, k: int = MIN_MATCH) -> DataFrame:
    """The rows of docs that cover no item; their columns unchanged. Rows without doc_id stay."""
    lost = written(contaminated(docs, benchmark, coverage, k).select(F.col("doc_id").alias("_lost")).distinct())
    return docs.join(lost, F.col("doc_id").cast("long") == F.col("_lost"), "left_anti")
