"""Line dedup: two Bloom filters find lines seen in one and in two documents; only suspected repeats are shuffled.

Pass 1 keeps, per task, the bits of the line hashes seen in one document (``once``) and in two (``twice``).
Tasks emit the bits by segment of the bit space; segments are merged in a tree with a fan-in of 64
(twice |= once & once'), so no task holds more than 64 slices of one segment. Pass 2 probes ``twice`` and emits
only suspected lines; their text is grouped exactly. Pass 3 drops the confirmed lines. The filters grow with the
number of lines; beyond PASS_BITS the hash space is split and each part has filters and passes of its own, so a
task's memory stays the same and the filters never fill up. False positives only mean more suspects.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, give_back, join_counted, slices, small_batches, worker_cache, written

BLANK = b" \t\n\x0b\x0c\r"
SEGMENTS = 64
FAN_IN = 64
PROBES = 4
#: Bits of a filter for each key, and of one pass at most (32 MB); more keys take more passes.
BITS_PER_KEY = 8
PASS_BITS = 1 << 28


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower() folds A-Z only


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def doc_keys(raw: bytes, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that are long enough to count."""
    return {k for line in raw.split(b"\n") if len(line) >= min_chars and code_points(k := line_key(line)) >= min_chars}


def digests_of(keys: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two numbers; the first one serves the filters."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each 64-bit hash, by double hashing; bits is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (low + steps * high) & np.uint64(bits - 1)


def pack(bitmap: np.ndarray) -> bytes:
    return zlib.compress(bitmap.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8)


def bitmap(points: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[points] = True
    return np.packbits(out, bitorder="little")


def filter_bits(docs: DataFrame, min_chars: int) -> tuple[int, int]:
    """Bits of the filter of a pass and the number of passes, both powers of two, from the number of long lines."""
    # no more than the text has room for, nor than it has lines
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n = docs.where(F.length("text") >= min_chars).agg(F.coalesce(F.sum(F.least(lines, F.floor(F.length("text") / min_chars))), F.lit(0))).first()[0]
    bits = 1 << max(20, (BITS_PER_KEY * int(n)).bit_length())
    return min(bits, PASS_BITS), max(1, bits // PASS_BITS)


def of_pass(hashes: np.ndarray, number: int, passes: int) -> np.ndarray:
    """Places of the hashes that belong to a pass: their highest bits are its number."""
    return np.arange(len(hashes)) if passes == 1 else np.flatnonzero(hashes >> np.uint64(65 - passes.bit_length()) == number)


def twice_filter(docs: DataFrame, min_chars: int, bits: int, number: int = 0, passes: int = 1) -> np.ndarray:
    segment = bits // SEGMENTS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_cache("lines")
        seen: list[np.ndarray] = []
        at = TaskContext.get().partitionId()

        def emit() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            once = np.unique(positions(values, bits))
            twice = np.unique(positions(values[counts > 1], bits))
            for k in range(SEGMENTS):
                lo, hi = np.uint64(k * segment), np.uint64((k + 1) * segment)
                a = once[np.searchsorted(once, lo) : np.searchsorted(once, hi)] - lo
                b = twice[np.searchsorted(twice, lo) : np.searchsorted(twice, hi)] - lo
                if len(a):
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "node": pa.array([at], pa.int64()), "once": [pack(bitmap(a, segment))], "twice": [pack(bitmap(b, segment))]})

        for batch in batches:
            for part in slices(batch, 2000):
                found = digests_of([k for t in part.column(0).cast(pa.binary()).to_pylist() if t for k in doc_keys(t, min_chars)])[:, 0]
                seen.append(found[of_pass(found, number, passes)])
                if sum(map(len, seen)) > 1_000_000:
                    yield from emit()
                    seen.clear()
        if seen:
            yield from emit()
            seen.clear()
        give_back()

    def merge(pdf):
        import pandas as pd

        once, twice = np.zeros(segment // 8, np.uint8), np.zeros(segment // 8, np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            new = unpack(a)
            twice |= unpack(b) | (once & new)
            once |= new
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "node": [pdf["node"].iloc[0]], "once": [pack(once)], "twice": [pack(twice)]})

    schema = "segment int, node long, once binary, twice binary"
    source = docs.select("text")
    parts, tree = source.rdd.getNumPartitions(), source.mapInArrow(local, schema)
    while True:
        tree = tree.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("segment", "node").applyInPandas(merge, schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    out = np.zeros(bits // 8, np.uint8)
    for row in tree.select("segment", "twice").collect():  # SEGMENTS rows, bits / 8 bytes in all
        out[row["segment"] * segment // 8 : (row["segment"] + 1) * segment // 8] = unpack(row["twice"])
    return out


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, key) of the suspected lines, and (digest, keep_doc, n) of the confirmed ones; n: the rows of
    the suspects that have it."""
    spark = docs.sparkSession
    small_batches(spark)
    bits, passes = filter_bits(docs, min_chars)
    found = None
    for number in range(passes):
        part = written(suspected(docs, min_chars, twice_filter(docs, min_chars, bits, number, passes), bits, number, passes))
        found = part if found is None else found.unionByName(part)
    in_docs = found.groupBy("key", "doc_id").agg(F.any_value("digest").alias("digest"), F.count("*").alias("n"))
    confirmed = in_docs.groupBy("key").agg(F.any_value("digest").alias("digest"), F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc"), F.sum("n").alias("n"))
    return found, written(confirmed.where(F.col("n_docs") >= min_docs).select("digest", "keep_doc", "n"))


def suspected(docs: DataFrame, min_chars: int, twice: np.ndarray, bits: int, number: int, passes: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(twice.tobytes())  # PASS_BITS / 8 bytes at most

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("lines")
        seen = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part in slices(batch, 2000, 1):
                ids, keys = [], []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if t and doc is not None:
                        own = doc_keys(t, min_chars)
                        ids += [doc] * len(own)
                        keys += own
                if not keys:
                    continue
                digests = digests_of(keys)
                mine = of_pass(digests[:, 0], number, passes)
                at = positions(digests[mine, 0], bits)
                hit = mine[((seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[i] for i in hit], pa.int64()), "digest": pa.array([x.tobytes() for x in digests[hit]], pa.binary()), "key": pa.array([keys[i] for i in hit], pa.binary())})
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(probe, "doc_id long, digest binary, key binary")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of docs with repeated lines removed from ``text``; adds ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least min_chars
    code points that at least min_docs documents hold lose all their lines but those in the largest doc_id.
    A null text counts as one empty line and becomes the empty text. Rows of one doc_id count as one document; a row
    without doc_id loses nothing. An empty table gives an empty table. Other columns pass through; columns named n_lines
    and n_dropped are replaced.
    """
    suspects, confirmed = repeated_lines(docs, min_chars, min_docs)
    # texts stay behind: digests alone are joined, and a line that many documents hold is joined where its rows are
    lost = join_counted(suspects.select("doc_id", "digest"), confirmed, "digest", suspects.count()).where("doc_id <> keep_doc")
    lost = written(lost.groupBy(F.col("doc_id").alias("_drop_doc")).agg(F.collect_set("digest").alias("_drop_keys")))
    n = lost.agg(F.count("*"), F.coalesce(F.sum(F.size("_drop_keys")), F.lit(0))).first()
    lost = broadcast_below(lost, n[0] * 2 + n[1], 500_000)  # 16 bytes each, so at most some 10 MB

    def cut(text: pa.Array, drop: pa.Array) -> pa.Array:
        worker_cache("lines")
        parts, at = [], 0
        for part in slices(text, 2000):
            parts.append(cut_slice(part, drop.slice(at, len(part))))
            at += len(part)
        return pa.concat_arrays(parts) if parts else cut_slice(text, drop)

    def cut_slice(text: pa.Array, drop: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for t, d in zip(text.cast(pa.binary()).to_pylist(), drop.to_pylist(), strict=True):
            lines = (t or b"").split(b"\n")
            n_lines.append(len(lines))
            if d:
                d = set(d)
                left = [x for x in lines if len(x) < min_chars or code_points(k := line_key(x)) < min_chars or xxhash.xxh3_128_digest(k) not in d]
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            else:
                n_dropped.append(0)
                kept.append(t or b"")
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    cut_udf = F.arrow_udf(cut, "text string, n_lines long, n_dropped long")
    out = docs.join(lost, docs["doc_id"].cast("long") == lost["_drop_doc"], "left")
    out = out.withColumn("_cut", cut_udf("text", "_drop_keys"))
    rest = [F.col("_cut.text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*rest, F.col("_cut.n_lines").alias("n_lines"), F.col("_cut.n_dropped").alias("n_dropped"))
