"""Token files: documents are tokenized, the ids written by a static range asymmetric numeral system, and read back.

File format (little-endian), one file per segment of documents in ascending doc_id order:

    magic ``TRNS0001``, crc32 of the frequency table, counts of documents and blocks     (8s I I I)
    for each document: doc_id (int64), number of ids (int64)
    for each block: header ``n_ids lanes n_words n_checkpoints crc32(payload) crc32(ids)`` (6 I), then the payload:
        start states (lanes uint64), for each checkpoint: words read so far (uint32) and states (lanes uint64),
        words (uint32)
    crc32 of all bytes before

One frequency table, scaled to 2^18, serves all files (``freqs.bin``). In a block id i belongs to lane i mod lanes;
each lane is a coder of its own (64-bit state, 32-bit words) and the lanes' words interleave in reading order, so a
block is coded lane-parallel in numpy, blocks are independent, and a reader may start at any checkpoint.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, give_back, shared_dir, slices, small_batches, worker_cache, written
from .words import WordTable

MAGIC = b"TRNS0001"
SCALE = 18
LOW = np.uint64(1 << 31)
BLOCK_IDS = 1 << 20
LANES = 2048
CHECKPOINT_STEPS = 128
SEGMENT_IDS = 1 << 22
#: What the files hold for a document without doc_id.
NO_ID = -(1 << 63)
#: Bytes of pieces and their ids that a worker keeps.
CACHE_BYTES = 160 << 20


# --- coder ---------------------------------------------------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE; every id that occurs keeps at least 1."""
    total, size = counts.sum(), 1 << SCALE
    if total == 0:
        counts, total = np.ones(1, np.int64), 1
    freqs = np.where(counts > 0, np.maximum(1, counts * size // total), 0)
    over = int(freqs.sum()) - size
    order = np.argsort(-freqs, kind="stable")
    if over < 0:
        freqs[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        cut = min(over, int(freqs[i]) - max(1, int(freqs[i]) * 3 // 4))
        freqs[i] -= cut
        over -= cut
    return freqs.astype(np.uint64)


class Tables:
    def __init__(self, freqs: np.ndarray):
        self.freqs = freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(np.uint64)
        self.symbols = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs.astype(np.int64))
        self.crc = zlib.crc32(self.freqs.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, t: Tables) -> bytes:
    n, lanes = len(ids), min(LANES, len(ids))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words, marks = [], []
    for s in range(steps - 1, -1, -1):
        part = ids[s * lanes : (s + 1) * lanes]
        x, f = state[: len(part)], t.freqs[part]
        full = x >= (f << np.uint64(63 - SCALE))
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(part)] = (q << np.uint64(SCALE)) + (x - q * f) + t.starts[part]
        if s and s % CHECKPOINT_STEPS == 0:
            marks.append((sum(map(len, words)), state.astype("<u8").tobytes()))
    total = sum(map(len, words))
    points = b"".join(struct.pack("<I", total - done) + at for done, at in reversed(marks))
    payload = state.astype("<u8").tobytes() + points + b"".join(w.tobytes() for w in reversed(words))
    return struct.pack("<6I", n, lanes, total, len(marks), zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes())) + payload


def decode_steps(state: np.ndarray, words: np.ndarray, at: int, first: int, last: int, n: int, t: Tables, out: np.ndarray) -> None:
    lanes, mask = len(state), np.uint64((1 << SCALE) - 1)
    for s in range(first, last):
        part = min(lanes, n - s * lanes)
        x = state[:part]
        slot = x & mask
        found = t.symbols[slot]
        x = t.freqs[found] * (x >> np.uint64(SCALE)) + slot - t.starts[found]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
        state[:part] = x
        out[s * lanes : s * lanes + part] = found


def decode_block(raw: memoryview, at: int, t: Tables, from_checkpoint: int | None = None) -> tuple[np.ndarray, int]:
    """The ids of the block at that offset and the next offset; from_checkpoint: only the ids from that checkpoint on."""
    n, lanes, total, marks, crc, ids_crc = struct.unpack_from("<6I", raw, at)
    begin, head, mark = at + 24, lanes * 8, 4 + lanes * 8
    end = begin + head + marks * mark + total * 4
    if zlib.crc32(raw[begin:end]) != crc:
        raise ValueError("block checksum differs")
    words = np.frombuffer(raw, "<u4", total, begin + head + marks * mark).astype(np.uint64)
    first, read, state_at = 0, 0, begin
    if from_checkpoint is not None:
        state_at = begin + head + from_checkpoint * mark + 4
        first, read = (from_checkpoint + 1) * CHECKPOINT_STEPS, struct.unpack_from("<I", raw, state_at - 4)[0]
    out = np.zeros(n, np.uint32)
    decode_steps(np.frombuffer(raw, "<u8", lanes, state_at).astype(np.uint64), words, read, first, -(-n // lanes), n, t, out)
    if from_checkpoint is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids checksum differs")
    return out[first * lanes :], end


def encode_file(doc_ids: list[int], docs: list[np.ndarray], t: Tables) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
    blocks = [encode_block(ids[i : i + BLOCK_IDS], t) for i in range(0, len(ids), BLOCK_IDS)]
    head = struct.pack("<8sIII", MAGIC, t.crc, len(docs), len(blocks))
    index = np.array([doc_ids, [len(d) for d in docs]], "<i8").T.tobytes()
    body = head + index + b"".join(blocks)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_file(raw: bytes, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, all ids."""
    raw = memoryview(raw)
    magic, table_crc, n_docs, n_blocks = struct.unpack_from("<8sIII", raw, 0)
    if magic != MAGIC or table_crc != t.crc or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a token file of this frequency table, or it is damaged")
    index = np.frombuffer(raw, "<i8", 2 * n_docs, 20).reshape(-1, 2)
    at, parts = 20 + 16 * n_docs, []
    for _ in range(n_blocks):
        ids, at = decode_block(raw, at, t)
        parts.append(ids)
    return index[:, 0], index[:, 1], np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# --- tokenizer -----------------------------------------------------------------------------------------------------

# White space as Unicode has it, which the pre-tokenizer's pattern goes by.
WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A space with white space before it and white space or the end behind it: there the pre-tokenizer doesn't cut.
JOINED = f"{WHITE} {WHITE}|{WHITE} \\z"
#: Pieces that could meet their neighbours' white space when joined to them (the empty one becomes a lone space).
ALONE = f"\\A(?:\\z|{WHITE}|[\\x1C-\\x1F])"


class PieceEncoder:
    """Encodes each distinct piece once with the library, as long as the cache has room for it.

    The byte-level pre-tokenizer cuts before every single space, so a text is the concatenation of its first piece and
    of its other pieces with their space in front; texts where that doesn't hold, or with a special token's string,
    go to the library whole. Pieces and their ids stay in Arrow and numpy arrays; pool[0] is the end."""

    def __init__(self, path: str, end_id: int = 0):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core; threads of its own cost memory and time
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocab = self.tokenizer.get_vocab()
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("token files hold ids below 65,536")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(1 << 16, bool)
        self.spaced[[i for token, i in vocab.items() if token[0] == "\u0120"]] = True  # a space's byte
        self.reset()

    def reset(self) -> None:
        self.first, self.inner = WordTable(), WordTable()
        self.offsets, self.ids = np.array([0, 1], np.int32), np.array([self.end_id], np.uint16)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of pieces that get one space in front: joined, each starts at the next id with a space."""
        groups = [" " + " ".join(pieces[i : i + 100]) for i in range(0, len(pieces), 100)]
        ids = np.concatenate([np.zeros(0, np.uint16), *self.whole(groups)])
        return np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids)), ids

    def numbers(self, known: WordTable, words: pa.Array, space: str) -> np.ndarray:
        """The words' places in the pool; new ones are encoded."""
        coded = words.dictionary_encode()
        out = known.find(coded.dictionary)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = coded.dictionary.take(pa.array(missing))
            alone = pc.match_substring_regex(new, ALONE).to_numpy(zero_copy_only=False) if space else np.ones(len(new), bool)
            together, solo = np.flatnonzero(~alone), np.flatnonzero(alone)
            sizes, ids = self.apart(new.take(pa.array(together)).to_pylist())
            lone = self.whole([space + p for p in new.take(pa.array(solo)).to_pylist()])
            out[missing[np.concatenate([together, solo])]] = len(self.offsets) - 1 + np.arange(len(new))
            sizes = np.concatenate([sizes, [len(x) for x in lone]]).astype(np.int64)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)]).astype(np.int32)
            self.ids = np.concatenate([self.ids, ids, *lone])
            known.add(new, out[missing])
        return out[np.asarray(coded.indices)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """For each text its ids and the end, as little-endian 16-bit numbers in a binary value."""
        bad = pc.match_substring_regex(texts, JOINED)
        for s in self.special:
            bad = pc.or_(bad, pc.match_substring(texts, s))
        easy = self.easy(texts.filter(pc.invert(bad)))
        if not pc.any(bad).as_py():
            return easy
        end = np.array([self.end_id], np.uint16)
        odd = [np.concatenate([x, end]).tobytes() for x in self.whole(texts.filter(bad).to_pylist())]
        order = np.argsort(bad.to_numpy(zero_copy_only=False), kind="stable")  # easy ones first
        return pa.concat_arrays([easy, pa.array(odd, pa.binary())]).take(pa.array(np.argsort(order)))

    def easy(self, texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.binary())
        if self.first.nbytes + self.inner.nbytes + self.offsets.nbytes + self.ids.nbytes > CACHE_BYTES:
            self.reset()
        parts = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
        starts, flat = np.concatenate([[0], ends[:-1]]), parts.flatten()
        inner = np.ones(len(flat), bool)
        inner[starts] = False
        at = np.zeros(len(flat) + len(texts), np.int64)  # behind each text the end, pool[0]
        room = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), ends - starts)
        at[room[starts]] = self.numbers(self.first, flat.take(pa.array(starts)), "")
        at[room[inner]] = self.numbers(self.inner, flat.filter(pa.array(inner)), " ")
        pool = pa.ListArray.from_arrays(pa.array(self.offsets), pa.array(self.ids))
        taken = pool.take(pa.array(at))
        bounds = np.asarray(taken.offsets)[np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])].astype(np.int64) * 2
        raw = np.ascontiguousarray(np.asarray(taken.values).astype("<u2", copy=False))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw)])


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, ids as little-endian uint16, counts) with the end id appended; a null text counts as empty.

    counts is null but for one row of each task, which has no ids: how often each id occurs in the task's rows (int64)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, names = worker_cache("token files"), ["doc_id", "ids", "counts"]
        if tokenizer_path not in cache:
            cache[tokenizer_path] = PieceEncoder(tokenizer_path, end_id)
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices(batch, batch.num_rows, 1, BATCH_BYTES):  # the larger, the fewer lookups
                ids = cache[tokenizer_path].encode(pc.fill_null(part.column(1), ""))
                total += np.bincount(values_of(ids), minlength=1 << 16)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.nulls(part.num_rows, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([zlib.compress(total.tobytes(), 1)])], names)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary, counts binary")


def values_of(ids: pa.Array) -> np.ndarray:
    """All 16-bit numbers of binary values, one after the other."""
    ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)
    return np.frombuffer(ids.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, int(ends[0])) if len(ids) and ends[-1] > ends[0] else np.zeros(0, np.uint16)


# --- files ---------------------------------------------------------------------------------------------------------


def put(folder: str, name: str, data: bytes) -> None:
    """Written under another name, then moved: a repeated task replaces a file by the same bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(part := posixpath.join(path, f".{name}.{uuid.uuid4().hex}")) as f:
        f.write(data)
    store.move(part, posixpath.join(path, name))


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, summed from the tasks' counts; 2^16 numbers at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(raw), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    counts = tokens.where(F.col("counts").isNotNull()).select("counts")
    for row in counts.mapInArrow(add, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_token_files(tokens: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of tokenize() in ascending doc_id order; returns the manifest (part, segment, name, n_docs, n_tokens)."""
    spark = tokens.sparkSession
    freqs = scaled(id_counts(tokens))
    put(folder, "freqs.bin", freqs.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, t = TaskContext.get().partitionId(), 0, Tables(freqs)
        doc_ids, docs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            put(folder, name := f"tokens-{part:06d}-{segment:06d}.rans", encode_file(doc_ids, docs, t))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "name": [name], "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([size], pa.int64())})

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                docs.append(np.frombuffer(raw, "<u2"))
                size += len(docs[-1])
                if size >= SEGMENT_IDS:
                    yield flush()
                    segment, size = segment + 1, 0
                    doc_ids.clear()
                    docs.clear()
        if docs:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("ids"), F.monotonically_increasing_id()]  # rows of one doc_id may go to several tasks
    named = tokens.where(F.col("ids").isNotNull()).select("doc_id", "ids", *[c.alias(f"by{k}") for k, c in enumerate(order[1:])])
    ordered = named.repartitionByRange(parts, "doc_id", "by0", "by1").sortWithinPartitions("doc_id", "by0", "by1").select("doc_id", "ids")
    return written(ordered.mapInArrow(write, "part int, segment int, name string, n_docs long, n_tokens long"))


def read_token_files(manifest: DataFrame, folder: str, row_of: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """For each document: doc_id, start (ids of all documents before it), n_tokens, and what row_of makes of its ids.

    schema: DDL of row_of's columns. Files are read by Spark and decoded in parallel, each on its own."""
    spark = manifest.sparkSession
    sums = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a number per shuffle partition
    base, begins = 0, []
    for part in sorted(sums):
        begins.append((part, base))
        base += sums[part]
    w = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = spark.createDataFrame(begins, "part int, base long")
    starts = manifest.join(F.broadcast(begins), "part").select("name", (F.col("base") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).alias("file_start"))
    freqs = spark.read.format("binaryFile").load(f"{folder}/freqs.bin").select("content").first()[0]
    extra = [x.split()[0] for x in schema.split(",")]
    full = f"doc_id long, start long, n_tokens long, {schema}"
    arrow_types = dict(zip([x.split()[0] for x in full.split(",")], [pa.int64()] * 3, strict=False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(np.frombuffer(freqs, "<u4"))
        for b in batches:
            for file_start, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, sizes, ids = decode_file(raw.as_buffer(), t)
                ends = np.cumsum(sizes)
                rows = [row_of(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
                cols = {"doc_id": pa.array(doc_ids), "start": pa.array(file_start + ends - sizes), "n_tokens": pa.array(sizes)}
                yield pa.RecordBatch.from_pydict({c: v.cast(arrow_types[c]) for c, v in cols.items()} | {c: pa.array([r[c] for r in rows]) for c in extra})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.join(starts, "name").select("file_start", "content").mapInArrow(read, full)


def token_files(docs: DataFrame, tokenizer_path: str, row_of: Callable[[np.ndarray], dict], schema: str, end_id: int = 0) -> DataFrame:
    """Tokenizes docs (doc_id, text), writes token files to the shared folder, and reads them back.

    Null and empty texts become the end id alone. Rows that share a doc_id follow each other, in the order of a hash of
    their ids; rows without doc_id come first (the files hold -2^63 for none). An empty table gives no file and no row.
    Only doc_id and text are read, so other columns don't matter. The vocabulary's ids must lie below 65,536."""
    folder = shared_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    manifest = write_token_files(written(tokenize(docs, tokenizer_path, end_id)), folder)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], f"doc_id long, start long, n_tokens long, {schema}")
    return read_token_files(manifest, folder, row_of, schema).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))
