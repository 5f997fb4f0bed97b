"""SentencePiece encoding and decoding by a max-plus scan over the piece lattice.

The model is of BPE type: its encoding is the one path through the lattice of pieces on which every two neighbours are
compatible, that is, merging their joined text gives back just the two. So the lattice's weights are 0 (compatible) and
minus infinity, and the path of greatest weight is the library's encoding, for any text.

Short texts: words are looked up or run through the lattice one by one, as no piece holds a space behind a letter.
Giant texts: cut into chunks of CHUNK characters at fixed places. A boundary state is a piece that ends at most
MAX_PIECE - 1 characters before the boundary, such that the next piece crosses it. Each chunk yields the max-plus matrix
from the states at its start to those at its end; the matrices are multiplied in a tree with a fan-in of FAN_IN, whose
way down gives the state at every boundary; then each chunk is traced back on its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, give_back, slices, small_batches, worker_cache, written
from .words import WordTable

SPACE = "▁"
CHUNK = 16384
#: Texts of more characters are cut into chunks.
GIANT = 4 * CHUNK
#: Chunks of a task, and matrices that a task multiplies.
TASK_CHUNKS, FAN_IN = 8, 16
#: Bytes of words and their ids that a worker keeps.
CACHE_BYTES = 32 << 20
NEVER = -np.inf
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
INFINITE = float("inf")


class Lattice:
    """Pieces of a model, and which of them may follow each other. Unknown characters count as pieces of their own,
    numbered below zero by code point."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = {int(self.texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.rank = {self.texts[i]: -sp.get_score(i) for i in plain}
        self.id_of = {self.texts[i]: i for i in plain}
        self.longest = max(map(len, self.rank))
        self.parts: dict[str, tuple[str, str]] = {}
        self.whole = {t: i for t, i in self.id_of.items() if self.merge(t) == [t]}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.raw = [t.replace(SPACE, " ").encode() for t in self.texts]
        for value, i in self.byte_ids.items():
            self.raw[i] = bytes([value])
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                self.raw[i] = b""

    def merge(self, text: str) -> list[str]:
        """The merges as defined: always the best pair, the leftmost of equals. Notes how each whole piece was made."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, INFINITE) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == INFINITE:
                break
            k = ranks.index(best)
            if len(parts) == 2:
                self.parts[text] = (parts[0], parts[1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the joined text never cross the seam of pieces a and b."""
        if a < 0 or b < 0:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 100_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.seam(self.texts[a], self.texts[b])
        return known

    def seam(self, a: str, b: str) -> bool:
        if SPACE * 2 in (a[:2], b[:2]) or (a == SPACE and b[:1] == SPACE):
            return self.merge(a + b) == [a, b]  # runs of spaces have equal scores
        if b[0] == SPACE:
            return True
        left, right = [a], [b]  # the parts that touch the seam, from the whole piece to one character
        while len(left[-1]) > 1:
            left.append(self.parts[left[-1]][1])
        while len(right[-1]) > 1:
            right.append(self.parts[right[-1]][0])
        x, y = len(left) - 1, len(right) - 1
        while True:
            across = self.rank.get(left[x] + right[y], INFINITE)
            next_x = self.rank[left[x - 1]] if x else INFINITE
            next_y = self.rank[right[y - 1]] if y else INFINITE
            if across < next_x and across <= next_y:
                return False
            if next_x == next_y == INFINITE:
                return True
            if next_x <= next_y:
                x -= 1
            else:
                y -= 1

    def extend(self, text: str, last: list, j: int, floor: int) -> int | None:
        """The piece that ends at j after a compatible one that ends at its start (last), which is at least floor."""
        whole, known = self.whole, self.pairs
        for i in range(j - 1, max(floor, j - self.longest) - 1, -1):
            before = last[i]
            if before is None:
                continue
            piece = whole.get(text[i:j])
            if piece is None:
                if i == j - 1 and text[i] not in self.id_of:
                    return -1 - ord(text[i])
                continue
            if before == "start":
                return piece
            ok = known.get((before, piece))
            if ok or (ok is None and self.compatible(before, piece)):
                return piece
        return None

    def word(self, text: str) -> list[int]:
        """The encoding of a text by one pass through its lattice."""
        if (piece := self.whole.get(text)) is not None:
            return [piece]
        last: list = ["start", *[None] * len(text)]
        for j in range(1, len(text) + 1):
            last[j] = self.extend(text, last, j, 0)
        return self.trace(last, text, len(text), 0)

    def length(self, piece: int) -> int:
        return 1 if piece < 0 else len(self.texts[piece])

    def trace(self, last: list, text: str, end: int, start: int) -> list[int]:
        """The pieces from start to end, unknown characters as bytes."""
        path = []
        while end > start:
            path.append(last[end])
            end -= self.length(last[end])
        return self.expand(path[::-1])

    def expand(self, path: list[int]) -> list[int]:
        if not path or min(path) >= 0:
            return path
        return [i for p in path for i in ([p] if p >= 0 else [self.byte_ids[b] for b in chr(-1 - p).encode()])]

    # --- chunks of giant texts ---

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Boundary states (place, piece): every piece that ends in the MAX_PIECE - 1 places up to at."""
        out = []
        for e in range(max(1, at - self.longest + 1), at + 1):
            for i in range(max(0, e - self.longest), e):
                piece = self.whole.get(text[i:e])
                if piece is not None:
                    out.append((e, piece))
            if text[e - 1] not in self.id_of:
                out.append((e, -ord(text[e - 1]) - 1))
        return out

    def runs(self, text: str, begin: int, end: int, starts: list) -> list[tuple[list[int], list]]:
        """For the start states (None: the text's start) the pieces that end at each place from begin to end.

        Returns (states, last) groups; states whose last MAX_PIECE places agree are run on as one."""
        width = self.longest
        groups = []
        for k, s in enumerate(starts):
            last: list = [None] * (end + 1)
            first = 0
            if s is None:
                last[0] = "start"
            else:
                first = s[0]
                last[first] = s[1]
            groups.append(([k], last, first))
        j = begin + 1
        while j <= end:
            stop = min(end, j + 2 * width - 1)
            for _, last, first in groups:
                for p in range(j, stop + 1):
                    last[p] = self.extend(text, last, p, first)
            j = stop + 1
            merged: dict = {}
            for own, last, first in groups:
                tail = tuple(last[stop - width + 1 : stop + 1])
                if tail in merged and stop - begin >= 2 * width:
                    merged[tail][0].extend(own)
                else:
                    merged[tail if stop - begin >= 2 * width else (id(last),)] = (own, last, first)
            groups = list(merged.values())
        return [(own, last) for own, last, _ in groups]

    def transfer(self, text: str, begin: int, end: int, is_first: bool, is_last: bool) -> np.ndarray:
        """The max-plus matrix of a chunk: 0 where an end state can be reached from a start state, else minus infinity."""
        starts = [None] if is_first else self.states(text, begin)
        ends = [(end, None)] if is_last else self.states(text, end)
        out = np.full((len(starts), len(ends)), NEVER)
        for own, last in self.runs(text, begin, end, starts):
            hit = [k for k, (e, piece) in enumerate(ends) if (e > begin and last[e] is not None and (piece is None or last[e] == piece))]
            for s in own:
                out[s, hit] = 0.0
        return out

    def backtrace(self, text: str, begin: int, end: int, start: tuple[int, int] | None, stop: tuple[int, int]) -> list[int]:
        """The chunk's pieces between two boundary states."""
        (_, last), = self.runs(text, begin, end, [start])
        return self.trace(last, text, stop[0], start[0] if start else 0)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices of 0 and minus infinity: 0 where a way leads through."""
    return np.where((a == 0).astype(np.float32) @ (b == 0).astype(np.float32) > 0, 0.0, NEVER)


def boundary_choice(matrices: list[np.ndarray], start: int = 0, end: int = 0) -> list[int]:
    """The state at the end of every matrix on the best path from a start state to an end state."""
    rest = [matrices[-1][:, [end]]]
    for m in reversed(matrices[1:-1]):
        rest.append(combine(m, rest[-1]))
    rest.reverse()
    at, out = start, []
    for m, after in zip(matrices[:-1], rest, strict=False):
        at = int(np.argmax(m[at] + after[:, 0]))
        out.append(at)
    return [*out, end]


def lattice(model_path: str) -> Lattice:
    cache = worker_cache("sentencepiece")
    if ("lattice", model_path) not in cache:
        cache["lattice", model_path] = Lattice(model_path)
    return cache["lattice", model_path]


class PairTable:
    """Open-addressed table of piece pairs and whether they are compatible, looked up for whole arrays."""

    BITS = 21

    def __init__(self, lat: Lattice):
        self.lat = lat
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.used = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, bool), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or the free place where it belongs."""
        with np.errstate(over="ignore"):
            at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            here = self.keys[at[open_]]
            open_ = open_[(here != keys[open_]) & (here != -1)]
        return at

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 16) | b
        at = self.slots(keys)
        missing = self.keys[at] == -1
        if missing.any():
            new = np.unique(keys[missing])
            if self.used + len(new) > (1 << self.BITS) // 2:
                self.clear()
            texts = self.lat.texts
            values = np.array([self.lat.seam(texts[k >> 16], texts[k & 0xFFFF]) for k in new.tolist()])
            self.used += len(new)
            while len(new):  # keys that meet in one place take turns
                slot, first = np.unique(self.slots(new), return_index=True)
                self.keys[slot], self.values[slot] = new[first], values[first]
                rest = np.ones(len(new), bool)
                rest[first] = False
                new, values = new[rest], values[rest]
            at = self.slots(keys)
        return self.values[at]


class BatchLattice:
    """The lattice pass of many words at once: place by place, piece length by piece length."""

    WIDEST = 32
    BASE = np.uint64(0x100000001B3)

    def __init__(self, lat: Lattice):
        self.lat, self.pairs = lat, PairTable(lat)
        texts = list(lat.whole)
        chars, sizes = self.matrix(texts)
        hashes = self.prefix_hashes(chars)[np.arange(len(texts)), sizes]
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([lat.whole[t] for t in texts], np.int32)[order]
        # of each value of the highest 20 bits, the first hash that has it
        self.first = np.searchsorted(self.hashes, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.first[-1] = len(self.hashes)
        self.most = int(np.diff(self.first).max(initial=0))
        self.unknown = len(lat.texts)
        self.lengths = np.array([*map(len, lat.texts), 1], np.int64)

    @staticmethod
    def matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.zeros((len(words), int(sizes.max(initial=1))), np.uint32)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return out, sizes

    def prefix_hashes(self, chars: np.ndarray) -> np.ndarray:
        out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(chars.shape[1]):
                c = (chars[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                out[:, j + 1] = (out[:, j] + (c ^ (c >> np.uint64(29)))) * self.BASE
        return out

    def piece(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for others."""
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes >> np.uint64(44)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            here = at[left]
            hit = self.hashes[here] == hashes[left]
            out[left[hit]] = self.ids[here[hit]]
            at[left] += 1
            left = left[~hit & (here + 1 < end[left])]
            if not len(left):
                break
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes and starts of the words' encodings, and the ids they point to."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        wide = order[: np.searchsorted(-lengths[order], -self.WIDEST, "left")]
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, total = [np.zeros(0, np.int32)], 0
        for i in wide.tolist():
            parts.append(np.array(self.lat.word(words[i]), np.int32))
            sizes[i], starts[i] = len(parts[-1]), total
            total += len(parts[-1])
        for k in range(len(wide), len(order), 20_000):
            rows = order[k : k + 20_000]
            n, ids = self.group([words[i] for i in rows.tolist()])
            sizes[rows], starts[rows] = n, total + np.cumsum(n) - n
            parts.append(ids)
            total += len(ids)
        return sizes, starts, np.concatenate(parts)

    def group(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, word after word, of words of at most WIDEST characters, longest first."""
        chars, sizes = self.matrix(words)
        h = self.prefix_hashes(chars)
        n, width = chars.shape
        last = np.full((n, width + 1), -2, np.int32)
        last[:, 0] = -1
        powers = [np.uint64(pow(int(self.BASE), k, 1 << 64)) for k in range(self.lat.longest + 1)]
        with np.errstate(over="ignore"):
            for j in range(1, width + 1):
                left = np.arange(np.searchsorted(-sizes, -j, "right"))
                for k in range(1, min(j, self.lat.longest) + 1):
                    before = last[left, j - k]
                    rows = left[before != -2]
                    if not len(rows):
                        continue
                    before = before[before != -2]
                    found = self.piece(h[rows, j] - h[rows, j - k] * powers[k])
                    if k == 1:
                        found[found < 0] = self.unknown  # every known character is a piece
                    real = found >= 0
                    rows, before, found = rows[real], before[real], found[real]
                    good = (before == -1) | (before == self.unknown) | (found == self.unknown)
                    check = ~good
                    good[check] = self.pairs.compatible(before[check], found[check])
                    last[rows[good], j] = found[good]
                    left = left[last[left, j] == -2]
                    if not len(left):
                        break
        at, steps = sizes.copy(), []
        open_ = np.flatnonzero(at > 0)
        while len(open_):
            piece = last[open_, at[open_]]
            steps.append((open_, piece))
            at[open_] -= self.lengths[piece]
            open_ = open_[at[open_] > 0]
        rows, pieces = (np.concatenate([x[k] for x in steps]) for k in (0, 1))
        place = np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps])
        by = np.lexsort((-place, rows))
        rows, pieces = rows[by], pieces[by]
        odd = np.flatnonzero(pieces == self.unknown)
        if len(odd):  # their characters become bytes
            ends = np.cumsum(self.lengths[pieces])
            before = np.concatenate([[0], np.cumsum(sizes)])
            codes = chars[rows[odd], ends[odd] - 1 - before[rows[odd]]]
            spelled = {c: [self.lat.byte_ids[x] for x in chr(c).encode()] for c in np.unique(codes).tolist()}
            times = np.ones(len(pieces), np.int64)
            times[odd] = [len(spelled[c]) for c in codes.tolist()]
            rows, pieces = np.repeat(rows, times), np.repeat(pieces, times)
            pieces[pieces == self.unknown] = [x for c in codes.tolist() for x in spelled[c]]
        return np.bincount(rows, minlength=n), pieces.astype(np.int32)


class WordEncoder:
    """Encodes batches of texts, each distinct word once as long as the cache has room. A word is kept without the space
    in front that every word has; words and their ids stay in Arrow and numpy arrays."""

    def __init__(self, lat: Lattice):
        self.batch = BatchLattice(lat)
        self.reset()

    def reset(self) -> None:
        self.known, self.offsets, self.ids = WordTable(), np.zeros(1, np.int32), np.zeros(0, np.int32)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The words' places in offsets; new ones are encoded."""
        coded = words.dictionary_encode()
        out = self.known.find(coded.dictionary)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = coded.dictionary.take(pa.array(missing))
            sizes, starts, ids = self.batch.encode([SPACE + w for w in new.to_pylist()])
            order = np.argsort(starts, kind="stable")  # of their ids; no word is without one
            out[missing[order]] = len(self.offsets) - 1 + np.arange(len(new))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes[order])]).astype(np.int32)
            self.ids = np.concatenate([self.ids, ids])
            self.known.add(new, out[missing])
        return out[np.asarray(coded.indices)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Lists of ids; a null text counts as empty."""
        if self.known.nbytes + self.offsets.nbytes + self.ids.nbytes > CACHE_BYTES:
            self.reset()
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, SPACE), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, "")))))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        # runs of spaces are cut with care
        rows = [[w[1:] for w in WORDS.findall(SPACE + t.replace(" ", SPACE))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        n_words = np.concatenate([pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(r) for r in rows], np.int64)])
        at = self.numbers(pa.concat_arrays([parts.flatten(), pa.array([w for r in rows for w in r], pa.string())]))
        taken = pa.ListArray.from_arrays(pa.array(self.offsets), pa.array(self.ids)).take(pa.array(at))
        ends = np.asarray(taken.offsets)[np.concatenate([[0], np.cumsum(n_words)])]
        out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), taken.values)
        return out.take(pa.array(np.argsort(np.argsort(odd, kind="stable")))) if odd.any() else out


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """docs with out_col, the ids of the pieces of text_col, as the library gives them (with its leading space).

    A null or empty text has no pieces. Repeated rows are encoded each; other columns pass through (a column named
    out_col is replaced); an empty table gives an empty table."""
    docs = docs.drop(out_col)
    small_batches(docs.sparkSession)
    size = F.coalesce(F.length(text_col), F.lit(0))

    def small(texts: pa.Array) -> pa.Array:
        cache, lat = worker_cache("sentencepiece"), lattice(model_path)
        if ("words", model_path) not in cache:
            cache["words", model_path] = WordEncoder(lat)
        encoder = cache["words", model_path]
        parts = [encoder.encode(part) for part in slices(texts, 4000, size_bytes=2 * SLICE_BYTES)]
        give_back(collect=False)
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    short = docs.where(size <= GIANT).withColumn(out_col, F.arrow_udf(small, "array<int>")(text_col))
    giants = written(docs.where(size > GIANT).withColumn("_key", F.monotonically_increasing_id()))
    if giants.isEmpty():
        return short
    return short.unionByName(encode_giants(giants, model_path, text_col, out_col))


def encode_giants(giants: DataFrame, model_path: str, text_col: str, out_col: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = SPACE + text.replace(" ", SPACE)
                n = max(1, len(text) // CHUNK)
                for k in range(n):
                    begin, end = k * CHUNK, len(text) if k == n - 1 else (k + 1) * CHUNK
                    low = max(0, begin - 64)  # room for the states before the start
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "chunk": pa.array([k], pa.int32()), "last": [k == n - 1], "begin": pa.array([begin - low], pa.int32()), "part": [text[low:end]]})

    chunks = written(giants.select("_key", text_col).mapInArrow(cut, "key long, chunk int, last boolean, begin int, part string"))
    n_chunks, last = chunks.agg(F.count("*"), F.max("chunk")).first()
    tasks = max(1, min(-(-n_chunks // TASK_CHUNKS), 16 * int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    chunks = chunks.repartition(tasks, "key", "chunk")  # the number is given, so small rows are not put together again

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path)
        for b in batches:
            for r in b.to_pylist():
                m = lat.transfer(r["part"], r["begin"], len(r["part"]), r["chunk"] == 0, r["last"])
                yield pa.RecordBatch.from_pylist([{"key": r["key"], "node": r["chunk"]} | packed_matrix(m)], pa.schema([("key", pa.int64()), ("node", pa.int32()), *MATRIX]))
        give_back()

    chosen = tree_choice(written(chunks.mapInArrow(transfers, f"key long, node int, {MATRIX_DDL}")), last)
    chosen = chosen.withColumnRenamed("node", "chunk")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path)
        for b in batches:
            for r in b.to_pylist():
                part, begin, end = r["part"], r["begin"], len(r["part"])
                start = None if r["chunk"] == 0 else lat.states(part, begin)[r["start_state"]]
                stop = (end, 0) if r["last"] else lat.states(part, end)[r["end_state"]]
                ids = lat.backtrace(part, begin, end, start, stop)
                yield pa.RecordBatch.from_pydict({"key": pa.array([r["key"]], pa.int64()), "chunk": pa.array([r["chunk"]], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int32()))})
        give_back()

    traced = chunks.join(chosen, ["key", "chunk"]).mapInArrow(trace, "key long, chunk int, ids array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda c: c["ids"])).alias(out_col))
    return giants.join(whole, giants["_key"] == whole["key"]).drop("_key", "key")


MATRIX = [("height", pa.int32()), ("width", pa.int32()), ("reach", pa.binary())]
MATRIX_DDL = "height int, width int, reach binary"


def packed_matrix(m: np.ndarray) -> dict:
    return {"height": m.shape[0], "width": m.shape[1], "reach": zlib.compress(np.packbits(m == 0).tobytes())}


def unpacked(t: pa.Table) -> list[np.ndarray]:
    out = []
    for h, w, raw in zip(*(t.column(c).to_pylist() for c, _ in MATRIX), strict=True):
        bits = np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8), count=h * w).reshape(h, w)
        out.append(np.where(bits == 1, 0.0, NEVER))
    return out


def tree_choice(matrices: DataFrame, last: int) -> DataFrame:
    """(key, node, start_state, end_state) on the best path of each key, from the matrices of its nodes 0 .. last at most.

    Up: the matrices of FAN_IN neighbours are multiplied, level by level, until one is left for each key. Down: between a
    parent's states those of its children are chosen. A task never holds more than FAN_IN matrices of a key."""
    levels = [matrices]
    up = F.floor(F.col("node") / FAN_IN).cast("int")

    def multiply(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        out = reduce(combine, unpacked(t))
        row = {"key": t.column("key")[0].as_py(), "node": t.column("parent")[0].as_py()} | packed_matrix(out)
        return pa.Table.from_pylist([row], pa.schema([("key", pa.int64()), ("node", pa.int32()), *MATRIX]))

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        start, end = t.column("start_state")[0].as_py(), t.column("end_state")[0].as_py()
        ends = boundary_choice(unpacked(t), start, end)
        return pa.table({"key": t.column("key"), "node": t.column("node"), "start_state": pa.array([start, *ends[:-1]], pa.int32()), "end_state": pa.array(ends, pa.int32())})

    while last:
        below = levels[-1].withColumn("parent", up)
        levels.append(written(below.groupBy("key", "parent").applyInArrow(multiply, f"key long, node int, {MATRIX_DDL}")))
        last //= FAN_IN
    states = levels.pop().select("key", "node", F.lit(0).alias("start_state"), F.lit(0).alias("end_state"))
    while levels:
        parents = states.withColumnRenamed("node", "parent")
        below = levels.pop().withColumn("parent", up).join(parents, ["key", "parent"])
        states = written(below.groupBy("key", "parent").applyInArrow(choose, "key long, node int, start_state int, end_state int"))
    return states


def decode(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col, the text of the pieces: every list decodes on its own, bytes back to characters, less the
    leading space. A null or empty list gives the empty text; bytes that are no UTF-8 become U+FFFD."""

    def f(lists: pa.Array) -> pa.Array:
        raw = lattice(model_path).raw
        sizes, flat = np.array([len(x) for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(sizes) - sizes
        out: list[str] = []
        for k in range(0, len(lists), 200):
            part = lists.slice(k, 200)
            n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.asarray(part.flatten()).astype(np.int64)
            size = sizes[ids]
            total = np.concatenate([[0], np.cumsum(size)])
            data = flat[np.repeat(starts[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
            ends = total[np.concatenate([[0], np.cumsum(n)])]
            out += [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.array([t[1:] if t[:1] == " " else t for t in out], pa.string())

    return rows.withColumn(out_col, F.arrow_udf(f, "string")(ids_col))
