"""Nearest neighbours by randomly rotated one-bit codes with error bounds, over coarse cells.

Index: vectors of each dimension are indexed on their own. A sample of at most SAMPLE unit vectors gives the centroids of
the cells; every row goes to the cell of its closest centroid, and a cell's radius is the largest angle between its rows
and its centroid. Cells are dealt into blocks of a bounded size; a block packs ids, codes, scalars and original vectors.
Each unit vector o is rotated by a fixed random orthogonal matrix; its code is the signs of the rotated components (D bits
in 64-bit words), with one scalar s = <code, Ro>, where code has entries +-1/sqrt(D).

Search: for a query q the inner product <o, q> is estimated by <code, Rq> / s. Rq is rounded to PLANES bits a component,
so that the sum needs only AND and popcount on packed words. The estimate is off by at most the rounding (a fixed bound)
and, with probability about 1 - 2 exp(-c * EPSILON^2), by sqrt((1 - s^2) / s^2) * EPSILON / sqrt(D - 1). Rows whose upper
bound lies below the k-th best score known are dropped. Only the others' original vectors are read, in single precision
first; for the few that can still be among the k best the exact cosine in double precision is taken.

First each query is compared with its own cell, then with every cell that can hold a nearer row: one whose centroid's
angle less its radius is small enough. The index's blocks are dealt over parts. Queries are packed into decks, and a deck
goes once to each part that holds a cell one of its queries needs, not once to each block: what is shuffled is the index
and, for each part, the queries. A merge join streams a part's blocks past the decks, one pair at a time. Neither the
driver nor the plan grows with the queries; each pair returns k rows for each query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

EPSILON = 4.0
PLANES = 6
#: How far a cosine in single precision may be off.
ROUGH = 1e-4
#: Rows, and bytes of them, that the centroids of one dimension are fitted on (bounds in expectation by the hash of vec_id,
#: and twice that at most).
SAMPLE, SAMPLE_BYTES = 16384, 16 << 20
MAX_CELLS = 1024
#: Bounds of a block of the index and of a deck of queries.
BLOCK_ROWS, BLOCK_BYTES, QUERY_ROWS = 8192, 4 << 20, 1024
#: The fewest parts, and the most blocks in one of more parts; bytes of queries that a merge join holds for one part.
LEAST_PARTS, PART_BLOCKS, WAVE_BYTES = 32, 128, 128 << 20
ROWS = "dim int, cell int, angle double, vec_id long, vector binary, code binary, scalar double"
BLOCKS = "dim int, cell int, part int, ids binary, codes binary, scalars binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the last one filled up with zeros."""
    raw = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<u8")


def encode_codes(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and scalars of unit vectors."""
    turned = units @ turn.T
    return packed_words(turned >= 0), np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])


def error_bound(scalars: np.ndarray, dim: int, epsilon: float) -> np.ndarray:
    return np.sqrt(np.maximum(0, 1 - scalars**2)) / scalars * epsilon / np.sqrt(max(1, dim - 1)) + 1e-5


class Queries:
    """Rotated unit vectors, rounded to PLANES bits for each component."""

    def __init__(self, units: np.ndarray, turn: np.ndarray):
        turned = units @ turn.T
        self.dim = units.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-12) / ((1 << PLANES) - 1)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [packed_words(whole >> p & 1 == 1) for p in range(PLANES)]
        self.sums = turned.sum(axis=1)

    def upper(self, codes: np.ndarray, scalars: np.ndarray, epsilon: float) -> np.ndarray:
        """queries x rows: upper bounds of the inner products."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.float64)
        total = np.zeros((len(self.low), len(codes)), np.uint32)
        for p, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                total += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.uint32) << np.uint32(p)
        out = total * self.step[:, None]
        out += self.low[:, None] * ones  # the sum of the rounded components under one bits
        out *= 2
        out -= self.sums[:, None]
        out += self.step[:, None] * ones  # half a step for each one bit, twice
        out /= np.sqrt(self.dim) * scalars
        return out + error_bound(scalars, self.dim, epsilon)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows whose vector is not null, not zero and free of null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each dimension in a column of lists: the dimension, the rows that have it, and their vectors."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, np.asarray(column.take(pa.array(at)).flatten()).reshape(-1, int(d))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares don't overflow and cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def units_of(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / norms(x)[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return np.einsum("ij,ij->i", a, b) / (norms(a) * norms(b))


def narrow(x: np.ndarray) -> np.ndarray:
    """In single precision, if that keeps every component."""
    with np.errstate(over="ignore"):
        y = x.astype("<f4")
    return y if (y == x).all() else x


def packed_vectors(values: list[bytes], dim: int) -> bytes:
    """Vectors behind each other; if some need double precision, all get it."""
    if len({len(v) for v in values}) > 1:
        values = [v if len(v) == 8 * dim else np.frombuffer(v, "<f4").astype("<f8").tobytes() for v in values]
    return b"".join(values)


def unpacked(raw, n: int, dim: int) -> np.ndarray:
    """n packed vectors as a matrix in double precision."""
    return np.frombuffer(raw, "<f4" if memoryview(raw).nbytes == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def raw_rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    offsets = (np.arange(len(x) + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


@dataclass
class Cells:
    """The cells of one dimension; numbers by cell."""

    centroids: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray
    radius: np.ndarray

    def parts(self) -> int:
        n = int(self.blocks.sum())
        return min(n, max(LEAST_PARTS, -(-n // PART_BLOCKS)))

    def holds(self) -> np.ndarray:
        """cells x parts: whether the part has a block of the cell; blocks are dealt in turn, cell by cell."""
        first, n = np.cumsum(self.blocks) - self.blocks, self.parts()
        return (np.arange(n)[None, :] - first[:, None]) % n < self.blocks[:, None]

    def bounds(self, units: np.ndarray, some: slice = slice(None)) -> np.ndarray:
        """queries x cells: no row of the cell has a larger cosine."""
        angles = np.arccos(np.clip(units @ self.centroids[some].T, -1, 1))
        return np.cos(np.maximum(0, angles - self.radius[some])) + 1e-9


@dataclass
class Index:
    blocks: DataFrame  # BLOCKS, several rows for each part
    cells: dict[int, Cells]  # by dimension


def centroids_of(sample: np.ndarray, n_rows: int) -> np.ndarray:
    """Unit centroids of about sqrt(n_rows) / 8 cells, by a few rounds of spherical k-means."""
    x = np.unique(units_of(sample), axis=0)
    k = min(len(x), MAX_CELLS, max(1, int(np.sqrt(n_rows) / 8)))
    out = x[np.random.default_rng(3).choice(len(x), k, replace=False)]
    for _ in range(8):
        sums = np.zeros_like(out)
        for a in range(0, len(x), 2048):
            np.add.at(sums, (x[a : a + 2048] @ out.T).argmax(axis=1), x[a : a + 2048])
        size = norms(sums)
        out = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], out)
    return out


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Every usable row is indexed, each dimension on its own."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    centroids = {}
    for dim, n in counts.items():
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        share = int(min(1.0, most / n) * (1 << 20))

        def fit(batches: Iterator[pa.RecordBatch], dim: int = dim, n: int = n) -> Iterator[pa.RecordBatch]:
            some = [np.asarray(b.column(0).flatten()).reshape(-1, dim) for b in batches if b.num_rows]
            if some:
                yield pa.RecordBatch.from_arrays([raw_rows(centroids_of(np.concatenate(some), n))], ["centroid"])

        # the sample stays in one task, the driver gets MAX_CELLS rows for each dimension
        own = rows.where(F.size("vector") == dim).select("vec_id", "vector")
        for some in (own.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= share).limit(2 * most), own.limit(1)):  # a small table may have no row in the sample
            found = some.select("vector").mapInArrow(fit, "centroid binary").toArrow().column(0).to_pylist()
            if found:
                centroids[dim] = unpacked(b"".join(found), len(found), dim)
                break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for dim, at, x in matrices(b.column(1)):
                if dim not in turns:
                    turns[dim] = rotation(dim)
                units = units_of(x)
                near = units @ centroids[dim].T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
                codes, scalars = encode_codes(units, turns[dim])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle), b.column(0).take(pa.array(at)), raw_rows(narrow(x)), raw_rows(codes), pa.array(scalars)], ["dim", "cell", "angle", "vec_id", "vector", "code", "scalar"])

    coded = written(rows.mapInArrow(assign, ROWS))
    cells = {dim: Cells(c, *(np.zeros(len(c), t) for t in (np.int64, np.int64, float))) for dim, c in centroids.items()}
    for r in coded.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # MAX_CELLS rows for each dimension
        own = cells[r["dim"]]
        size = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * r["dim"])))
        own.rows[r["cell"]], own.blocks[r["cell"]], own.radius[r["cell"]] = r["n"], -(-r["n"] // size), r["radius"] + 1e-6
    if not cells:
        return Index(spark.createDataFrame([], BLOCKS), {})

    def deal(dim: pa.Array, cell: pa.Array, n: pa.Array) -> pa.Array:
        d, c, k = (np.asarray(x) for x in (dim, cell, n))
        blocks = np.array([cells[i].blocks[j] for i, j in zip(d.tolist(), c.tolist(), strict=True)], np.int64)
        return pa.array((k % np.maximum(blocks, 1)).astype(np.int32))

    def pack(t: pa.Table) -> pa.Table:
        dim, cell, block = (t.column(c)[0].as_py() for c in ("dim", "cell", "block"))
        ids, scalars = (np.asarray(t.column(c).combine_chunks()).tobytes() for c in ("vec_id", "scalar"))
        part = (int(cells[dim].blocks[:cell].sum()) + block) % cells[dim].parts()
        key = {c: pa.array([v], pa.int32()) for c, v in (("dim", dim), ("cell", cell), ("part", part))}
        return pa.table(key | {"ids": pa.array([ids], pa.binary()), "codes": [b"".join(t.column("code").to_pylist())], "scalars": [scalars], "vectors": [packed_vectors(t.column("vector").to_pylist(), dim)]})

    numbered = coded.withColumn("block", F.arrow_udf(deal, "int")("dim", "cell", F.monotonically_increasing_id()))
    return Index(written(numbered.groupBy("dim", "cell", "block").applyInArrow(pack, BLOCKS)), cells)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best (score descending, id ascending), queries together."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[place < k]


def search_block(queries: tuple[np.ndarray, ...], block: tuple[np.ndarray, ...], k: int, epsilon: float, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query's id, row's id, score) of each query's k best rows of the block that reach its floor.

    queries: ids, vectors, floors (the k-th best score known); block: ids, codes, scalars, vectors."""
    ids_q, full, floor = queries
    keep = first_of_equals(block[0], block[3], k + 1)
    ids, codes, scalars, x = (part[keep] for part in block)
    units, floor = units_of(full), floor.copy()
    single, rows32 = units.astype(np.float32), units_of(x).astype(np.float32)
    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for a in range(0, len(ids_q), 128):
        rows = slice(a, a + 128)
        upper = Queries(units[rows], turn).upper(codes, scalars, epsilon)
        upper[ids[None, :] == ids_q[rows, None]] = -np.inf
        if not np.isfinite(floor[rows]).all() and upper.shape[1] > k:  # no floor yet: one from the best bounds
            first = np.argpartition(-upper, k, axis=1)[:, :k]
            near = np.einsum("ij,ikj->ik", single[rows], rows32[first])
            near[~np.isfinite(np.take_along_axis(upper, first, 1))] = -np.inf
            floor[rows] = np.maximum(floor[rows], near.min(axis=1) - ROUGH)
        q, r = np.nonzero(upper >= np.where(np.isfinite(floor[rows]), floor[rows], -2.0)[:, None])
        ends = np.searchsorted(q, np.arange(len(upper) + 1))
        left = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(len(upper)):  # the vectors left, in single precision, before the few that can be among the k best
            own = r[ends[i] : ends[i + 1]]
            near = rows32[own] @ single[a + i]
            least = floor[a + i] if len(own) <= k else max(floor[a + i], np.partition(near, -k)[-k])
            own = own[near >= least - ROUGH]
            left.append((np.full(len(own), a + i), own))
        q, r = (np.concatenate(p) for p in zip(*left, strict=True))
        for at in range(0, len(q), 16_384):
            some = q[at : at + 16_384], r[at : at + 16_384]
            q_, r_, score = (np.concatenate(p) for p in zip(found, (*some, cosine(full[some[0]], x[some[1]])), strict=True))
            pick = best(q_, ids[r_], score, k)
            found = q_[pick], r_[pick], score[pick]
    q, r, score = found
    return ids_q[q], ids[r], score


def first_of_equals(ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Places of the rows that can be among a query's nearest: of equal vectors, which all score alike, the n least ids."""
    raw = np.ascontiguousarray(x).view(np.uint64)
    with np.errstate(over="ignore"):
        keys = (raw * np.random.default_rng(5).integers(1, 1 << 64, x.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((ids, keys))
    new = np.concatenate([[True], (raw[order[1:]] != raw[order[:-1]]).any(axis=1)]) if len(ids) else np.zeros(0, bool)
    place = np.arange(len(ids))
    return np.sort(order[place - np.maximum.accumulate(np.where(new, place, 0)) < n])


PACKED = "dim int, part int, wave int, cells array<int>, query_ids binary, homes binary, queries binary, floors binary"


def needed(own: Cells, units: np.ndarray, homes: np.ndarray, floors: np.ndarray, at_home: bool, some: slice = slice(None)) -> np.ndarray:
    """queries x cells: whether the cell is to be scanned, at first a query's own, later each other that can hold a nearer row."""
    mine = homes[:, None] == np.arange(len(own.rows))[None, some]
    return mine if at_home else ~mine & (own.rows[None, some] > 0) & (own.bounds(units, some) >= floors[:, None])


def scanned(index: Index, packed: DataFrame, waves: int, k: int, epsilon: float, at_home: bool) -> DataFrame:
    """FOUND for the decks of queries (PACKED) against the blocks of the index, in the cells that each query needs."""
    cells = index.cells

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            for row in range(b.num_rows):
                dim, cell = (b.column(c)[row].as_py() for c in ("dim", "cell"))
                if dim not in turns:
                    turns[dim] = rotation(dim)
                raw = lambda c, t: np.frombuffer(b.column(c)[row].as_buffer(), t)  # noqa: B023, E731
                ids, ids_q, floors = raw("ids", "<i8"), raw("query_ids", "<i8"), raw("floors", "<f8")
                full = unpacked(b.column("queries")[row].as_buffer(), len(ids_q), dim)
                at = np.flatnonzero(needed(cells[dim], units_of(full), raw("homes", "<i4"), floors, at_home, slice(cell, cell + 1))[:, 0])
                if not len(at):
                    continue
                block = ids, raw("codes", "<u8").reshape(len(ids), -1), raw("scalars", "<f8"), unpacked(b.column("vectors")[row].as_buffer(), len(ids), dim)
                q, r, score = search_block((ids_q[at], full[at], floors[at]), block, k, epsilon, turns[dim])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(score)], ["query_id", "vec_id", "score"])

    # the left side of a merge join is streamed, the right side's rows of one key are held: a wave's queries, never blocks
    blocks = index.blocks.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    pairs = blocks.hint("merge").join(packed, ["dim", "part", "wave"]).where(F.array_contains("cells", F.col("cell")))
    return written(pairs.mapInArrow(scan, FOUND))


def dealt_decks(sizes: list[tuple[int, int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(dim, home) -> its first deck and how many it has, from (dim, home, queries). Small homes share a deck."""
    out, following, room, last = {}, 0, 0, None
    for dim, home, n in sorted(sizes):
        own = -(-n // QUERY_ROWS)
        if own > 1 or n > room or dim != last:
            first, following = following, following + own
            room = QUERY_ROWS - n if own == 1 else 0
        else:
            first, room = following - 1, room - n
        out[dim, home], last = (first, own), dim
    return out


def nearest(index: Index, queries: DataFrame, k: int = 5, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of the index by cosine, its own id left out.

    queries: rows (vec_id, vector) with usable vectors; a query is compared with the rows of its own dimension. Ties go to
    the smaller vec_id. Rows that share a vec_id count as candidates each, and as one query (the least by its vector).
    Fewer than k candidates: all of them. No usable vector: an empty result. Null, zero and non-finite vectors take no
    part."""
    spark, cells = queries.sparkSession, index.cells
    small_batches(spark)
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for dim, at, x in matrices(b.column(1)):
                if dim in cells:
                    near = (units_of(x) @ cells[dim].centroids.T).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), pa.array(near), b.column(0).take(pa.array(at)), raw_rows(narrow(x))], ["dim", "home", "vec_id", "vector"])

    single = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    placed = written(single.mapInArrow(home, "dim int, home int, vec_id long, vector binary").withColumn("n", F.monotonically_increasing_id()))
    sizes = [(r["dim"], r["home"], r["size"]) for r in placed.groupBy("dim", "home").agg(F.count("*").alias("size")).collect()]  # MAX_CELLS rows for each dimension
    decks, by_dim = dealt_decks(sizes), Counter()
    for dim, _, n in sizes:
        by_dim[dim] += 8 * dim * n
    waves = max([1, *(-(-size // WAVE_BYTES) for size in by_dim.values())])

    def deal(dim: pa.Array, home: pa.Array, n: pa.Array) -> pa.Array:
        first, own = np.array([decks[i] for i in zip(dim.to_pylist(), home.to_pylist(), strict=True)], np.int64).reshape(-1, 2).T
        return pa.array((first + np.asarray(n) % np.maximum(own, 1)).astype(np.int32))

    def packs(t: pa.Table, floors: np.ndarray, at_home: bool) -> pa.Table:
        """Rows of PACKED: for each part the queries that need one of its cells."""
        dim, deck, out = t.column("dim")[0].as_py(), t.column("deck")[0].as_py(), []
        own, vectors = cells[dim], t.column("vector").to_pylist()
        ids, homes = (np.asarray(t.column(c).combine_chunks()) for c in ("vec_id", "home"))
        need = needed(own, units_of(unpacked(packed_vectors(vectors, dim), len(ids), dim)), homes, floors, at_home)
        for part, held in enumerate(own.holds().T):
            at = np.flatnonzero(need[:, held].any(axis=1))
            if len(at):
                out.append((dim, part, deck % waves, np.flatnonzero(held & need.any(axis=0)).tolist(), ids[at].tobytes(), homes[at].tobytes(), packed_vectors([vectors[i] for i in at.tolist()], dim), floors[at].tobytes()))
        types = [pa.int32()] * 3 + [pa.list_(pa.int32())] + [pa.binary()] * 4
        return pa.table({f.split()[0]: pa.array([o[j] for o in out], types[j]) for j, f in enumerate(PACKED.split(", "))})

    def at_home(t: pa.Table) -> pa.Table:
        return packs(t, np.full(t.num_rows, -np.inf), True)

    def elsewhere(t: pa.Table) -> pa.Table:
        return packs(t, np.asarray(t.column("floor").combine_chunks()), False)

    placed = placed.withColumn("deck", F.arrow_udf(deal, "int")("dim", "home", "n"))
    first = scanned(index, placed.groupBy("dim", "home", "deck").applyInArrow(at_home, PACKED), waves, k, epsilon, True)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = placed.join(top, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    second = scanned(index, rest.groupBy("dim", "deck").applyInArrow(elsewhere, PACKED), waves, k, epsilon, False)
    found = first.unionByName(second)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
