"""N-gram Jaccard join: near-duplicate documents with Bayesian pruning of candidate pairs.

1. Documents with equal shingle sets form one node, whatever their doc_ids, so exact copies cost a count.
2. Nodes that share a band of MinHash values are linked to the band's least node (one link each, not all pairs);
   connected components of these links are the groups inside which pairs can exist.
3. Signatures and shingle sets are computed once for the nodes of groups; texts don't travel. Large groups are split into
   blocks by hash. Each task takes two blocks: pairs are compared by STEP MinHash values at a time and dropped once the
   posterior probability (uniform prior) of a similarity of at least the threshold is below TOLERANCE; the pairs that are
   left are verified exactly on their shingle sets. A task returns a number of links for each node and the edges of a
   spanning forest of the links, never pairs.
4. Components of the forest are the classes of near duplicates.

Bands, hubs and groups of any size are joined by join_counted, which spreads heavy keys. With 32 bands of 5 values a pair
at 0.8 is missed with probability 3e-6, and less above.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, dealt, give_back, join_counted, slices, small_batches, worker_cache, written
from .components import components
from .shingles import mix, shingle_sets

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND = 32, 5
STEP = 32
TOLERANCE = 1e-7
#: Bounds of a block of documents that a task compares with another one, by number and by bytes of their shingles.
BLOCK_DOCS = 512
BLOCK_BYTES = 8 << 20
BROADCAST_ROWS = 1_000_000


def minhash(shingles: np.ndarray) -> np.ndarray:
    """BANDS * BAND least values of keyed 32-bit hashes of a set; all ones for the empty set."""
    n = BANDS * BAND
    rng = np.random.default_rng(11)
    a, b = (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 4096):
        part = (x[None, k : k + 4096] ^ b) * a
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, part.min(axis=1))
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, BAND).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(BAND):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return out.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes | None:
    """A 128-bit key of a shingle set; none for the empty set."""
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step of STEP values, the least number of equal ones that keeps P(similarity >= threshold) >= tolerance.

    The posterior after m of n is Beta(m + 1, n - m + 1); its tail is a binomial sum: P(x >= t) = P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, BANDS * BAND + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def links_between(sets: list[np.ndarray], signatures: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (one of left, one of right; each pair once) with a Jaccard similarity of at least the threshold."""
    found_a, found_b = [], []
    needed, same = least_matches(threshold), left is right
    of_right = np.full(len(sets), -1)
    of_right[right] = np.arange(len(right))
    for k in range(0, len(left), 64):
        rows = left[k : k + 64]
        a, b = np.meshgrid(rows, right, indexing="ij")
        a, b = a.ravel(), b.ravel()
        if same:
            a, b = a[a < b], b[a < b]
        equal = np.zeros(len(a), np.int32)
        for s, least in enumerate(needed):
            cols = slice(s * STEP, (s + 1) * STEP)
            equal += (signatures[a, cols] == signatures[b, cols]).sum(axis=1, dtype=np.int32)
            keep = equal >= least
            a, b, equal = a[keep], b[keep], equal[keep]
        if not len(a):
            continue
        # exact: shingles of the rows that are left, and the sets of their partners against them
        for i in np.unique(a):
            mates = b[a == i]
            sizes = np.array([len(sets[j]) for j in mates])
            own = sets[i]
            joined = np.concatenate([sets[j] for j in mates])
            at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            hit = np.concatenate([[0], np.cumsum(own[at] == joined)])
            ends = np.cumsum(sizes)
            common = hit[ends] - hit[ends - sizes]
            good = common >= threshold * (sizes + len(own) - common) - 1e-9
            found_a.append(np.full(int(good.sum()), i))
            found_b.append(mates[good])
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join what wasn't joined before."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of docs: doc_id, class_id (the least doc_id of its class) and n_links.

    Similarity is the Jaccard similarity of the sets of k-word shingles (fewer than k words: one shingle of all words;
    words are runs of letters, marks and digits in lower case). n_links counts the other rows at the threshold or above,
    copies included. Texts without a word (null, empty, blanks) are linked to nothing and are classes of their own.
    Rows that share a doc_id are rows of their own: each is linked by its own text. Rows without doc_id are left out. An
    empty table gives an empty result; extra columns don't matter."""
    return classed(docs, k, threshold).select("doc_id", "class_id", "n_links")


def classed(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Rows of near_duplicates with set_key and kept_key, the set_key of the row that stands for the class."""
    small_batches(docs.sparkSession)
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard")
        for batch in batches:
            for b in slices(batch, 1000, 1):
                sets = shingle_sets(b.column(1), k)
                bands = [band_keys(minhash(s)).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.binary())], ["doc_id", "set_key", "size", "bands"])
        give_back()

    signed = written(docs.mapInArrow(sign, "doc_id long, set_key binary, size long, bands binary"))
    filled = signed.where(F.col("set_key").isNotNull())
    nodes = filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                band = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), BANDS)), pa.array(band)], ["node", "band"])

    bands = nodes.select("node", "bands").mapInArrow(explode, "node long, band long")
    n_nodes = nodes.count()
    least = written(dealt(bands.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1"), n_nodes * BANDS))
    links = join_counted(bands, least, "band", n_nodes * BANDS).where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    groups = written(dealt(components(links).join(nodes.select("node", "set_key", "rep", "copies", "size"), "node"), n_nodes))
    n_grouped = groups.count()
    found = written(compared(docs, blocked(groups, n_grouped), n_grouped, k, threshold))

    n_links = found.where("kind = 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    classes = written(dealt(components(found.where("kind = 1").select("u", "v")).join(groups.select("node", "set_key", "rep"), "node"), n_grouped))
    per_class = written(dealt(classes.groupBy("root").agg(F.min(F.struct("rep", "set_key")).alias("kept"), F.count("*").alias("n")), n_grouped))
    classes = join_counted(classes.select("node", "root"), per_class, "root", classes.count()).select("node", F.col("kept.rep").alias("class_id"), F.col("kept.set_key").alias("kept_key"))
    merged = nodes.join(n_links, "node", "left").join(classes, "node", "left")
    merged = written(merged.select("set_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("kept_key", "set_key").alias("kept_key"), "copies").transform(dealt, n_nodes))
    cols = "doc_id", "class_id", "n_links", "set_key", "kept_key"
    out = join_counted(filled.select("doc_id", "set_key"), merged, "set_key", filled.count(), "copies").select(*cols)
    blank = signed.where(F.col("set_key").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "set_key", F.col("set_key").alias("kept_key"))
    return out.unionByName(blank)


def blocked(groups: DataFrame, n_rows: int) -> DataFrame:
    """groups with block and blocks: how its group is split."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes"))
    sizes = written(sizes.select("root", "n", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")).transform(dealt, n_rows))
    return join_counted(groups, sizes, "root", n_rows).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def compared(docs: DataFrame, members: DataFrame, n_rows: int, k: int, threshold: float) -> DataFrame:
    """(u, v, n, kind): kind 0: node u has n links; kind 1: u and v are joined by an edge of the forest."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard")
        for batch in batches:
            for b in slices(batch, 1000):
                sets = [s for s in shingle_sets(b.column(0), k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([minhash(s).tobytes() for s in sets], pa.binary())], ["set_key", "shingles", "signature"])
        give_back()

    reps = broadcast_below(members.select("rep").distinct(), n_rows, BROADCAST_ROWS)  # a number a row; beyond that, a shuffled join
    sets = docs.join(reps, docs["doc_id"] == reps["rep"]).select("text").mapInArrow(prepare, "set_key binary, shingles binary, signature binary")
    sets = written(members.join(sets, "set_key").dropDuplicates(["set_key"]).select("root", "node", "copies", "block", "blocks", "shingles", "signature"))
    # a document of block i goes to the tasks (i, j) with j >= i and (j, i) with j < i
    mates = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mate"))
    mates = mates.select("root", "node", "copies", "block", "shingles", "signature", F.least("block", "mate").alias("p"), F.greatest("block", "mate").alias("q"))

    def compare(t: pa.Table) -> pa.Table:
        worker_cache("jaccard")
        block, node, copies = (np.asarray(t.column(c).combine_chunks()) for c in ("block", "node", "copies"))
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        signatures = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(len(sets), -1)
        left = np.flatnonzero(block == p)
        right = left if p == q else np.flatnonzero(block == q)
        a, b = links_between(sets, signatures, left, right, threshold)
        count = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        tree = np.array(forest(a, b, len(node)), np.int64).reshape(-1, 2)
        some = np.flatnonzero(count)
        u, v = np.concatenate([node[some], node[tree[:, 0]]]), np.concatenate([np.full(len(some), -1), node[tree[:, 1]]])
        n, kind = np.concatenate([count[some].astype(np.int64), np.zeros(len(tree), np.int64)]), np.repeat([0, 1], [len(some), len(tree)])
        return pa.table({"u": u, "v": v, "n": n, "kind": kind.astype(np.int32)})

    return mates.groupBy("root", "p", "q").applyInArrow(compare, "u long, v long, n long, kind int")


def keep_one(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class of near duplicates: the row of the least doc_id (any one of rows with equal doc_id
    and shingles). Rows without doc_id and rows without a word stay."""
    marked = written(classed(docs, k, threshold).withColumn("kept", (F.col("doc_id") == F.col("class_id")) & F.col("set_key").eqNullSafe(F.col("kept_key"))).select("doc_id", "set_key", "kept"))
    ids = docs["doc_id"].cast("long")
    lost = marked.where("NOT kept").select(F.col("doc_id").alias("_lost")).distinct()
    repeated = written(marked.groupBy(F.col("doc_id").alias("_many")).agg(F.count("*").alias("n")).where("n > 1").select("_many"))
    n_repeated = repeated.count()
    if not n_repeated:
        return docs.join(lost, ids == F.col("_lost"), "left_anti")
    some = broadcast_below(repeated, n_repeated, BROADCAST_ROWS)
    single = docs.join(some, ids == F.col("_many"), "left_anti").join(lost, ids == F.col("_lost"), "left_anti")

    def keys(texts: pa.Array) -> pa.Array:
        return pa.array([set_key(s) for part in slices(texts, 1000) for s in shingle_sets(part, k)], pa.binary())

    many = docs.join(some, ids == F.col("_many"), "left_semi").withColumn("_key", F.arrow_udf(keys, "binary")("text"))
    blank = many.where(F.col("_key").isNull())
    kept = marked.where("kept AND set_key IS NOT NULL").join(some, F.col("doc_id") == F.col("_many"), "left_semi").select(F.col("doc_id").alias("_kept"), F.col("set_key").alias("_kept_key")).distinct()
    chosen = many.join(kept, (ids == F.col("_kept")) & (F.col("_key") == F.col("_kept_key"))).dropDuplicates(["_kept", "_key"])
    return single.unionByName(blank.unionByName(chosen.select(*blank.columns)).drop("_key"))
