"""What the operators share: the shared folder, written tables, joins that bear hot keys, worker-wide caches."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, written  # noqa: F401

MB = 1 << 20
#: Bytes that an Arrow batch on its way to a Python worker, and a slice that a kernel works on, have at most (one row at least).
BATCH_BYTES, SLICE_BYTES = 4 * MB, MB
#: A key is heavy if more than one row of HEAVY_SHARE has it, so there are fewer heavy keys than that.
HEAVY_SHARE = 10_000
#: Narrow rows of a task, and the fewest tasks, of dealt().
ROWS_PER_TASK, LEAST_TASKS = 200_000, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, where it is higher: long texts come in small batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    size = int(now) if now.lstrip("-").isdigit() else BATCH_BYTES + 1
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def broadcast_below(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only if the counted rows are within the limit; else Spark picks a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, n_rows: int, n: str = "n") -> DataFrame:
    """rows joined with per_key, which has one row for each key and in column n how many of the n_rows rows have it.

    Rows of heavy keys stay where they are and get their key's row by a broadcast of fewer than HEAVY_SHARE rows; the
    others are shuffled, and none of their keys weighs anything. rows and per_key are read twice: pass written tables."""
    is_heavy = F.col(n) * HEAVY_SHARE > n_rows
    heavy, light = per_key.where(is_heavy).drop(n), per_key.where(~is_heavy).drop(n)
    if n_rows < HEAVY_SHARE:  # every key is heavy
        return rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Fewer tasks for a table of so many narrow rows, where the session's shuffles have more: steps that are repeated many
    times spend no time on empty partitions. Nothing is shuffled for it, and a large table keeps all its tasks."""
    tasks = max(LEAST_TASKS, -(-rows // ROWS_PER_TASK))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def crc_mod(key: str | Column, n: int) -> Column:
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key) % n


def learning(mod: Column, held_out: int) -> tuple[Column, Column]:
    """(rows to learn from, held_out) for a remainder of crc32(doc_id); a row without doc_id is learned from by no model
    and isn't held out."""
    out = F.coalesce(mod == held_out, F.lit(False))
    return F.coalesce(mod != held_out, F.lit(False)), out


def slices(batch: pa.RecordBatch | pa.Array, rows: int, column: int = 0, size_bytes: int = SLICE_BYTES) -> Iterator:
    """The batch cut into slices of at most so many rows and, but for single rows, so many bytes of that column."""
    texts = batch if isinstance(batch, pa.Array) else batch.column(column)
    n = len(texts)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if n else np.zeros(0, np.int64)
    at = 0
    while at < n:
        before = int(size[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(size, before + size_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end


def worker_cache(owner: str) -> dict:
    """A dictionary that outlives a task: Python workers are reused, kernels are unpickled anew.

    A worker keeps the values of one owner only. What another operator left is dropped first and its memory given back,
    so a worker's memory is bounded by the largest operator, not by the sum; every kernel therefore asks for its own."""
    name = "_tesserae_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].owner, sys.modules[name].values = owner, {}
    cache = sys.modules[name]
    if cache.owner != owner:
        cache.owner, cache.values = owner, {}
        give_back()
    return cache.values


def give_back(collect: bool = True) -> None:
    """Returns freed memory of this worker to the system. Kernels call it when a task ends, as idle workers stay alive."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
