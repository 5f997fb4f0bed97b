"""Tables in the folder that driver and executors share, and the dealing of scans over the cores."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local session without spark.checkpoint.dir, by application.
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}
#: Folders made so far, by application.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session (driver and executors in one process, as in tests) uses a temporary folder that
    goes when the process ends; on a cluster no folder of one machine would do, so this raises."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.TemporaryDirectory(prefix="tesserae-", ignore_cleanup_errors=True)
        top = "file://" + _LOCAL[sc.applicationId].name
    path = f"{top.rstrip('/')}/tesserae-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Removes what this session has put into the shared folder. Call it when results are saved: frames that still read
    these tables can't be used any longer."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder and read from there.

    Zstandard works on heap buffers, while the default codec keeps direct ones as large as the largest page; small row
    groups bound what a writer buffers."""
    path = shared_dir(df.sparkSession)
    df.write.options(**{"compression": "zstd", "parquet.block.size": str(16 << 20)}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan with fewer tasks than there are cores is dealt over all of them, for work that takes long on each row.

    A table of many files keeps its tasks: at scale nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
