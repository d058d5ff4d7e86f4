"""Shared plumbing: table reading, batch bounds and lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: documents can be long, so batches stay small.
BATCH_ROWS = 400
BATCH_BYTES = 4 << 20
#: Share of the driver's greatest heap from which on garbage is collected between queries.
HEAP_SHARE = 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: sent once for each Spark context, as one small file."""
    sc = spark.sparkContext
    if getattr(sc, "_engram_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="engram-package-")) / "engram_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._engram_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at once small and independent of the input size."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread_out(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores (one small file, say) is dealt out over all of them, so that
    work on each text doesn't wait for one core. Larger tables, which have more partitions, stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df._jdf.rdd().getNumPartitions() < cores else df


_held: dict = {}


def held(key, make):
    """What a Python worker keeps between batches and tasks: one object at a time, so that workers which Spark
    reuses for another operator don't hold the caches of the one before."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)
        _held[key] = make()
    return _held[key]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: ``spark.checkpoint.dir``. Where that is unset, an own one in local mode; a cluster needs one that
    all machines share, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="engram-checkpoint-"))
    return sc.getCheckpointDir()


def tidy(spark: SparkSession) -> None:
    """Long jobs of many queries leave plans, broadcasts and shuffle files behind that nothing refers to any more; a collection on the
    driver lets go of them, and of the executors' parts, before its heap is full."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() < HEAP_SHARE * heap.maxMemory():
        return
    collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    spark._jvm.System.gc()


def write_out(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder in small row groups and read again, and its path: reads take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/engram-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def park(df: DataFrame) -> DataFrame:
    """A table written out that stays."""
    return write_out(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    cut = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return cut


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id counts as not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
