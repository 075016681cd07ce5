"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in ``spark.checkpoint.dir``.

    Where that is unset and the master is local, as in tests, a temporary folder is set;
    on a cluster no folder of one machine will do, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame's rows, written to the folder that all executors share; cuts the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as a compressed Parquet table; for larger frames.

    Spark deletes the files of shuffles that nothing refers to any more when the
    driver collects its garbage.  That is asked for here, as the steps before may
    have left many; after the table's schema was read, as Spark holds on to its last
    job until another is run.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


#: Keys that are sent to every task, of a few dozen bytes each; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


def few(keys: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A written frame of keys, marked for a broadcast if it has no more than so many rows."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def text_key(doc_id: str, text: str) -> Column:
    """64-bit key of a row's id and whole text; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by its tasks."""
    holder = sys.modules.setdefault("_lodestar_worker_state", types.ModuleType("_lodestar_worker_state"))
    return holder.__dict__.setdefault(name, {})


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that few texts at a time are Python objects; what is held of free memory goes back after the last."""
    hold_little()
    for batch in batches:
        for a in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(a, rows)
    batch = None
    give_back()


_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # mallopt's


def hold_little() -> None:
    """From now on this process keeps little memory that nothing uses, as a Python worker waits with it while other stages run.

    Arrow's buffers come from the C library, which by itself keeps what was freed for later.
    """
    if not worker_state("memory"):
        worker_state("memory")["held"] = True
        pa.set_memory_pool(pa.system_memory_pool())
        library = ctypes.CDLL(None)
        if hasattr(library, "mallopt"):
            library.mallopt(_MMAP_THRESHOLD, 1 << 20)
            library.mallopt(_TRIM_THRESHOLD, 8 << 20)


def give_back() -> None:
    """Gives the system what lies free between what is still used."""
    gc.collect()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


