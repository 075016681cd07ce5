"""SparkSession settings that the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Bytes of a frame, as Spark thinks them to be, in a partition.
PART_BYTES = 8_000_000


def get_session(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` adds others, with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions for work that takes long for its size in bytes, by which Spark would leave it to a few tasks.

    48 at least, as executors may come after a query is built; more for a frame that Spark thinks to be large.
    """
    least = max(4 * spark.sparkContext.defaultParallelism, 48)
    if df is None:
        return least
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(least, size // PART_BYTES), max(least, 10_000))


def scratch(spark: SparkSession) -> str:
    """A folder for intermediate files that all executors share.

    The one in ``spark.checkpoint.dir``; where that is unset and the master is local, a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-scratch-")
