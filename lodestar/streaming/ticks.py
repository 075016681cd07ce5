"""Roll-ups of a stream: tick tables that are kept up to date as rows arrive, however late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.windows import bucket
from lodestar.operators.ticks import ALL, build_tick


def tick_counts(stream: DataFrame, tick: str, ts: str, keys: list[str], value: str) -> DataFrame:
    """Streaming sums by window and every subset of the keys; for output mode "update" or "complete"."""
    masks = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(keys) - 1))).alias("__mask")
    cube = [F.when(F.col("__mask").bitwiseAND(1 << i) > 0, F.lit(ALL)).otherwise(F.col(k).cast("string")).alias(k) for i, k in enumerate(keys)]
    spread = stream.select("*", masks)
    x = F.col(value).cast("double")
    return spread.groupBy(bucket(ts, tick).alias(ts), *cube).agg(
        F.count("*").alias("counter"), F.sum(x).alias(f"{value}::sum"), F.min(value).alias(f"{value}::min"), F.max(value).alias(f"{value}::max"), F.avg(x).alias(f"{value}::avg"), F.var_pop(x).alias(f"{value}::var")
    )


def stream_ticks(stream: DataFrame, base_path: str, tick_path: str, tick: str, ts: str, keys: list[str], rollup: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch to the base table and replaces the windows that it touches.

    The touched windows are summed anew from the base table, so a batch that is
    run again gives the same tables: base rows are written under the batch's
    number, and windows under theirs, each overwritten as a whole.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("window", bucket(ts, tick)).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window", "batch").parquet(base_path)
        touched = batch.select(bucket(ts, tick).alias("window")).distinct()
        base = spark.read.parquet(base_path).join(touched, "window", "left_semi").drop("window", "batch")
        made = build_tick(base, tick, ts, keys, rollup)
        made.withColumn("window", F.col(ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(tick_path)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).queryName(f"ticks-{uuid.uuid4().hex[:8]}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
