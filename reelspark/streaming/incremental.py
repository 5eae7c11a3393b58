"""Incremental runs: what is new in a folder is processed once, results are upserted by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelspark.operators.tables import upsert


def process_new(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Run ``transform`` over files not seen before and append to ``target``, then stop; the checkpoint remembers them."""
    rows = spark.readStream.schema(schema).parquet(source)
    return transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, target: str, before: int | None = None) -> str | None:
    """The newest complete version of a table below ``target`` (of those before ``before``), or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getParent().getName() for f in store.globStatus(path(f"{target}/v=*/_SUCCESS")) or []]
    versions = sorted(n for n in (int(name.removeprefix("v=")) for name in found) if before is None or n < before)
    return f"{target}/v={versions[-1]}" if versions else None


def upsert_new(spark: SparkSession, source: str, schema, key: str, order: str | list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Upsert new rows by key into versions of a table below ``target``: v=<batch>. A batch that runs again writes the same version.

    Within a batch the latest row of a key counts, by ``order``; a batch replaces what earlier ones said of its keys. The
    newest earlier version is read; if there is none, the table is empty so far. A version is the whole table: for keyed
    states such as run summaries.
    """

    def merge(batch: DataFrame, number: int) -> None:
        value = F.struct(*[c for c in batch.columns if c != key])
        by = F.struct(*order) if isinstance(order, list) else F.col(order)
        latest = batch.groupBy(key).agg(F.max_by(value, by).alias("_v")).select(key, "_v.*")
        earlier = newest_version(spark, target, number)
        if earlier is not None:
            latest = upsert(batch.sparkSession.read.schema(schema).parquet(earlier), latest, key)
        latest.write.mode("overwrite").parquet(f"{target}/v={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sampled_frames(frames: DataFrame, every: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Per video and stretch of event time: frames, included ones, best confidence; late rows count until the watermark."""
    timed = frames.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("video_id", F.window("at", every)).agg(F.count("*").alias("frames"), F.count_if("include_flag").alias("included"), F.max("confidence").alias("best"))
