"""Keyed upserts, resuming, counts and upgrade plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ordered import ordered


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new rows; null keys never replace each other."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(items: DataFrame, outputs: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Items without an output of a size above zero; all with ``force``."""
    return items if force else items.join(outputs.where("size > 0").select(key), key, "left_anti")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def running_total(rows: DataFrame, key: str, order: list[str], value: Column, name: str = "total") -> DataFrame:
    return ordered(rows, key, order, running={name: value})


def running_spend(rows: DataFrame, key: str, order: list[str], images: Column, *, price: float, factor: float = 1.3, cap: float | None = None) -> DataFrame:
    """``rows`` with ``spent``, the estimated cost of all images up to each row of a key, and ``over_cap``: a warning, nothing stops."""
    spent = running_total(rows, key, order, images, "_images").withColumn("spent", F.col("_images") * F.lit(price * factor)).drop("_images")
    return spent.withColumn("over_cap", F.lit(False) if cap is None else F.col("spent") > cap)


def totals(rows: DataFrame, state: str, states: tuple[str, ...]) -> DataFrame:
    """One row with the number of rows in each state; states that don't occur count 0."""
    return rows.agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])


def needs_upgrade(width: Column, least: int = 1920) -> Column:
    """An image that is missing, unreadable (null width) or too narrow."""
    return F.coalesce(width < least, F.lit(True))


def _gcds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict = {}
    for b in batches:
        for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist(), strict=True):
            found[k] = math.gcd(found.get(k, 0), v)
        if len(found) > 100_000:
            yield _pairs(found)
            found = {}
    if found:
        yield _pairs(found)


def _pairs(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["k", "v"])


def sampling_interval(rows: DataFrame, key: str, seconds: Column, default: int = 5) -> DataFrame:
    """key, interval_s: the greatest common divisor of a key's whole seconds above zero, or the default.

    Partitions reduce their rows before and after the shuffle, so a hot key costs one row per partition.
    """
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.coalesce(F.floor(seconds).cast("long"), F.lit(0)).alias("v"))
    part = keyed.mapInArrow(_gcds, "k string, v long")
    whole = part.repartition("k").sortWithinPartitions("k").mapInArrow(_gcds, "k string, v long")
    return whole.groupBy("k").agg(F.max("v").alias("v")).select(F.col("k").alias(key), F.when(F.col("v") > 0, F.col("v")).otherwise(default).alias("interval_s"))


def upgrade_plan(figures: DataFrame, widths: DataFrame, durations: DataFrame, least: int = 1920) -> DataFrame:
    """path, video_id, timestamp_s, interval_s, grid_index, state: which figures are to be taken again, and from where.

    A time outside the video's grid fails.
    """
    todo = figures.join(widths, "path", "left").where(needs_upgrade(F.col("width"), least)).where(F.col("video_id").isNotNull())
    grid = sampling_interval(figures, "video_id", F.col("timestamp_s"))
    rows = todo.join(grid, "video_id").join(durations.select("video_id", "duration_s"), "video_id", "left")
    index = F.expr("timestamp_s div interval_s").cast("long")
    ok = F.col("timestamp_s") <= F.coalesce("duration_s", F.lit(-1.0))
    return rows.select("path", "video_id", "timestamp_s", "interval_s", index.alias("grid_index"), F.when(ok, "upgrade").otherwise("failed").alias("state"))
