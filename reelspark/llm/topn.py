"""The N best items of every group, with a total order among ties.

Each partition is sorted (on disk where it must be) and keeps, per group, its own N best distinct items; where it has N of them, the N-th is a bound: nothing
behind it can be among the N best of the whole. The tightest bound of each group is joined back, candidates behind it
are dropped, and only the survivors are ranked. At most N rows per group leave a partition, so a group of any size is
never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reelspark.session import materialize


def _local_best(n: int, schema: pa.Schema):
    """The first ``n`` distinct items of every group of a sorted partition; the n-th is marked as a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, taken = None, 0  # the last row, and how many distinct items of its group have come
        for batch in batches:
            rows = batch.to_pandas()
            if not len(rows):
                continue
            fresh = rows["grp"].ne(rows["grp"].shift())
            other = fresh | rows["item"].ne(rows["item"].shift())
            goes_on = before is not None and rows["grp"].iloc[0] == before[0]
            if goes_on:
                fresh.iloc[0] = False
                other.iloc[0] = rows["item"].iloc[0] != before[1]
            group = fresh.cumsum()
            rank = other.astype("int64").groupby(group).cumsum() - 1
            if goes_on:
                rank = rank.where(group != 0, rank + taken)
            before, taken = (rows["grp"].iloc[-1], rows["item"].iloc[-1]), int(rank.iloc[-1]) + 1
            keep = other & (rank < n)
            out = rows[keep].assign(is_bound=(rank == n - 1)[keep])
            if len(out):
                yield from pa.Table.from_pandas(out, schema=schema, preserve_index=False).to_batches()

    return run


def top_n_per_group(items: DataFrame, *, group: str, item: str, score: Column, time: Column, n: int = 5) -> DataFrame:
    """Columns group, item, ``rank`` (1..n): score descending, time ascending with nulls last, item ascending.

    Rows without a group, an item or a score (null or NaN) take no part; a NaN time counts as null. An item delivered
    several times counts once. Groups with fewer than ``n`` items keep all. ``n`` below 1 gives no rows. Other
    columns of ``items`` are not read.
    """
    rows = items.select(
        F.col(group).alias("grp"),
        (-score.cast("double")).alias("k0"),
        F.when(time.isNotNull() & ~F.isnan(time.cast("double")), time.cast("double")).alias("t"),
        F.col(item).alias("item"),
    ).where("grp is not null and item is not null and k0 is not null and not isnan(k0)")
    rows = rows.select("grp", "k0", F.col("t").isNull().cast("int").alias("k1"), F.coalesce("t", F.lit(0.0)).alias("k2"), "item")
    out = T.StructType([*rows.schema.fields, T.StructField("is_bound", T.BooleanType())])
    empty = rows.where("false").select(F.col("grp").alias(group), F.col("item").alias(item), F.lit(1).alias("rank"))
    if n < 1:
        return empty
    # Written once, as bounds and candidates both come from it: one scan of the items.
    ordered = rows.sortWithinPartitions("grp", "k0", "k1", "k2", "item")
    best = materialize(ordered.mapInArrow(_local_best(n, to_arrow_schema(out)), out), "best")
    key = F.struct("k0", "k1", "k2", "item")
    bounds = best.where("is_bound").groupBy(F.col("grp").alias("b_grp")).agg(F.min(key).alias("bound"))
    survivors = best.join(bounds, F.col("grp") == F.col("b_grp"), "left").where(F.col("bound").isNull() | (key <= F.col("bound")))
    ranked = survivors.dropDuplicates(["grp", "item"]).withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("k0", "k1", "k2", "item")))
    return ranked.where(F.col("rank") <= n).select(F.col("grp").alias(group), F.col("item").alias(item), "rank")


def best_frames(frames: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best included frames of each run; confidences outside 0..1 take no part."""
    fit = frames.where("include_flag and confidence between 0 and 1 and not isnan(confidence)")
    return top_n_per_group(fit, group="run_id", item="frame_id", score=F.col("confidence"), time=F.col("timestamp_s"), n=n)
