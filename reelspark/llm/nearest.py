"""Pair records of two tables by nearest time within one entity.

Every right moment owns the stretch of time that lies nearer to it than to its neighbours: an interval bounded by the
midpoints to them and by the tolerance. A left record then matches the one interval it lies in. Intervals are built
and joined inside blocks of time, so that no entity, however hot, is ever one task: a block holds every moment within
the tolerance of it, which is all that a left record of that block can match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds of a time in seconds; null for null, NaN and infinite times."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 1e12)
    return F.when(finite, F.round(seconds * 1000).cast("long"))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_entity: str,
    left_id: str,
    left_tick: Column,
    right_entity: str,
    right_id: str,
    right_tick: Column,
    tolerance: int,
    block: int | None = None,
) -> DataFrame:
    """One row (left id, right id) for each distinct left record; the right id is null where none is near enough.

    ``left_tick`` and ``right_tick`` are whole numbers of one unit, ``tolerance`` too; ties go to the earlier moment,
    then to the smaller right id. Left records without a tick or entity come out unmatched, right records without a
    tick, an id or an entity take no part. Equal rows count once on either side. Only the columns named here are
    read, so further columns may have any names. Empty tables give an empty or an all-unmatched result.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    block = block or max(1, 8 * tolerance)
    moments = (
        right.select(F.col(right_entity).alias("entity"), F.col(right_id).alias("rid"), right_tick.alias("at"))
        .where("entity is not null and rid is not null and at is not null")
        .withColumn("block", F.explode(F.sequence(F.floor((F.col("at") - tolerance) / block), F.floor((F.col("at") + tolerance) / block))))
        .repartition("entity", "block")
        .groupBy("entity", "block", "at")
        .agg(F.min("rid").alias("rid"))
    )
    near = Window.partitionBy("entity", "block").orderBy("at")
    # Both bounds are doubled, so that midpoints are whole numbers: after < 2t <= until.
    intervals = moments.select(
        "entity",
        "block",
        "rid",
        F.greatest(2 * (F.col("at") - tolerance) - 1, F.lag("at").over(near) + F.col("at")).alias("after"),
        F.least(2 * (F.col("at") + tolerance), F.lead("at").over(near) + F.col("at")).alias("until"),
    )
    records = left.select(F.col(left_entity).alias("entity"), F.col(left_id).alias("lid"), left_tick.alias("t"))
    placeable = F.col("entity").isNotNull() & F.col("t").isNotNull()
    points = records.where(placeable).withColumn("block", F.floor(F.col("t") / block)).repartition("entity", "block").dropDuplicates(["entity", "block", "lid", "t"])
    # The intervals of a block are disjoint and sorted: a point can only lie in the last one that begins before it.
    none = F.lit(None)
    begins = intervals.select("entity", "block", F.col("after").alias("spot"), F.lit(1).alias("is_begin"), "rid", "until", none.cast(records.schema["lid"].dataType).alias("lid"))
    looked = points.select("entity", "block", (2 * F.col("t")).alias("spot"), F.lit(0).alias("is_begin"), none.cast(moments.schema["rid"].dataType).alias("rid"), none.cast("long").alias("until"), "lid")
    upto = Window.partitionBy("entity", "block").orderBy("spot", "is_begin").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("is_begin") == 1, F.struct("rid", "until")), ignorenulls=True).over(upto)
    found = begins.unionByName(looked).withColumn("held", held).where("is_begin = 0")
    matched = found.select(F.col("lid").alias(left_id), F.when(F.col("spot") <= F.col("held.until"), F.col("held.rid")).alias(right_id), F.lit(True).alias("timed"))
    # What has no time or entity can't match; it would only meet under one empty key.
    apart = records.where(~placeable).dropDuplicates(["lid", "entity", "t"])
    return matched.unionByName(apart.select(F.col("lid").alias(left_id), none.cast(moments.schema["rid"].dataType).alias(right_id), F.col("t").isNotNull().alias("timed")))


def cue_moment(start: str = "start_s", end: str = "end_s") -> Column:
    """Twice the middle of a cue in milliseconds: start where the end is null or before the start."""
    s, e = to_ms(F.col(start)), to_ms(F.col(end))
    return F.when(e.isNull() | (e < s), 2 * s).otherwise(s + e)


def frames_to_cues(frames: DataFrame, cues: DataFrame, tolerance_ms: int = 2000) -> DataFrame:
    """Each frame with the nearest cue of its video, or with none; columns frame_id, cue_id, timed."""
    return nearest_in_time(
        frames,
        cues,
        left_entity="video_id",
        left_id="frame_id",
        left_tick=2 * to_ms(F.col("timestamp_s")),
        right_entity="video_id",
        right_id="cue_id",
        right_tick=cue_moment(),
        tolerance=2 * tolerance_ms,
    )
