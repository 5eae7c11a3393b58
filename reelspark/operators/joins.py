"""Joins on intervals, and ordered alignment."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import tokens


def first_range(points: DataFrame, ranges: DataFrame, *, key: str, point_id: str, at: Column, start: Column, end: Column, order: str) -> DataFrame:
    """key, point id, order: for each point the lowest range with start <= at < end, -1 where there is none.

    ``at``, ``start`` and ``end`` are whole numbers. A range is filed under blocks of the power of two next to its
    length, at most two of them; a point looks into its block of each length in use. So neither long ranges nor hot
    keys pile up in one place. Null ids, keys or times match nothing; empty and backward ranges hold no point.
    """
    filed = ranges.select(F.col(key).alias("_k"), start.alias("_s"), end.alias("_e"), F.col(order).alias("_o")).where("_s < _e and _o is not null")
    level = F.ceil(F.log2(F.greatest(F.col("_e") - F.col("_s"), F.lit(1)).cast("double"))).cast("int")
    filed = filed.withColumn("_level", level).withColumn("_width", F.expr("shiftleft(1L, _level)"))
    filed = filed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_s") / F.col("_width")), F.floor((F.col("_e") - 1) / F.col("_width")))))
    # At most 63 lengths.
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    pts = points.select(F.col(key), F.col(point_id), at.alias("_at"))
    seek = pts.where(F.col("_at").isNotNull()).withColumn("_l", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_b", F.expr("floor(_at / shiftleft(1L, _l))"))
    hits = seek.join(filed, (F.col(key) == F.col("_k")) & (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_block")) & (F.col("_s") <= F.col("_at")) & (F.col("_at") < F.col("_e")))
    # Every point passes through the aggregate once more, so unmatched ones come out with -1.
    both = hits.select(key, point_id, F.col("_o").cast("long").alias("_o")).unionByName(pts.select(key, point_id, F.lit(None).cast("long").alias("_o")))
    return both.groupBy(key, point_id).agg(F.coalesce(F.min("_o"), F.lit(-1)).alias(order))


def overlapping(windows: DataFrame, cues: DataFrame, *, key: str, window: list[str], w0: Column, w1: Column, start: Column, end: Column, columns: list[str], block: int = 60_000) -> DataFrame:
    """window columns and cue columns of all pairs with end >= w0 and start <= w1, both whole numbers.

    Both sides are filed under the blocks of time they touch; a pair counts in the first block they share.
    """
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor(b / block)))
    wide = windows.select(F.col(key).alias("_wk"), *window, w0.alias("_w0"), w1.alias("_w1")).where("_w0 <= _w1").withColumn("_wb", blocks(F.col("_w0"), F.col("_w1")))
    said = cues.select(F.col(key).alias("_ck"), *columns, start.alias("_s"), end.alias("_e")).where("_s <= _e").withColumn("_cb", blocks(F.col("_s"), F.col("_e")))
    first_shared = F.floor(F.greatest("_w0", "_s") / block)
    on = (F.col("_wk") == F.col("_ck")) & (F.col("_wb") == F.col("_cb")) & (F.col("_e") >= F.col("_w0")) & (F.col("_s") <= F.col("_w1")) & (F.col("_wb") == first_shared)
    return wide.join(said, on).select(F.col("_wk").alias(key), *window, *columns, F.col("_s").alias("cue_start"))


def window_text(pairs: DataFrame, key: str, window: list[str], text: str, order: list[str]) -> DataFrame:
    """The texts of each window in order, joined by spaces; a window spans a batch of frames, so it is short."""
    said = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return pairs.groupBy(key, *window).agg(F.array_join(F.transform(said, lambda x: x["_t"]), " ").alias("window_text"))


ALIGN = "key string, p_idx long, start_s double, end_s double"
LEAST_OVERLAP = 0.4


class _Aligner:
    """One key's merge: its paragraphs wait in order, its cues stream by.

    A paragraph takes cues from where the last one stopped, as long as their words are its own; it always takes one.
    """

    def __init__(self) -> None:
        self.waiting: deque[tuple[int, frozenset]] = deque()
        self.first = self.last = None

    def stop(self) -> tuple[int, float, float]:
        """The range of the paragraph that has taken cues; the next one is on."""
        p, _ = self.waiting.popleft()
        got = (p, self.first, self.last)
        self.first = self.last = None
        return got

    def pass_cue(self, start: float, end: float, cue: frozenset) -> Iterator[tuple[int, float, float]]:
        while self.waiting:
            near = len(cue & self.waiting[0][1]) / len(cue) >= LEAST_OVERLAP
            if near or self.first is None:
                self.first = start if self.first is None else self.first
                self.last = end
                if not near:
                    yield self.stop()
                return
            yield self.stop()


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, out = None, _Aligner(), []

    def leave() -> None:
        if state.first is not None:
            out.append((key, *state.stop()))

    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] != key:
                leave()
                key, state = r["key"], _Aligner()
            words = frozenset(r["words"] or ())
            if not words:
                continue
            if r["is_cue"]:
                out += [(key, *got) for got in state.pass_cue(r["start_s"], r["end_s"], words)]
            else:
                state.waiting.append((r["seq"], words))
        if len(out) > 5000:
            yield _ranges(out)
            out = []
    leave()
    if out:
        yield _ranges(out)


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    k, p, s, e = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(p, pa.int64()), pa.array(s, pa.float64()), pa.array(e, pa.float64())], names=["key", "p_idx", "start_s", "end_s"])


def align_paragraphs(cues: DataFrame, paragraphs: DataFrame, *, key: str = "video_id", seq: str = "seq", p_idx: str = "p_idx") -> DataFrame:
    """key, p_idx, start_s, end_s: the stretch of cues each paragraph was said in, in order; unmatched ones are absent.

    A cue is consumed while at least 0.4 of its words are the paragraph's, or as the first one. The merge is sequential
    by nature: a key's rows pass one task, sorted and streamed, holding the words of its waiting paragraphs; its cues, the
    many, only stream by. Rows with null keys or
    order are left out, and so are cues without times.
    """
    c = cues.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).select(F.col(key).alias("key"), F.lit(True).alias("is_cue"), F.col(seq).cast("long").alias("seq"), "start_s", "end_s", tokens("text").alias("words"))
    none = F.lit(None).cast("double")
    p = paragraphs.select(F.col(key).alias("key"), F.lit(False).alias("is_cue"), F.col(p_idx).cast("long").alias("seq"), none.alias("start_s"), none.alias("end_s"), tokens("text").alias("words"))
    rows = c.unionByName(p).where("key is not null and seq is not null").repartition("key").sortWithinPartitions("key", "is_cue", "seq", "start_s")
    return rows.mapInArrow(_align, ALIGN).withColumnRenamed("key", key)


def cache_split(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a keyed cache; null keys are misses."""
    return rows.join(cache.select(key), key, "left_semi"), rows.join(cache.select(key), key, "left_anti")


def with_default(left: DataFrame, lookup: DataFrame, on: list[str], value: str, file_key: str, order: str) -> DataFrame:
    """``value`` by all of ``on``; else the first entry of ``file_key``, by ``order``; else null."""
    first = lookup.groupBy(F.col(file_key).alias("_f")).agg(F.min_by(value, order).alias("_first"))
    exact = lookup.groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(F.min_by(value, order).alias("_exact"))
    cond = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    both = left.join(exact, cond, "left").join(first, F.col(file_key) == F.col("_f"), "left")
    return both.withColumn(value, F.coalesce("_exact", "_first")).drop("_exact", "_first", "_f", *[f"_{c}" for c in on])
