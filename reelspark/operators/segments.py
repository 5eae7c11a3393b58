"""Texts into sentences, cues, paragraphs, chunks and batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.text import UNICODE_SPACE, _c, collapse_ws
from reelspark.functions.udf import arrow_udf
from reelspark.operators.ordered import numbered, ordered

PER, MAX_CHARS, CHUNK_CHARS, SHORTEST_CUE_MS = 4, 700, 6000, 200


def sentences(c: Column | str) -> Column:
    """The text split at white space behind . ! ? and their wide forms."""
    return F.split(_c(c), f"(?<=[.!?。！？])[{UNICODE_SPACE}]+")


def cue_sentences(c: Column | str) -> Column:
    """As for cues: split behind . ? ! 。 only; stripped, none empty."""
    parts = F.transform(F.split(collapse_ws(c), "(?<=[.?!。]) "), lambda x: F.trim(x))
    return F.filter(parts, lambda s: s != "")


def interpolated_cues(chunks: DataFrame, group: list[str], text: str, start_ms: Column, length_ms: Column, within: list[str] | None = None) -> DataFrame:
    """group, cue_idx, start_ms, end_ms, text: a chunk's sentences share its time by their lengths; no cue is empty.

    The windows run over the sentences of one chunk, which ``within`` names if less than all of ``group`` does.
    """
    one = chunks.select(*group, start_ms.alias("_s0"), length_ms.alias("_dur"), F.posexplode(cue_sentences(text)).alias("cue_idx", "text"))
    one_chunk = Window.partitionBy(*(within or group))
    upto = F.sum(F.char_length("text")).over(one_chunk.orderBy("cue_idx"))
    total = F.sum(F.char_length("text")).over(one_chunk)
    timed = one.withColumn("_n", F.char_length("text")).withColumn("_upto", upto).withColumn("_total", total)
    at = lambda c: (F.col("_s0") + F.floor(F.col("_dur") * c / F.col("_total"))).cast("long")
    timed = timed.withColumn("start_ms", at(F.col("_upto") - F.col("_n"))).withColumn("end_ms", at(F.col("_upto")))
    end = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + SHORTEST_CUE_MS).otherwise(F.col("end_ms"))
    return timed.select(*group, "cue_idx", "start_ms", end.alias("end_ms"), "text")


def transcript_cues(chunks: DataFrame, key: str, idx: str, text: str, chunk_ms: int) -> DataFrame:
    """key, idx, cue_idx, start_ms, end_ms, text: the cues of chunks of equal length, none ending behind the start of the next.

    Inside a chunk the next cue is near; over its end only the numbers of chunks are ordered, never their texts.
    """
    said = chunks.where(F.col(key).isNotNull() & F.col(idx).isNotNull() & F.col(text).rlike(f"[^{UNICODE_SPACE}]")).select(key, idx, F.col(text).alias("text"))
    at = F.col(idx).cast("long") * chunk_ms
    led = ordered(said.select(key, idx, at.alias("_at")), key, [idx], lag={"_next_chunk": "_at"}, descending=True).select(F.col(key).alias("_k"), F.col(idx).alias("_i"), "_next_chunk")
    both = said.join(led, (F.col(key) == F.col("_k")) & (F.col(idx) == F.col("_i"))).drop("_k", "_i")
    cues = interpolated_cues(both, [key, idx, "_next_chunk"], "text", at, F.lit(chunk_ms), within=[key, idx])
    following = F.lead("start_ms").over(Window.partitionBy(key, idx).orderBy("cue_idx"))
    return cues.withColumn("end_ms", F.least("end_ms", F.coalesce(following, "_next_chunk"))).drop("_next_chunk")


def clamp_to_next(cues: DataFrame, key: str, start: str, end: str, order: list[str]) -> DataFrame:
    """No cue ends behind the start of the next one of its key; the last stays as it is."""
    led = ordered(cues, key, order, lag={"_next": start}, descending=True)
    return led.withColumn(end, F.least(end, "_next")).drop("_next")


def drop_repeats(events: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """Blank texts, and texts equal to the one before among the rest, are dropped."""
    kept = events.where(F.coalesce(collapse_ws(text), F.lit("")) != "")
    return ordered(kept, key, order, lag={"_before": text}).where(~F.col("_before").eqNullSafe(F.col(text))).drop("_before")


def wrap_words(sentence: str, limit: int = MAX_CHARS) -> list[str]:
    lines: list[list[str]] = []
    size = limit + 1
    for w in sentence.split():
        if size + len(w) + 1 > limit:
            lines.append([])
            size = -1
        lines[-1].append(w)
        size += len(w) + 1
    return [" ".join(x) for x in lines]


def group_paragraphs(text: str, per: int = PER, limit: int = MAX_CHARS) -> list[str]:
    text = " ".join(text.split())
    if not text:
        return []
    out: list[list[str]] = [[]]
    size = 0
    for s in re.split(r"(?<=[.!?。！？])\s+", text):
        for piece in [s] if len(s) <= limit else wrap_words(s, limit):
            if len(out[-1]) >= per or size >= limit:
                out.append([])
                size = 0
            out[-1].append(piece)
            size += len(piece)
    return [" ".join(x) for x in out if x]


@arrow_udf("array<string>")
def _paragraphs(text):
    return None if text is None else group_paragraphs(text)


def paragraphs(c: Column | str) -> Column:
    """Readable paragraphs: up to four sentences or 700 characters each; longer sentences are wrapped at words."""
    return _paragraphs(_c(c))


def pack_blocks(text: str, limit: int = CHUNK_CHARS) -> list[str]:
    blocks = [b for b in (x.strip() for x in re.split(r"\n\s*\n", text)) if b]
    out: list[list[str]] = []
    size = 0
    for b in blocks:
        if not out or size + len(b) + 2 > limit:
            out.append([])
            size = 0
        size += len(b) + (2 if out[-1] else 0)
        out[-1].append(b)
    return ["\n\n".join(x) for x in out] or [""]


def chunks(c: Column | str, limit: int = CHUNK_CHARS) -> Column:
    """Blocks between blank lines packed in order into chunks of at most ``limit``; a larger block stands alone."""

    @arrow_udf("array<string>")
    def pack(text):
        return None if text is None else pack_blocks(text, limit)

    return pack(_c(c))


def split_half(c: Column | str) -> Column:
    """Two halves: of the blocks, if there are two or more, else of the characters."""
    c = _c(c)
    blocks = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda b: F.regexp_replace(b, f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$", "")), lambda b: b != "")
    n, half = F.size(blocks), F.floor(F.char_length(c) / 2).cast("int")
    k = F.floor(n / 2).cast("int")
    by_block = F.array(F.array_join(F.slice(blocks, F.lit(1), F.greatest(k, F.lit(0))), "\n\n"), F.array_join(F.slice(blocks, k + 1, F.greatest(n, F.lit(1))), "\n\n"))
    return F.when(c.isNull(), None).when(n >= 2, by_block).otherwise(F.array(F.substring(c, F.lit(1), half), F.substring(c, half + 1, F.char_length(c))))


def batches(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows per key, from 0; the rest makes a shorter one."""
    return numbered(rows, key, order, "_n").withColumn("batch", F.expr(f"(_n - 1) div {size}")).drop("_n")


def even_sample(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """``n`` rows per key, evenly spaced in the order; all, if there are no more."""
    sizes = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_size"))
    # Row i is picked if it is floor(j * size / n) for some j, computed in doubles.
    placed = numbered(rows, key, order, "_n").join(sizes, F.col(key) == F.col("_k")).withColumn("_i", F.col("_n") - 1)
    step = F.col("_size") / F.lit(float(n))
    near = F.floor(F.col("_i") / step)
    hit = F.exists(F.array(near - 1, near, near + 1), lambda j: (j >= 0) & (j < n) & (F.floor(j * step) == F.col("_i")))
    return placed.where((F.col("_size") <= n) | hit).drop("_n", "_k", "_size", "_i")


def uniform_grid(videos: DataFrame, key: str, duration_s: str, every: float) -> DataFrame:
    """key, k, timestamp_s, path: the sampling times of a video, with names by time; names in one second get _1, _2, ..."""
    from reelspark.functions.text import ts_display

    ok = F.col(duration_s).isNotNull() & ~F.isnan(duration_s) & (F.col(duration_s) >= 0)
    grid = videos.where(ok).select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col(duration_s) / every).cast("int"))).alias("k"))
    at = F.col("k") * F.lit(every)
    nth = F.col("k") - F.ceil(F.floor(at) / F.lit(every)).cast("int")
    again = F.when(nth > 0, F.concat(F.lit("_"), nth.cast("string"))).otherwise("")
    name = F.concat(F.replace(ts_display(at, always_hours=True), F.lit(":"), F.lit("_")), again, F.lit(".jpg"))
    return grid.select(key, "k", at.alias("timestamp_s"), name.alias("path"))
