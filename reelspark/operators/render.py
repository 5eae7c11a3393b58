"""Posts from paragraphs and frames, captions and transcripts as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import html_escape, ms_to_ts, safe_name, source_label, ts_display, url_quote


def figure_html(path: Column, seconds: Column, alt: Column, caption: Column, video: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    link = html_escape(F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&t="), whole.cast("string")))
    return F.concat(
        F.lit('<figure data-timestamp="'), ts_display(seconds, always_hours=True), F.lit('"><a class="image-wrap" href="'), link,
        F.lit('" target="_blank" rel="noopener"><img src="'), html_escape(url_quote(F.coalesce(path, F.lit("")))), F.lit('" alt="'), html_escape(F.coalesce(alt, F.lit(""))),
        F.lit('" loading="lazy"></a><figcaption><span class="caption-text">'), html_escape(F.coalesce(caption, F.lit(""))),
        F.lit('</span><a class="ts-chip" href="'), link, F.lit('" target="_blank" rel="noopener">'), ts_display(seconds), F.lit("</a></figcaption></figure>"),
    )


def paragraph_html(text: Column, start: Column) -> Column:
    anchor = F.when(start.isNotNull(), F.concat(F.lit(' data-srt-start="'), F.floor(start).cast("long").cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit("<p"), anchor, F.lit(">"), html_escape(text), F.lit("</p>"))


def figure_rows(figures: Column) -> Column:
    """One figure alone, more in a row that says how many, three at most."""
    row = F.concat(F.lit('<div class="figure-row" data-count="'), F.least(F.size(figures), F.lit(3)).cast("string"), F.lit('">'), F.array_join(figures, ""), F.lit("</div>"))
    return F.when(F.size(figures) > 1, row).otherwise(F.array_join(figures, ""))


def post_parts(paragraphs: DataFrame, frames: DataFrame, *, key: str = "video_id") -> DataFrame:
    """key, last, p_idx, html: the parts of posts, to be written in the order of last and p_idx.

    Each paragraph is followed by its frames in time; the part of frames without a paragraph comes last. ``paragraphs``
    has p_idx, text, start_s (may be null); ``frames`` has p_idx (-1: none), timestamp_s, path, alt_text, caption, frame_id.
    """
    figure = figure_html(F.col("path"), F.col("timestamp_s"), F.col("alt_text"), F.col("caption"), F.col(key))
    shown = frames.where(F.col("timestamp_s").isNotNull()).select(key, "p_idx", "timestamp_s", "frame_id", figure.alias("figure"))
    rows = shown.groupBy(key, "p_idx").agg(figure_rows(F.transform(F.array_sort(F.collect_list(F.struct("timestamp_s", "frame_id", "figure"))), lambda x: x["figure"])).alias("figures"))
    texts = paragraphs.select(key, "p_idx", paragraph_html(F.coalesce("text", F.lit("")), F.col("start_s")).alias("p"))
    parts = texts.join(rows, [key, "p_idx"], "full")
    tail = F.col("p").isNull()
    html = F.when(tail, F.concat(F.lit('<section class="tail-section"><h2>Additional frames</h2>'), F.col("figures"), F.lit("</section>"))).otherwise(F.concat_ws("\n    ", "p", "figures"))
    return parts.select(key, tail.cast("int").alias("last"), "p_idx", html.alias("html"))


def post_bodies(paragraphs: DataFrame, frames: DataFrame, *, key: str = "video_id") -> DataFrame:
    """key, body: the parts of each post in order. One post is one output value here, so its parts meet in one row."""
    placed = post_parts(paragraphs, frames, key=key).select(key, F.struct("last", "p_idx", "html").alias("part"))
    return placed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["html"]), "\n    ").alias("body"))


def page(title: Column, url: Column, lang: Column, body: Column) -> Column:
    return F.concat(
        F.lit('<!doctype html>\n<html lang="'), lang, F.lit('"><head><meta charset="utf-8"><title>'), html_escape(title),
        F.lit('</title></head><body><article><header class="post-hero"><h1 class="post-title">'), html_escape(title),
        F.lit('</h1><div class="post-meta"><a class="source-pill" href="'), html_escape(url), F.lit('">'), html_escape(source_label(url)),
        F.lit('</a></div></header><div class="post-body">'), body, F.lit("</div></article></body></html>\n"),
    )


def srt_lines(cues: DataFrame, key: str = "video_id", order: str = "seq") -> DataFrame:
    """key, n, block: cues numbered from 1 in SubRip form; write them sorted by n."""
    from reelspark.operators.ordered import numbered

    block = F.concat(F.col("n").cast("string"), F.lit("\n"), ms_to_ts("start_ms"), F.lit(" --> "), ms_to_ts("end_ms"), F.lit("\n"), F.col("text"), F.lit("\n"))
    return numbered(cues, key, [order], "n").select(key, "n", block.alias("block"))


def srt_files(cues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, srt: one SubRip file per key, which is one value of the output; no cue ends behind the start of the next."""
    cue = F.struct(*order, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("text").alias("_t"))
    files = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(cue)).alias("c"))

    def block(x: Column, i: Column) -> Column:
        end = F.least(x["_e"], F.get(F.col("c"), i + 1)["_s"])
        return F.concat((i + 1).cast("string"), F.lit("\n"), ms_to_ts(x["_s"]), F.lit(" --> "), ms_to_ts(end), F.lit("\n"), x["_t"], F.lit("\n"))

    return files.select(*keys, F.array_join(F.transform("c", block), "\n").alias("srt"))


def vtt_files(cues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, vtt: one WebVTT file per key, which is one value of the output."""
    point = lambda c: F.replace(ms_to_ts(c), F.lit(","), F.lit("."))
    block = F.concat(point("start_ms"), F.lit(" --> "), point("end_ms"), F.lit("\n<c>"), F.col("text"), F.lit("</c>"))
    files = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, block.alias("_b")))).alias("c"))
    return files.select(*keys, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["_b"]), "\n\n")).alias("vtt"))


def json3_files(cues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, json: one JSON caption file per key, which is one value of the output."""
    event = F.struct(F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))
    files = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, event.alias("_e")))).alias("c"))
    return files.select(*keys, F.to_json(F.struct(F.transform("c", lambda x: x["_e"]).alias("events"))).alias("json"))


def _number(idx: Column, behind: str) -> Column:
    """The place in the playlist, padded to two digits or as many as needed, and what stands behind it; nothing where it's null."""
    digits = idx.cast("string")
    return F.coalesce(F.concat(F.lpad(digits, F.greatest(F.lit(2), F.char_length(digits)), F.lit("0")), F.lit(behind)), F.lit(""))


def transcript_md(idx: Column, title: Column, url: Column, paragraphs: Column) -> Column:
    head = F.concat(F.lit("# "), _number(idx, ". "), title)
    link = F.concat(F.lit("[YouTube]("), url, F.lit(")"))
    return F.concat(F.rtrim(F.concat_ws("\n\n", F.concat(head, F.lit("\n\n"), link), F.array_join(paragraphs, "\n\n"))), F.lit("\n"))


def transcript_name(idx: Column, title: Column) -> Column:
    return F.concat(_number(idx, " - "), safe_name(title))


def page_numbers(rows: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` among siblings and ``number``, padded to two digits or as many as needed."""
    from reelspark.operators.ordered import numbered

    sizes = rows.groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("_n"))
    placed = numbered(rows, parent, order, "position").join(sizes, F.col(parent) == F.col("_p"))
    digits = F.greatest(F.lit(2), F.char_length(F.col("_n").cast("string")))
    return placed.withColumn("number", F.lpad(F.col("position").cast("string"), digits, F.lit("0"))).drop("_p", "_n")
