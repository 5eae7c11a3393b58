"""Caption and transcript files as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.functions.text import UNICODE_SPACE, _c, collapse_ws, strip_tags
from reelspark.functions.udf import arrow_udf
from reelspark.sources.files import glob_of, without

CUES = "array<struct<seq:int,start_ms:bigint,end_ms:bigint,text:string>>"
JSON3 = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,aAppend:int,segs:array<struct<utf8:string>>>>>"


def json3_cues(files: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """key, seq, start_ms, end_ms, text of JSON caption files: events that append or are blank are dropped.

    A broken or empty file has no rows. All in the JVM.
    """
    events = files.select(F.col(key), F.posexplode(F.from_json(value, JSON3)["events"]).alias("seq", "e"))
    text = collapse_ws(F.array_join(F.transform(F.col("e.segs"), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce(F.col("e.tStartMs"), F.lit(0))
    kept = events.where((F.coalesce(F.col("e.aAppend"), F.lit(0)) != 1) & (F.size("e.segs") > 0))
    return kept.select(key, "seq", start.alias("start_ms"), (start + F.coalesce(F.col("e.dDurationMs"), F.lit(0))).alias("end_ms"), text.alias("text")).where("text != ''")


def _ms(h: str, m: str, s: str, frac: str) -> int:
    return int(h) * 3600000 + int(m) * 60000 + int(s) * 1000 + int(frac)


VTT_TIME = re.compile(r"(\d\d):(\d\d):(\d\d)[.,](\d{3})\s*-->\s*(\d\d):(\d\d):(\d\d)[.,](\d{3})")
SRT_TIME = re.compile(r"(\d+):(\d+):(\d+)[.,](\d+)\s*-->\s*(\d+):(\d+):(\d+)[.,](\d+)")


def parse_vtt(text: str) -> list[tuple[int, int, int, str]]:
    out: list[tuple[int, int, int, str]] = []
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        lines = block.split("\n")
        times = [(i, m) for i, line in enumerate(lines) if (m := VTT_TIME.search(line))]
        if not times:
            continue
        g = times[-1][1].groups()  # the last time line counts; what follows the first is text
        body = [line for i, line in enumerate(lines) if i > times[0][0] and not VTT_TIME.search(line)]
        said = " ".join(re.sub(r"<[^>]+>", "", " ".join(body)).split())
        if said and (not out or out[-1][3] != said):
            out.append((len(out), _ms(*g[:4]), _ms(*g[4:]), said))
    return out


def parse_srt(text: str) -> list[tuple[int, int, int, str]]:
    out: list[tuple[int, int, int, str]] = []
    block: list[str] = []
    for line in [*text.splitlines(), ""]:
        if line.strip():
            block.append(line)
            continue
        at = next((i for i, x in enumerate(block) if SRT_TIME.search(x)), None)
        if at is not None:
            g = SRT_TIME.search(block[at]).groups()
            out.append((len(out), _ms(*g[:4]), _ms(*g[4:]), " ".join(x.strip() for x in block[at + 1 :]).strip()))
        block = []
    return out


@arrow_udf(CUES)
def _vtt(text):
    return None if text is None else parse_vtt(text)


@arrow_udf(CUES)
def _srt(text):
    return None if text is None else parse_srt(text)


def vtt_cues(files: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """key, seq, start_ms, end_ms, text of WebVTT files; a text equal to the last kept one is dropped."""
    return files.select(key, _vtt(value).alias("c")).select(key, F.inline("c"))


def srt_cues(files: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """key, seq, start_ms, end_ms, text of SubRip files; the first time line of a block counts, empty texts stay."""
    return files.select(key, _srt(value).alias("c")).select(key, F.inline("c"))


def read_files(spark: SparkSession, path: str, glob: str | tuple[str, ...], exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, value: whole text files below a folder, by one or several name patterns, without those of the excluded names."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob_of(glob)).text(path)
    return without(files.select(F.col("_metadata.file_path").alias("path"), "value"), exclude)


def md_paragraphs(text: Column | str) -> Column:
    """The paragraphs of a transcript: its title, video link and blank lines at the top skipped, lines joined."""
    body = F.regexp_replace(_c(text), r"\A(?:[^\S\n]*\n|# [^\n]*(?:\n|\z)|\[YouTube[^\n]*(?:\n|\z))*", "")
    blocks = F.split(body, r"\n[^\S\n]*(?:\n[^\S\n]*)+")
    return F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, f"[{UNICODE_SPACE}]*\\n[{UNICODE_SPACE}]*", " "))), lambda b: b != "")


def pick_captions(files: DataFrame, video: str = "video_id", name: str = "name", auto: bool = False) -> DataFrame:
    """The caption file of each video: manual before automatic (``-orig``), .json3 before .vtt, then by name.

    Automatic ones only count with ``auto``. A video has few files, so its window is small.
    """
    is_auto = F.col(name).contains("-orig")
    rows = files.where(F.col(name).rlike(r"\.(json3|vtt)$")).withColumn("_auto", is_auto)
    rows = rows if auto else rows.where(~F.col("_auto"))
    best = Window.partitionBy(video).orderBy("_auto", ~F.col(name).endswith(".json3"), name)
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_auto")


def playlist_entries(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """idx (from 1), video_id, title of tab-separated listing lines; lines without a tab don't count."""
    parts = F.split(value, "\t", 2)
    rows = lines.where(F.col(value).contains("\t")).select(F.col(order).alias("_o"), parts[0].alias("video_id"), F.get(parts, F.lit(1)).alias("title"))
    from reelspark.operators.ordered import numbered

    one = rows.withColumn("_k", F.lit(0))
    return numbered(one, "_k", ["_o"], "idx").select(F.col("idx").cast("int").alias("idx"), "video_id", "title")


def strip_caption_tags(c: Column | str) -> Column:
    return collapse_ws(strip_tags(c))
