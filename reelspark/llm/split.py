"""Cut oversized texts into balanced, overlapping pieces at natural boundaries.

A text is first read as atoms that may be cut apart: sentences; in a sentence above the limit its words; in a word
above the limit its characters. So cuts fall between sentences wherever the limit allows. The smallest possible number
of pieces sets equal-length targets, each target snaps to the strongest boundary near it, and pieces are added while
any limit fails, one by one at first, then in doubling steps up to the number of atoms; where the first few numbers keep
the limit, the one that leaves most pieces room for their overlap is taken. Where no number keeps the limit, each piece is
filled as far as it goes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import collapse_ws
from reelspark.session import spread

SENTENCE_END = regex.compile(r"[.!?](?= )|[。！？]")
PIECES = "array<struct<piece:int,start:int,overlap:int,text:string,cut:string>>"
ARROW_PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int32()), ("overlap", pa.int32()), ("text", pa.string()), ("cut", pa.string())]))
CUTS = {3: "sentence", 2: "word", 1: "char"}


def boundaries(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Places where the normalised ``text`` may be cut, and their strengths (3 sentence, 2 word, 1 char)."""
    places: list[int] = []
    strengths: list[int] = []
    start = 0
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        # The space behind a sentence goes with it, so the next one starts on its first character.
        stop = end + 1 if end < len(text) and text[end] == " " else end
        if len(text[start:end].strip()) > limit:
            word_at = start
            for word in text[start:stop].split(" "):
                if len(word) > limit:
                    for k in range(1, len(word)):
                        places.append(word_at + k)
                        strengths.append(1)
                word_at += len(word) + 1
                if word_at < stop:
                    places.append(word_at)
                    strengths.append(2)
        if stop < len(text):
            places.append(stop)
            strengths.append(3)
        start = stop
    return places, strengths


def balanced_cuts(length: int, places: list[int], ends: list[int], strengths: list[int], limit: int, overlap: int) -> list[int]:
    """Cut places so that no piece exceeds ``limit``, near equal-length targets; overlap may shrink where it must.

    ``ends`` says where a piece that is cut at a place ends: the space before the place isn't part of it.
    """
    room = max(1, limit - overlap)
    filled, at = [], 0  # each piece as far as it goes: no cuts can be fewer
    while length - at > limit:
        j = bisect_right(ends, at + limit) - 1
        if places[j] <= at:
            raise AssertionError("atoms exceed the limit")
        at = places[j]
        filled.append(at)
    least = max(1 + -(-(length - limit) // room), len(filled) + 1)
    tries, step = list(range(least, least + 6)), 2
    while tries[-1] + step <= len(places) + 1:
        tries.append(tries[-1] + step)
        step *= 2
    best: tuple[int, list[int]] | None = None
    for n, pieces in enumerate(tries):
        if best is not None and n >= 6:
            break
        cuts = _snapped(length, places, ends, strengths, limit, room, pieces)
        if cuts is not None:
            # How many pieces leave room for less than half of the overlap.
            most = limit - (overlap + 1) // 2
            tight = sum((ends[bisect_right(places, b) - 1] if b < length else b) - a > most for a, b in zip(cuts, [*cuts[1:], length], strict=True))
            if best is None or tight < best[0]:
                best = (tight, cuts)
            if not tight:
                break
    return filled if best is None else best[1]  # filled: boundaries so uneven that no equal targets keep the limit


def _snapped(length: int, places: list[int], ends: list[int], strengths: list[int], limit: int, room: int, pieces: int) -> list[int] | None:
    """The cuts nearest to equal-length targets, or None if a piece exceeds the limit."""
    cuts, at = [], 0
    for i in range(1, pieces):
        target = i * length // pieces
        furthest = bisect_right(ends, at + limit) - 1
        lowest = bisect_right(places, at)
        if lowest > furthest:
            return None
        reach = max(1, length // pieces // 2)
        lo = max(lowest, bisect_right(places, target - reach))
        hi = min(furthest, bisect_right(places, target + reach) - 1)
        if lo > hi:
            best = furthest if target > places[furthest] else lowest
        else:
            roomy = bisect_right(ends, at + (room if at else limit)) - 1
            # Where a boundary of the same strength leaves room for the overlap, those beyond it don't count.
            best = max(range(lo, hi + 1), key=lambda j: (strengths[j], j <= roomy, -abs(places[j] - target), -j))
        at = places[best]
        cuts.append(at)
    return cuts if length - at <= limit else None


def split_text(text: str, limit: int, overlap: int) -> list[dict]:
    """Pieces of an already normalised text; each piece after the first starts with up to ``overlap`` characters of the one before."""
    if len(text) <= limit:
        return [{"piece": 0, "start": 0, "overlap": 0, "text": text, "cut": None}]
    places, strengths = boundaries(text, limit)
    ends = [p - (text[p - 1] == " ") for p in places]
    cuts = balanced_cuts(len(text), places, ends, strengths, limit, overlap)
    weakest = CUTS[min(strengths[bisect_right(places, c) - 1] for c in cuts)]
    edges = [0, *cuts, len(text)]
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        body = text[a:b].rstrip(" ")
        back = 0
        if i:
            back = max(0, min(overlap, limit - len(body), a - edges[i - 1]))
            # Begin the repeated part on a word, where the words before the cut allow it.
            space = text.find(" ", max(0, a - back - 1), a - 1)
            if back and 0 < a - back and text[a - back - 1] != " " and space >= 0:
                back = a - space - 1
        out.append({"piece": i, "start": a, "overlap": back, "text": text[a - back : a] + body, "cut": weakest})
    return out


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = batch.column("id")
            for lo in range(0, len(texts), 512):
                some = [None if t is None else split_text(" ".join(t.split()), limit, overlap) for t in texts[lo : lo + 512]]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(some)), pa.array(some, ARROW_PIECES)], names=["id", "pieces"])

    return run


def split_oversized(items: DataFrame, *, item: str, text: str | Column, limit: int, overlap: int) -> DataFrame:
    """Columns item, piece (from 0), start, overlap, text, cut: every item whole or in pieces of at most ``limit`` code points.

    White space is collapsed first. ``cut`` is the weakest boundary an oversized item is cut at (sentence, word or char),
    null where an item fits; words are cut only in sentences above the limit, characters only in words above it. A null text gives one row with a null text; an empty one a row with an empty text.
    The bodies of an item's pieces, without their overlaps, add up to its text but for the space at each cut. Other
    columns aren't read. Texts within the limit never leave the JVM.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("need limit >= 1 and 0 <= overlap < limit")
    text = F.col(text) if isinstance(text, str) else text
    rows = spread(items.select(F.col(item).alias("id"), text.alias("text")))
    # Collapsing only shortens a text, so the rest is the few that may need cutting.
    fits = F.col("text").isNull() | (F.char_length("text") <= limit)
    small = rows.where(fits).select(
        F.col("id").alias(item), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(0).alias("overlap"), collapse_ws("text").alias("text"), F.lit(None).cast("string").alias("cut")
    )
    large = rows.where(~fits)
    id_type = rows.schema["id"].dataType.simpleString()
    cut = large.mapInArrow(_pieces(limit, overlap), f"id {id_type}, pieces {PIECES}").select("id", F.inline("pieces"))
    return small.unionByName(cut.withColumnRenamed("id", item))


def paragraph_pieces(paragraphs: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Paragraphs cut by the ``paragraph_piece`` limit of the table of limits."""
    limit = size_limits.where("limit_name = 'paragraph_piece'").select("max_size", "overlap_size").first()
    if limit is None:
        raise ValueError("size_limits has no paragraph_piece")
    return split_oversized(paragraphs, item="para_id", text="text", limit=limit[0], overlap=limit[1])
