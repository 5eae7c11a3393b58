"""Markup residue in the texts of rendered pages: found by slot, and cleaned."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.markup import languages, to_plain
from reelspark.llm.template import ASIDE, Finish, extract_slots


def _pairs(*names: str) -> tuple[str, pa.DataType]:
    return f"array<struct<{','.join(f'{n}:string' for n in names)}>>", pa.list_(pa.struct([(n, pa.string()) for n in names]))


def found_markup(slots: list[dict]) -> list[dict]:
    """The markup languages readable in each place."""
    seen = {(s["place"], m) for s in slots if s["place"] and not s["code"] for m in languages(s["text"].replace(ASIDE, " "))}
    return [{"place": place, "markup": markup} for place, markup in sorted(seen)]


def clean_blocks(slots: list[dict], place: str) -> str:
    """The slots of a place as text: code in fences, the cells of a table row in one line, other blocks with their lead."""
    out: list[str] = []
    row = 0
    for s in slots:
        if s["place"] != place:
            continue
        if s["code"]:
            out.append("```\n" + s["text"].strip("\n") + "\n```")
            row = 0
            continue
        text = to_plain(s["text"])
        for aside in s["asides"]:
            text = text.replace(ASIDE, aside, 1)
        if not text:
            continue
        if s["row"]:
            text = " ".join(text.split("\n"))
            if s["row"] == row:
                out[-1] += f" | {text}"
                continue
        elif s["lead"] and not text.startswith(("#", "-")):
            text = s["lead"] + text
        out.append(text)
        row = s["row"]
    return "\n\n".join(out)


def clean_places(slots: list[dict]) -> list[dict]:
    return [{"place": place, "text": clean_blocks(slots, place)} for place in sorted({s["place"] for s in slots if s["place"]})]


def page_markup(pages: DataFrame) -> DataFrame:
    """Columns page_id, place, markup: the markup languages readable in the body and in the captions of each page.

    Pages without a post-body, with null or empty HTML, or without residue give no rows. A page that comes in several
    rows gives its rows for each.
    """
    found = extract_slots(pages, finish=Finish(found_markup, *_pairs("place", "markup")))
    return found.select("page_id", F.inline("slots"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Columns page_id, place, text: body and captions as clean text, with headings, lists, code and formulas kept."""
    texts = extract_slots(pages, finish=Finish(clean_places, *_pairs("place", "text")))
    return texts.select("page_id", F.inline("slots")).where(F.col("text") != "")
