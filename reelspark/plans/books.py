"""Queries on e-books: each video's listing entry is packed as a book, written out as bytes, and read back."""

from __future__ import annotations

import io
import struct
import zipfile
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.udf import arrow_udf
from reelspark.plans.registry import query, squeezed, table
from reelspark.sources import epub


def _png(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", width, height) + b"\x08\x02\x00\x00\x00"


@arrow_udf("binary")
def _packed(title, creator, language, idx):
    """A book of two chapters: nav or NCX contents by turns, a figure, an image inside a paragraph, one that is missing."""
    n = idx or 0
    dc = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in (("title", title), ("creator", creator), ("language", language)) if v)
    contents = (
        '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if n % 2 == 0 else '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    )
    name = escape(title or "")
    one = (
        f'<html><body><h1 id="top">{name}</h1><p>Opening of number {n}.</p><figure><img src="img/a.png" alt="A {n}"/><figcaption>Figure {n}</figcaption></figure><p>Behind it.</p>'
        f'<h2 id="t1">Topic</h2><p>Text <img src="../OPS/img/b%20c.png"/> inside {n}.</p><p id="t2">Last.</p></body></html>'
    )
    two = '<html><body><p>Second.</p><img src="img/gone.png"/></body></html>'
    nav = (
        f'<html><body><nav epub:type="toc"><ol><li><a href="c1.xhtml">Ch: {name}</a><ol><li><a href="c1.xhtml#t1">Topic {n}</a></li><li><a href="c1.xhtml#t2">Last</a></li></ol></li>'
        '<li><a href="c2.xhtml">Second</a></li></ol></nav></body></html>'
    )
    ncx = (
        f'<ncx><navMap><navPoint><navLabel><text>Ch: {name}</text></navLabel><content src="c1.xhtml"/><navPoint><navLabel><text>Topic {n}</text></navLabel><content src="c1.xhtml#t1"/></navPoint>'
        '<navPoint><navLabel><text>Last</text></navLabel><content src="c1.xhtml#t2"/></navPoint></navPoint><navPoint><navLabel><text>Second</text></navLabel><content src="c2.xhtml"/></navPoint></navMap></ncx>'
    )
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        "OPS/book.opf": f'<package xmlns:dc="d"><metadata>{dc}</metadata><manifest>{contents}<item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="c2" href="c2.xhtml" media-type="application/xhtml+xml"/><item id="a" href="img/a.png" media-type="image/png"/><item id="b" href="img/b%20c.png" media-type="image/png"/>'
        '<item id="s" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="c1"/><itemref idref="lost"/><itemref idref="c2"/></spine></package>',
        "OPS/nav.xhtml": nav,
        "OPS/toc.ncx": ncx,
        "OPS/c1.xhtml": one,
        "OPS/c2.xhtml": two,
        "OPS/s.css": "p {}",
        "OPS/img/a.png": _png(10 + n, 20),
        "OPS/img/b c.png": _png(7, 30 + n),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, data in files.items():
            z.writestr(path, data)
    return out.getvalue()


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "videos").select("video_id", "title", "channel", "lang", "idx")
    return rows.select(F.col("video_id").alias("path"), _packed("title", "channel", "lang", "idx").alias("content"))


_V = f"""
v as (
  select video_id as path, coalesce(idx, 0) as n, nullif({squeezed('title')}, '') as title, nullif({squeezed('channel')}, '') as creator, nullif({squeezed('lang')}, '') as language from videos),
w as (select *, {squeezed("'Ch: ' || coalesce(title, '')")} as chapter from v),
t as (
  select path, n, unnest(['1', '1.1', '1.2', '2']) as node, unnest([chapter, 'Topic ' || n, 'Last', 'Second']) as label, unnest(['OPS/c1.xhtml', 'OPS/c1.xhtml', 'OPS/c1.xhtml', 'OPS/c2.xhtml']) as file,
    unnest([null, 't1', 't2', null]) as anchor, unnest([chapter, chapter || ' > Topic ' || n, chapter || ' > Last', 'Second']) as breadcrumb
  from w)
"""


@query(f"with {_V} select path, title, creator, language, 'OPS/c1.xhtml OPS/c2.xhtml' as spine, 6 as items, case when n % 2 = 0 then 'OPS/nav.xhtml' end as nav, case when n % 2 <> 0 then 'OPS/toc.ncx' end as ncx from w")
def epub_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packages say of their books; a spine entry without an item is left out."""
    p = epub.packages(_books(spark, sf_dir))
    return p.select("path", "title", "creator", "language", F.array_join("spine", " ").alias("spine"), F.size("manifest").alias("items"), "nav", "ncx")


@query(f"with {_V} select path, node, label, file, anchor, breadcrumb from t")
def epub_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents, from a navigation document or an NCX, flattened in order."""
    rows = epub.toc_rows(_books(spark, sf_dir))
    return rows.select("path", F.array_join("node_path", ".").alias("node"), "label", "file", "anchor", F.array_join("breadcrumb", " > ").alias("breadcrumb"))


_FILE_NAME = "left(case when {x} = '' then 'untitled' else {x} end, 120)"
_CLEAN = "regexp_replace(" + squeezed("regexp_replace({c}, '[\\\\/:*?\"<>|#%&{{}}\\[\\]\\x00-\\x1f]+', ' ', 'g')") + ", '^[. ]+|[. ]+$', '', 'g')"


@query(
    f"with {_V}, x as (select *, {_CLEAN.replace('{c}', 'chapter').replace('{{', '{').replace('}}', '}')} as c from w), y as (select *, {_FILE_NAME.format(x='c')} as f from x)\n"
    "select path, unnest(['01. ' || f || '/00. ' || f || '.html', '01. ' || f || '/01. Topic ' || n || '.html', '01. ' || f || '/02. Last.html', '02. Second.html']) as out_path, unnest([1, 1, 0, 1]) as images from y"
)
def epub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as folders of pages; how many images each page holds."""
    return epub.book_pages(_books(spark, sf_dir)).select("path", "out_path", F.size(F.regexp_extract_all("html", F.lit("(<img)"), F.lit(1))).alias("images"))


@query(rf"""
with {_V}
select path, unnest(['OPS/img/a.png', 'OPS/img/b c.png', 'OPS/img/gone.png']) as source_image, unnest([0, 0, 1]) as spine_index, unnest([0, 1, 2]) as seq, unnest(['A ' || n, '', '']) as alt,
  unnest([chapter, chapter || ' > Topic ' || n, 'Second']) as breadcrumb, unnest([coalesce(title, ''), 'Topic', '']) as nearest_heading, unnest([true, false, false]) as in_figure, unnest(['Figure ' || n, '', '']) as caption,
  unnest(['Opening of number ' || n || '.', 'Behind it.', 'Second.']) as context_before, unnest(['Behind it.', 'Text inside ' || n || '.', '']) as context_after,
  unnest([true, true, false]) as present, unnest([10 + n, 7, null]) as width, unnest([20, 30 + n, null]) as height
from w""")
def epub_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image of every book with its place and what stands around it."""
    seen = epub.image_occurrences(_books(spark, sf_dir))
    shown = ("source_image", "spine_index", "seq", "alt", "nearest_heading", "in_figure", "caption", "context_before", "context_after", "present", "width", "height")
    return seen.select("path", F.array_join("breadcrumb", " > ").alias("breadcrumb"), *shown)


@query("select video_id as path, 2 as image_count, 3 as occurrence_count, 1 as in_figure, 1 as with_caption from videos")
def epub_image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.image_stats(epub.image_occurrences(_books(spark, sf_dir)))


@query(f"""
with {_V}
select path, coalesce(title, '') as book, chapter as first_label, 'Last' as last_child, 2 as image_count, 'OPS/img/b c.png' as second_image, n + 30 as second_height from w""")
def epub_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books as nested JSON, some of its values read back."""
    p = epub.book_payloads(_books(spark, sf_dir))
    at = lambda path: F.get_json_object("payload", path)
    return p.select(
        "path",
        F.coalesce(at("$.book"), F.lit("")).alias("book"),
        at("$.toc[0].label").alias("first_label"),
        at("$.toc[0].children[1].label").alias("last_child"),
        at("$.image_count").cast("int").alias("image_count"),
        at("$.images[1].source_image").alias("second_image"),
        at("$.images[1].height").cast("int").alias("second_height"),
    )


@query("select count(*) as books, 0 as failed, 4 * count(*) as pages, 3 * count(*) as assets from videos")
def epub_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.book_totals(_books(spark, sf_dir))


@query("select video_id as path, unnest(['assets/a.png', 'assets/b c.png', 'assets/s.css']) as out_path, unnest([29, 29, 4]) as bytes from videos")
def epub_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that pages link to, under names of their own."""
    return epub.book_assets(_books(spark, sf_dir)).select("path", "out_path", F.octet_length("content").alias("bytes"))
