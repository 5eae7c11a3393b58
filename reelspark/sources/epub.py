"""E-book packages: metadata, table of contents, chapters as pages, and their images, one row in, rows out."""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import zipfile
from dataclasses import dataclass, field
from urllib.parse import quote, unquote
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.udf import arrow_udf
from reelspark.sources.htmltree import Element, Event, parse, stream

CONTENT_TYPES = frozenset(("application/xhtml+xml", "text/html", "application/x-dtbncx+xml"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PARAGRAPHS = frozenset(("p", "li"))
CONTEXT_CHARS, NAME_CHARS = 400, 120

TOC_ROWS = "array<struct<node_path:array<int>,depth:int,label:string,file:string,anchor:string,breadcrumb:array<string>>>"
PACKAGE = f"struct<title:string,creator:string,language:string,manifest:array<struct<id:string,href:string,type:string,props:string>>,spine:array<string>,nav:string,ncx:string,toc:{TOC_ROWS},toc_json:string,error:string>"
PAGES = "array<struct<out_path:string,html:string>>"
ASSETS = "array<struct<out_path:string,content:binary>>"
OCCURRENCES = "array<struct<source_image:string,file:string,spine_index:int,seq:int,alt:string,css_class:string,role:string,breadcrumb:array<string>,nearest_heading:string,in_figure:boolean,caption:string,context_before:string,context_after:string,present:boolean,width:int,height:int>>"


class UnsafeXml(ValueError):
    """The document declares entities."""


def safe_xml(data: bytes) -> ElementTree.Element:
    if re.search(rb"<!entity", data, re.IGNORECASE):
        raise UnsafeXml("entity declarations are refused")
    return ElementTree.fromstring(data)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if isinstance(e.tag, str) and _local(e.tag) == name]


def _join(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(base, unquote(href)))


def target_of(href: str | None, base: str) -> tuple[str | None, str | None]:
    if not href:
        return None, None
    path, _, anchor = href.partition("#")
    return (_join(base, path) if path else None), anchor or None


def read_package(z: zipfile.ZipFile) -> dict:
    container = safe_xml(z.read("META-INF/container.xml"))
    opf_path = next(e.get("full-path") for e in _all(container, "rootfile"))
    base, opf = posixpath.dirname(opf_path), safe_xml(z.read(opf_path))
    meta = {k: next((_squeeze(e.text) for e in _all(opf, k) if _squeeze(e.text)), None) for k in ("title", "creator", "language")}
    items = {e.get("id"): {"href": _join(base, e.get("href")), "type": e.get("media-type") or "", "props": e.get("properties") or ""} for e in _all(opf, "item") if e.get("id") and e.get("href")}
    spine_el = next(iter(_all(opf, "spine")), None)
    order = [e.get("idref") for e in _all(opf, "itemref")]
    nav = next((i["href"] for i in items.values() if "nav" in i["props"].split()), None)
    ncx_id = spine_el.get("toc") if spine_el is not None else None
    ncx = items[ncx_id]["href"] if ncx_id in items else next((i["href"] for i in items.values() if i["type"] == "application/x-dtbncx+xml"), None)
    return {**meta, "manifest": items, "spine": [items[i]["href"] for i in order if i in items], "nav": nav, "ncx": ncx}


def nav_toc(html: str, base: str) -> list[dict]:
    root = parse(html)
    navs = [e for e in root.walk() if e.name == "nav"]
    pick = [n for n in navs if "toc" in n.attrs.get("epub:type", "").split()] or [n for n in navs if n.attrs.get("role") == "doc-toc"] or navs
    top = pick[0].first("ol") if pick else None

    def level(ol: Element) -> list[dict]:
        out = []
        for li in (e for e in ol.elements() if e.name == "li"):
            label = next((e for e in li.elements() if e.name in ("a", "span")), None) or li.first("a") or li.first("span")
            file, anchor = target_of(label.attrs.get("href"), base) if label is not None and label.name == "a" else (None, None)
            sub = next((e for e in li.elements() if e.name == "ol"), None)
            out.append({"label": _squeeze(label.text()) if label is not None else "", "file": file, "anchor": anchor, "children": level(sub) if sub else []})
        return out

    return level(top) if top else []


def ncx_toc(data: bytes, base: str) -> list[dict]:
    root = safe_xml(data)

    def level(el: ElementTree.Element) -> list[dict]:
        out = []
        for p in (c for c in el if isinstance(c.tag, str) and _local(c.tag) == "navPoint"):
            named = next((c for c in p if _local(c.tag) == "navLabel"), None)
            text = next((_squeeze(t.text) for t in named.iter() if _local(t.tag) == "text"), "") if named is not None else ""
            content = next((c for c in p if _local(c.tag) == "content"), None)
            file, anchor = target_of(content.get("src") if content is not None else None, base)
            out.append({"label": text or "(untitled)", "file": file, "anchor": anchor, "children": level(p)})
        return out

    top = next(iter(_all(root, "navMap")), None)
    return level(top) if top is not None else []


def read_toc(z: zipfile.ZipFile, package: dict, spine_fallback: bool = True) -> list[dict]:
    """Navigation document, else NCX, else (with ``spine_fallback``) the spine as flat entries."""
    names = set(z.namelist())
    for kind in ("nav", "ncx"):
        path = package[kind]
        if path and path in names:
            try:
                base = posixpath.dirname(path)
                found = nav_toc(z.read(path).decode("utf-8", "replace"), base) if kind == "nav" else ncx_toc(z.read(path), base)
            except (ElementTree.ParseError, UnsafeXml, KeyError):
                continue
            if found:
                return found
    if not spine_fallback:
        return []
    return [{"label": posixpath.splitext(posixpath.basename(p))[0], "file": p, "anchor": None, "children": []} for p in package["spine"]]


def flatten_toc(toc: list[dict]) -> list[tuple]:
    """(node_path, depth, label, file, anchor, breadcrumb) in pre-order."""
    out: list[tuple] = []

    def walk(nodes: list[dict], path: list[int], crumbs: list[str]) -> None:
        for i, n in enumerate(nodes, 1):
            here = [*crumbs, n["label"]]
            out.append(([*path, i], len(path) + 1, n["label"], n["file"], n["anchor"], here))
            walk(n["children"], [*path, i], here)

    walk(toc, [], [])
    return out


def toc_json(toc: list[dict]) -> list[dict]:
    return [{"label": n["label"], **({"children": toc_json(n["children"])} if n["children"] else {})} for n in toc]


def split_by_anchor(html: str, anchors: list[str]) -> dict[str | None, list[str]]:
    """Body blocks by anchor: from an anchor's own block to that of the next one, its own block at least; None holds what comes first."""
    root = parse(html)
    blocks = (root.first("body") or root).elements()
    wanted, home = set(anchors), {}
    for i, b in enumerate(blocks):
        for el in (b, *b.walk()):
            if el.attrs.get("id") in wanted:
                home.setdefault(el.attrs["id"], i)
    marks = sorted((i, a) for a, i in home.items())
    shown = [b.html() for b in blocks]
    out: dict[str | None, list[str]] = {None: shown[: marks[0][0] if marks else len(blocks)]}
    for k, (i, a) in enumerate(marks):
        until = marks[k + 1][0] if k + 1 < len(marks) else len(blocks)
        out[a] = shown[i : max(until, i + 1)]
    return out


def file_name(label: str) -> str:
    text = _squeeze(re.sub(r"[\\/:*?\"<>|#%&{}\[\]\x00-\x1f]+", " ", label)).strip(". ")
    return (text or "untitled")[:NAME_CHARS]


def unique_names(paths: list[str]) -> dict[str, str]:
    """A file name for each distinct path: its own, or with _1, _2, ... where that is taken."""
    taken: set[str] = set()
    out: dict[str, str] = {}
    for p in paths:
        if p in out:
            continue
        stem, ext = posixpath.splitext(posixpath.basename(p))
        name, k = stem + ext, 0
        while name in taken:
            k += 1
            name = f"{stem}_{k}{ext}"
        taken.add(name)
        out[p] = name
    return out


def assets(z: zipfile.ZipFile, package: dict) -> dict[str, str]:
    present = set(z.namelist())
    return unique_names([i["href"] for i in package["manifest"].values() if i["type"] not in CONTENT_TYPES and i["href"] in present])


def render_page(title: str, blocks: list[str], source: str, names: dict[str, str], depth: int, styles: list[str]) -> str:
    """A page with its style sheets linked and its image links turned to the assets folder."""
    up = "../" * depth + "assets/"
    root = parse("\n".join(blocks))
    base = posixpath.dirname(source)
    for el in root.walk():
        for attr in ("src", "xlink:href", "href"):
            link = el.attrs.get(attr, "")
            if el.name in ("img", "image") and link and not re.match(r"(?:https?:|data:|#)", link):
                found = names.get(_join(base, link.partition("#")[0]))
                if found:
                    el.attrs[attr] = up + quote(found)
    links = "".join(f'<link rel="stylesheet" href="{up}{quote(s)}">' for s in styles)
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{_escape(title)}</title>{links}</head><body>{root.html()}</body></html>"


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def convert_book(data: bytes) -> list[tuple[str, str]]:
    """(out_path, html): leaves as numbered pages, parents as folders with their own text as page 00."""
    z = zipfile.ZipFile(io.BytesIO(data))
    package = read_package(z)
    toc, names = read_toc(z, package), assets(z, package)
    styles = [names[i["href"]] for i in package["manifest"].values() if i["type"] == "text/css" and i["href"] in names]
    wanted: dict[str, set[str]] = {}
    for _, _, _, file, anchor, _ in flatten_toc(toc):
        if file:
            wanted.setdefault(file, set()).update([anchor] if anchor else [])
    present, segments, out = set(z.namelist()), {}, []

    def body(node: dict) -> list[str]:
        file = node["file"]
        if not file or file not in present:
            return []
        if file not in segments:
            segments[file] = split_by_anchor(z.read(file).decode("utf-8", "replace"), sorted(wanted[file]))
        return segments[file].get(node["anchor"], segments[file][None])

    def emit(nodes: list[dict], folder: str, depth: int) -> None:
        width = max(2, len(str(len(nodes))))
        for i, n in enumerate(nodes, 1):
            label, blocks = f"{i:0{width}d}. {file_name(n['label'])}", body(n)
            if not n["children"]:
                out.append((f"{folder}{label}.html", render_page(n["label"], blocks, n["file"] or "", names, depth, styles)))
                continue
            if parse("".join(blocks)).text().strip() or "<img" in "".join(blocks):
                out.append((f"{folder}{label}/00. {file_name(n['label'])}.html", render_page(n["label"], blocks, n["file"] or "", names, depth + 1, styles)))
            emit(n["children"], f"{folder}{label}/", depth + 1)

    emit(toc, "", 0)
    return out


def image_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG, GIF or JPEG; (None, None) for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    i = 2
    while data[:2] == b"\xff\xd8" and i + 9 < len(data) and data[i] == 0xFF:
        if 0xC0 <= data[i + 1] <= 0xCF and data[i + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[i + 5 : i + 9])
            return w, h
        i += 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    return None, None


@dataclass
class Figure:
    """An outermost figure while it is open."""

    depth: int = 1
    texts: list[str] = field(default_factory=list)
    caption: str = ""
    images: list[dict] = field(default_factory=list)


class ImageWalk:
    """Reads a chapter's events; images wait for the paragraph behind them and for the caption of their figure.

    One capture runs at a time: the start of another heading, paragraph, item or caption begins a new one, and what is
    left of the one around it goes.
    """

    CAPTURED = HEADINGS | PARAGRAPHS | {"figcaption"}

    def __init__(self, crumbs_at: dict[str, list[str]], crumbs: list[str]) -> None:
        self.crumbs_at, self.crumbs = crumbs_at, crumbs
        self.heading = self.before = ""
        self.capture: tuple[str, list[str]] | None = None
        self.figure: Figure | None = None
        self.found: list[dict] = []
        self.without_after = 0  # from here on, the images found wait for the paragraph behind them

    def feed(self, e: Event) -> None:
        if e.kind == "text":
            for texts in (self.capture[1] if self.capture else None, self.figure.texts if self.figure else None):
                if texts is not None:
                    texts.append(e.value)
        elif e.kind == "open":
            self.begin(e.value, e.attrs)
        elif not e.implied:
            self.end(e.value)

    def begin(self, name: str, attrs: dict[str, str]) -> None:
        self.crumbs = self.crumbs_at.get(attrs.get("id", ""), self.crumbs)
        if name == "figure":
            if self.figure:
                self.figure.depth += 1
            else:
                self.figure = Figure()
        elif name in self.CAPTURED:
            self.capture = (name, [])
        elif name in ("img", "image"):
            src = next((attrs[k] for k in ("src", "xlink:href", "href") if attrs.get(k)), None)
            if src:
                self.add(src, attrs)

    def add(self, src: str, attrs: dict[str, str]) -> None:
        shown = {"src": src, "alt": attrs.get("alt", ""), "css_class": attrs.get("class", ""), "role": attrs.get("role") or attrs.get("epub:type", "")}
        place = {"breadcrumb": self.crumbs, "nearest_heading": self.heading, "in_figure": self.figure is not None}
        self.found.append({**shown, **place, "caption": "", "context_before": self.before, "context_after": ""})
        if self.figure:
            self.figure.images.append(self.found[-1])

    def end(self, name: str) -> None:
        if self.capture and self.capture[0] == name:
            text = _squeeze("".join(self.capture[1]))
            self.capture = None
            if name == "figcaption" and self.figure:
                self.figure.caption = text
            elif name in HEADINGS:
                self.heading = text or self.heading
            elif text and name in PARAGRAPHS:
                self.before = text
                for image in self.found[self.without_after :]:
                    image["context_after"] = text
                self.without_after = len(self.found)
        if name == "figure" and self.figure:
            self.figure.depth -= 1
            if not self.figure.depth:
                said = self.figure.caption or _squeeze("".join(self.figure.texts))
                for image in self.figure.images:
                    image["caption"] = said
                self.figure = None


def chapter_images(html: str, crumbs_at: dict[str, list[str]], first_crumbs: list[str]) -> list[dict]:
    """One record per image of a chapter: place in the contents, last heading, caption, the paragraphs around it.

    An image inside a paragraph has that paragraph as what follows. A figure without a caption element gives all its
    text as the caption.
    """
    walk = ImageWalk(crumbs_at, first_crumbs)
    for e in stream(html):
        walk.feed(e)
    return walk.found


def book_images(data: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(data))
    package = read_package(z)
    rows, present = flatten_toc(read_toc(z, package, spine_fallback=False)), set(z.namelist())
    crumbs: dict[tuple, list[str]] = {}
    first: dict[str, list[str]] = {}
    for _, depth, _, file, anchor, crumb in rows:
        crumbs.setdefault((file, anchor), crumb)
        if file and file not in first:
            first[file] = crumb[:-1] if anchor and depth > 1 else crumb
    sizes: dict[str, tuple] = {}
    out = []
    for k, file in enumerate(package["spine"]):
        if file not in present:
            continue
        at = {a: c for (f, a), c in crumbs.items() if f == file and a}
        start = crumbs.get((file, None), first.get(file, []))
        for r in chapter_images(z.read(file).decode("utf-8", "replace"), at, start):
            path = _join(posixpath.dirname(file), r["src"].partition("#")[0])
            if path not in sizes:
                sizes[path] = image_size(z.read(path)) if path in present else (None, None)
            out.append(
                (path, file, k, len(out), r["alt"], r["css_class"], r["role"], r["breadcrumb"], r["nearest_heading"], r["in_figure"], r["caption"])
                + (r["context_before"][:CONTEXT_CHARS], r["context_after"][:CONTEXT_CHARS], path in present, *sizes[path])
            )
    return out


@arrow_udf(PACKAGE)
def _package(data):
    if data is None:
        return None
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        p = read_package(z)
        items = [(k, v["href"], v["type"], v["props"]) for k, v in p["manifest"].items()]
        return (p["title"], p["creator"], p["language"], items, p["spine"], p["nav"], p["ncx"], flatten_toc(toc := read_toc(z, p)), json.dumps(toc_json(toc), ensure_ascii=False), None)
    except Exception as e:  # a broken book is a row with its error
        return (*[None] * 9, f"{type(e).__name__}: {e}")


@arrow_udf(PAGES)
def _pages(data):
    try:
        return [] if data is None else convert_book(data)
    except Exception:
        return []


@arrow_udf(ASSETS)
def _assets(data):
    try:
        if data is None:
            return []
        z = zipfile.ZipFile(io.BytesIO(data))
        return [(f"assets/{name}", z.read(path)) for path, name in assets(z, read_package(z)).items()]
    except Exception:
        return []


@arrow_udf(OCCURRENCES)
def _images(data):
    try:
        return [] if data is None else book_images(data)
    except Exception:
        return []


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all .epub files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def packages(books: DataFrame) -> DataFrame:
    """path and the package's fields; a broken book has its error and nulls."""
    return books.select("path", _package("content").alias("p")).select("path", "p.*")


def toc_rows(books: DataFrame) -> DataFrame:
    return packages(books).select("path", F.inline("toc"))


def book_pages(books: DataFrame) -> DataFrame:
    """path, out_path, html: a book as nested folders of pages; broken books have none (see ``packages``)."""
    return books.select("path", _pages("content").alias("p")).select("path", F.inline("p"))


def book_assets(books: DataFrame) -> DataFrame:
    """path, out_path, content: what a book's pages link to, under names that don't clash; write it by ``sources.files.write_bytes``."""
    return books.select("path", _assets("content").alias("a")).select("path", F.inline("a"))


def book_totals(books: DataFrame) -> DataFrame:
    """One row: books read, broken ones, pages and assets."""
    kinds = packages(books).select(F.when(F.col("error").isNull(), "books").otherwise("failed").alias("kind"))
    kinds = kinds.unionByName(book_pages(books).select(F.lit("pages").alias("kind"))).unionByName(book_assets(books).select(F.lit("assets").alias("kind")))
    return kinds.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("books", "failed", "pages", "assets")])


def image_occurrences(books: DataFrame) -> DataFrame:
    return books.select("path", _images("content").alias("o")).select("path", F.inline("o"))


def image_index(occurrences: DataFrame) -> DataFrame:
    """path, source_image, width, height, present, occurrences: images with what was seen of them, which a book bounds."""
    return occurrences.groupBy("path", "source_image").agg(
        F.min("seq").alias("first_seq"),
        F.first("width").alias("width"),
        F.first("height").alias("height"),
        F.bool_or("present").alias("present"),
        F.array_sort(F.collect_list(F.struct("seq", "file", "breadcrumb", "nearest_heading", "in_figure", "caption", "context_before", "context_after"))).alias("occurrences"),
    )


def image_stats(occurrences: DataFrame) -> DataFrame:
    """path, image_count (images in the book), occurrence_count, in_figure, with_caption (images with any caption)."""
    images = occurrences.groupBy("path", "source_image").agg(F.count("*").alias("n"), F.bool_or("present").alias("present"), F.count_if("in_figure").alias("fig"), F.bool_or(F.col("caption") != "").alias("cap"))
    return images.groupBy("path").agg(F.count_if("present").alias("image_count"), F.sum("n").alias("occurrence_count"), F.sum("fig").alias("in_figure"), F.count_if("cap").alias("with_caption"))


def book_payloads(books: DataFrame) -> DataFrame:
    """path, payload: a book's title, nested contents and images as one JSON text, which is one value of the output."""
    seen = image_occurrences(books)
    shown = image_index(seen).where("present").select("path", F.struct("first_seq", "source_image", "width", "height", "occurrences").alias("image"))
    images = shown.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list("image"))).alias("images"))
    head = packages(books).where("error is null").select("path", F.to_json(F.struct(F.col("title").alias("book")), {"ignoreNullFields": "false"}).alias("book"), "toc_json")
    rows = head.join(image_stats(seen), "path", "left").join(images, "path", "left").na.fill(0, ["image_count", "occurrence_count"])
    # The contents nest without a bound, which no Spark type says, so this part is put in as text.
    payload = F.format_string(
        '%s,"toc":%s,"image_count":%d,"occurrence_count":%d,"images":%s}', F.expr("substring(book, 1, length(book) - 1)"), "toc_json", "image_count", "occurrence_count", F.coalesce("images", F.lit("[]"))
    )
    return rows.select("path", payload.alias("payload"))
