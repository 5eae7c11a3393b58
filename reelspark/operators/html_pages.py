"""HTML pages as rows: text nodes, figures, Markdown mirrors, and writing translations back.

Pages are read as a stream of events, once. Markdown is made by a stack machine: whatever closes hands its text to the
element around it, in the form that the table of its kind gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import _c, hidden_name
from reelspark.functions.udf import arrow_udf
from reelspark.operators.tables import totals
from reelspark.session import spread
from reelspark.sources.htmltree import RAW, VOID, Event, parse, start_tag, stream

# Elements whose own text is translatable, those that are skipped, and a label that stays as it is.
TEXT_TAGS = frozenset(("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "title", "blockquote", "em", "strong", "a", "span"))
SKIP_TAGS = frozenset(("code", "pre", "script", "style"))
STOCK_LABELS = frozenset(("▶ Watch on YouTube",))
NUMERIC = re.compile(r"^[\s\d:./\-,▶•]+$")
NODES = "array<struct<id:int,kind:string,text:string>>"
FIGURES = "struct<video_id:string,figures:array<struct<timestamp_s:int,path:string>>>"
MARKDOWN = "struct<markdown:string,error:string>"


def _squeeze(text: str) -> str:
    return " ".join(text.split())


@dataclass
class Node:
    """A translatable text: its kind, and the events it stands in (of an element its own strings, of an image its start)."""

    kind: str
    text: str
    events: list[int]


def nodes_of(events: list[Event]) -> list[Node]:
    """In document order; an element's own text comes before its alternative text."""
    opened: list[tuple[Event, int, list[int]]] = []
    around: list[int] = []
    for i, e in enumerate(events):
        if e.kind == "open":
            around.append(len(opened))
            opened.append((e, i, []))
        elif e.kind == "close":
            around.pop()
        elif around:
            opened[around[-1]][2].append(i)
    out = []
    for e, i, strings in opened:
        said = "".join(events[k].value for k in strings).strip() if e.value in TEXT_TAGS else ""
        if said and said not in STOCK_LABELS and not NUMERIC.match(said):
            out.append(Node(e.value, said, strings))
        shown = e.attrs.get("alt", "").strip() if e.value == "img" else ""
        if shown and shown not in STOCK_LABELS:
            out.append(Node("alt", shown, [i]))
    return out


@arrow_udf(NODES)
def _nodes(html):
    return None if html is None else [(i, n.kind, n.text) for i, n in enumerate(nodes_of(stream(html)))]


def text_nodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, id, kind, text: translatable nodes in document order, ids from 0. Null and empty pages have none."""
    return spread(pages.select(key, F.col(html).alias("_html"))).select(key, _nodes("_html").alias("nodes")).select(key, F.inline("nodes"))


def to_html(events: list[Event]) -> str:
    out, names = [], []
    for e in events:
        if e.kind == "open":
            out.append(start_tag(e.value, e.attrs))
            names.append(e.value)
        elif e.kind == "close":
            names.pop()
            if e.value not in VOID:
                out.append(f"</{e.value}>")
        else:
            out.append(e.value if names and names[-1] in RAW else escape(e.value, quote=False))
    return "".join(out)


@arrow_udf("string")
def _write_back(html, translations):
    if html is None:
        return None
    events = stream(html)
    given = dict(translations or {})
    for i, node in enumerate(nodes_of(events)):
        if i not in given:
            continue
        if node.kind == "alt":
            at = node.events[0]
            events[at] = events[at]._replace(attrs={**events[at].attrs, "alt": given[i]})
            continue
        # The first string that isn't blank takes the translation, the others go.
        place = next(k for k in node.events if events[k].value.strip())
        for k in node.events:
            events[k] = Event("text", given[i] if k == place else "")
    return to_html(events)


def write_back(html: Column | str, translations: Column | str) -> Column:
    """The page with node texts replaced by id (map<int,string>); nodes without an entry stay."""
    return _write_back(_c(html), _c(translations))


@dataclass
class Open:
    """An element while it is open: what it holds so far, as Markdown in a line and as blocks, and where its text begins."""

    name: str
    attrs: dict[str, str]
    texts: list[str]
    line: list[str] = field(default_factory=list)
    items: list[str] = field(default_factory=list)  # of a list
    figures: list[str] = field(default_factory=list)  # of a row of figures
    blocks: list[str] = field(default_factory=list)  # of a section or a post's body
    seen: dict[str, tuple[str, str]] = field(default_factory=dict)  # of a figure: its image, caption and time, each the first

    def __post_init__(self) -> None:
        self.begins = len(self.texts)

    def has(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def text(self) -> str:
        return "".join(self.texts[self.begins :])


def _link(el: Open, said: str) -> str:
    return f"[{said}]({el.attrs['href']})" if el.attrs.get("href") else said


#: What stands in a line for an element, from what its inside gave; elements not named give their inside.
IN_LINE: dict[str, Callable[[Open, str], str]] = {
    **dict.fromkeys(("strong", "b"), lambda el, said: f"**{said}**"),
    **dict.fromkeys(("em", "i"), lambda el, said: f"*{said}*"),
    "code": lambda el, said: f"`{el.text()}`",
    "br": lambda el, said: "\n",
    "a": _link,
}


def _figure(el: Open) -> str:
    if not el.seen.get("image", ("", ""))[0]:
        return ""
    src, alt = el.seen["image"]
    time, link = el.seen.get("time", ("", ""))
    below = [_squeeze(el.seen.get("caption", ("", ""))[0]), (f"[▶ {time}]({link})" if link else f"▶ {time}") if time else ""]
    shown = f"![{_squeeze(alt).translate(str.maketrans('[]', '()'))}]({quote(unquote(src), safe='/')})"
    return "\n".join([shown, *["*" + " — ".join(x for x in below if x) + "*"] * any(below)])


def _listed(mark: Callable[[int], str]) -> Callable[[Open, str], list[str]]:
    return lambda el, said: ["\n".join(f"{mark(i)} {x}" for i, x in enumerate(el.items, 1))]


#: The blocks that an element gives where it stands as a block; elements not named give their line.
AS_BLOCKS: dict[str, Callable[[Open, str], list[str]]] = {
    **{f"h{n}": lambda el, said, n=n: [f"{'#' * n} {said}"] for n in (2, 3, 4)},
    "ul": _listed(lambda i: "-"),
    "ol": _listed(lambda i: f"{i}."),
    "hr": lambda el, said: ["---"],
    "figure": lambda el, said: [_figure(el)],
    "section": lambda el, said: el.blocks,
    "blockquote": lambda el, said: [f"> {said}" if said else ""],
}


class Mirror:
    """The stack machine; feed the events of a page, then read title, source and blocks."""

    def __init__(self, body_class: str) -> None:
        self.body_class = body_class
        self.texts: list[str] = []  # all strings of the page so far
        self.open: list[Open] = [Open("", {}, self.texts)]
        self.titles: dict[str, str] = {}
        self.sources: dict[str, str] = {}
        self.body: list[str] | None = None
        self.in_meta = 0  # depth of the first element with the class post-meta, once it has closed -1

    def feed(self, e: Event) -> None:
        if e.kind == "text":
            self.texts.append(e.value)
            self.open[-1].line.append(e.value)
        elif e.kind == "open":
            self.begin(Open(e.value, e.attrs, self.texts))
        else:
            self.end(self.open.pop())

    def begin(self, el: Open) -> None:
        if el.name == "img":
            for f in self.open:
                if f.name == "figure":
                    f.seen.setdefault("image", (el.attrs.get("src", ""), el.attrs.get("alt", "")))
        if el.name == "a" and "href" in el.attrs:
            if self.in_meta > 0:
                self.sources.setdefault("meta", el.attrs["href"])
            if el.has("source-pill"):
                self.sources.setdefault("pill", el.attrs["href"])
        self.open.append(el)
        if self.in_meta == 0 and el.has("post-meta"):
            self.in_meta = len(self.open)

    def end(self, el: Open) -> None:
        around = self.open[-1]
        if self.in_meta == len(self.open) + 1:
            self.in_meta = -1
        if el.name == "title":
            self.titles.setdefault("page", _squeeze(el.text()))
        elif el.name == "h1" and el.has("post-title"):
            self.titles.setdefault("post", _squeeze(el.text()))
        for f in self.open:
            if f.name == "figure":
                if el.has("caption-text"):
                    f.seen.setdefault("caption", (el.text(), ""))
                if el.name == "a" and el.has("ts-chip"):
                    f.seen.setdefault("time", (_squeeze(el.text()), el.attrs.get("href", "")))
        inside = "".join(el.line)
        said = _squeeze(inside)
        if el.name == "li" and around.name in ("ul", "ol"):
            around.items.append(said)
        if el.name == "figure" and around.has("figure-row"):
            around.figures.append(_figure(el))
        if around.name == "section" or around.has(self.body_class):
            row = el.name == "div" and el.has("figure-row")
            around.blocks += el.figures if row else AS_BLOCKS.get(el.name, lambda _, x: [x])(el, said)
        if self.body is None and el.has(self.body_class) and not any(x.has(self.body_class) for x in self.open):
            self.body = el.blocks
        around.line.append(IN_LINE.get(el.name, lambda _, x: x)(el, inside))


def to_markdown(html: str, body_class: str = "post-body") -> str:
    m = Mirror(body_class)
    for e in stream(html):
        m.feed(e)
    title = m.titles.get("post", m.titles.get("page", "Untitled"))
    source = m.sources.get("meta", m.sources.get("pill"))
    head = ["---", 'title: "' + title.replace('"', "'") + '"', *([f"source: {source}"] if source else []), "---"]
    return "\n\n".join(["\n".join(head), f"# {title}", *[b for b in m.body or [] if b.strip()]]) + "\n"


@arrow_udf(MARKDOWN)
def _to_markdown(html):
    if html is None:
        return (None, "no HTML")
    try:
        return (to_markdown(html), None)
    except Exception as e:  # one bad page is a row with its error
        return (None, f"{type(e).__name__}: {e}")


def html_to_markdown(html: Column | str) -> Column:
    """The page as Markdown: front matter, title, the blocks of its first post-body; comments are dropped."""
    return _to_markdown(_c(html))["markdown"]


@arrow_udf(FIGURES)
def _figures(html):
    if html is None:
        return None
    video = re.search(r"[?&]v=([A-Za-z0-9_-]{11})", html)
    found = []
    for fig in (e for e in parse(html).walk() if e.name == "figure"):
        img, stamp = fig.first("img", attr="src"), fig.attrs.get("data-timestamp", "")
        parts = stamp.split(":")[-3:]
        if img is not None and stamp and all(p.isdigit() for p in parts):
            seconds = 0
            for p in parts:
                seconds = seconds * 60 + int(p)
            found.append((seconds, unquote(img.attrs["src"])))
    return (video.group(1) if video else None, found)


def page_figures(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, video_id, timestamp_s, path: the figures of a page that have an image and a time."""
    return spread(pages.select(key, F.col(html).alias("_html"))).select(key, _figures("_html").alias("f")).select(key, F.col("f.video_id").alias("video_id"), F.inline("f.figures"))


def mirror(files: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """out_path, state, markdown, error: one row per file of a mirror.

    ``state`` is md for a page, copied for any other file (its bytes go by ``sources.files.copy_files``), skipped for a
    hidden name, failed for a page without HTML or one that can't be read. Files in hidden folders, and rows without a
    path, don't appear.
    """
    parts = F.split(path, "/")
    rows = files.where(F.col(path).isNotNull() & F.forall(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~hidden_name(p)))
    hidden, is_page = hidden_name(F.element_at(parts, -1)), F.lower(path).endswith(".html")
    state = F.when(hidden, "skipped").when(~is_page, "copied").otherwise("md")
    rows = rows.select(F.col(path).alias("path"), state.alias("state"), F.col(html).alias("html"))
    pages = spread(rows.where("state = 'md'")).select("path", _to_markdown("html").alias("m"))
    pages = pages.select(F.regexp_replace("path", r"(?i)\.html$", ".md").alias("out_path"), F.when(F.col("m.error").isNull(), "md").otherwise("failed").alias("state"), "m.markdown", "m.error")
    none = F.lit(None).cast("string")
    return pages.unionByName(rows.where("state != 'md'").select(F.col("path").alias("out_path"), "state", none.alias("markdown"), none.alias("error")))


def mirror_totals(mirrored: DataFrame) -> DataFrame:
    """One row: md, copied, skipped, failed."""
    return totals(mirrored, "state", ("md", "copied", "skipped", "failed"))
