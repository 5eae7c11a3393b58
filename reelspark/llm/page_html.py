"""A tolerant HTML reader: open, close and text events with their element paths, from one pass of a tokenizer."""

from __future__ import annotations

import re
from html import unescape


# HTML elements without content, those whose content is no text here, those that end a paragraph.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
UNREAD = frozenset(("pre", "code", "script", "style"))
RAW = frozenset(("script", "style"))
EMPTY_SHAPES = frozenset(("path", "circle", "rect", "mspace", "none"))
ENDS_P = frozenset(
    ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6")
    + ("header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
)
BLOCKS = ENDS_P | frozenset(("li", "tr", "td", "th", "dt", "dd", "body", "html", "head", "title"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "blockquote", "figure"))
ROW_SCOPES = SCOPES - {"tr"}

#: Comments and declarations; an end tag; a start tag with its attributes and whether it closes itself.
TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|/(?P<end>[A-Za-z][^\s/>]*)[^>]*>|/[^A-Za-z>][^>]*>|/>"
    r"|(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE) for tag in RAW}


def _classes(attrs: str) -> tuple[str, ...]:
    if "class" not in attrs.lower():
        return ()
    given = next((g[1] or g[2] or g[3] for g in (m.groups() for m in ATTRIBUTE.finditer(attrs)) if g[0].lower() == "class" and any(g[1:])), "")
    return tuple(sorted(set(unescape(given).split())))


def events(html: str) -> list[tuple[str, str, str]]:
    """(kind, path, text or name) in page order; kinds are open, close and text, and every open element gets a close."""
    out: list[tuple[str, str, str]] = []
    stack: list[str] = []
    paths = [""]
    known: dict[tuple[str, str, str], str] = {}  # path of an element by parent path, tag and attributes
    pending: list[str] = []

    def flush() -> None:
        if pending:
            out.append(("text", paths[-1], "".join(pending)))
            pending.clear()

    def pop_to(i: int) -> None:
        flush()
        while len(stack) > i:
            out.append(("close", paths.pop(), stack.pop()))

    def close_in(names: tuple[str, ...], scopes: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                pop_to(i)
                return
            if stack[i] in scopes:
                return

    at, size = 0, len(html)
    found = TOKEN.finditer(html)
    while (m := next(found, None)) is not None:
        begin = m.start()
        if begin > at:
            text = html[at:begin]
            pending.append(unescape(text) if "&" in text else text)
        at = m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "end":
            tag = m["end"].lower()
            if tag in stack:
                i = len(stack) - 1
                while stack[i] != tag:
                    i -= 1
                pop_to(i)
            continue
        tag, attrs = m.group("start", "attrs")
        tag = tag.lower()
        if tag in ENDS_P:
            close_in(("p",), SCOPES)
        if tag in CLOSES:
            close_in(CLOSES[tag], ROW_SCOPES if tag != "tr" else SCOPES)
        if pending:
            flush()
        key = (paths[-1], tag, attrs)
        path = known.get(key)
        if path is None:
            path = known[key] = f"{paths[-1]}/{'.'.join((tag, *_classes(attrs)))}"
        out.append(("open", path, tag))
        if tag in VOID or (tag in EMPTY_SHAPES and attrs.rstrip().endswith("/")):
            out.append(("close", path, tag))
            continue
        stack.append(tag)
        paths.append(path)
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = RAW_END[tag].search(html, at)
            if end.start() > at:
                pending.append(html[at : end.start()])
            at = end.start() if end.end() > end.start() else size
            found = TOKEN.finditer(html, at)
    if at < size:
        text = html[at:]
        pending.append(unescape(text) if "&" in text else text)
    pop_to(0)
    return out
