"""HTML as a stream of events, and as a small element tree built from it.

Unclosed elements nest, an end tag closes up to the nearest open element of its name or is ignored, void elements close
at once. Comments and declarations are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from typing import NamedTuple

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style"))


class Element:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Element | str] = []

    def elements(self) -> list[Element]:
        return [c for c in self.children if not isinstance(c, str)]

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        todo = self.elements()[::-1]
        while todo:
            el = todo.pop()
            yield el
            todo.extend(el.elements()[::-1])

    def text(self) -> str:
        out: list[str] = []
        todo: list[Element | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(x.children[::-1])
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def first(self, name: str | None = None, cls: str | None = None, attr: str | None = None) -> Element | None:
        return next((e for e in self.walk() if (not name or e.name == name) and (not cls or cls in e.classes()) and (not attr or attr in e.attrs)), None)

    def html(self) -> str:
        inner = "".join((c if self.name in RAW else escape(c, quote=False)) if isinstance(c, str) else c.html() for c in self.children)
        if not self.name:
            return inner
        head = start_tag(self.name, self.attrs)
        return head if self.name in VOID else f"{head}{inner}</{self.name}>"


class Event(NamedTuple):
    """``kind`` is open, close or text; ``value`` the element's name or the text. An ``implied`` close has no end tag of its own."""

    kind: str
    value: str
    attrs: dict[str, str] | None = None
    implied: bool = False


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Event] = []
        self.names: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.out.append(Event("open", tag, {k: v or "" for k, v in attrs}))
        if tag in VOID:
            self.out.append(Event("close", tag))
        else:
            self.names.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.out += (Event("open", tag, {k: v or "" for k, v in attrs}), Event("close", tag))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.names:
            while (name := self.names.pop()) != tag:
                self.out.append(Event("close", name, implied=True))
            self.out.append(Event("close", tag))

    def handle_data(self, data: str) -> None:
        self.out.append(Event("text", data))


def stream(html: str) -> list[Event]:
    """All events of a page; every element that opens is closed."""
    r = _Reader()
    r.feed(html)
    r.close()
    return r.out + [Event("close", name, implied=True) for name in reversed(r.names)]


def start_tag(name: str, attrs: dict[str, str]) -> str:
    return f"<{name}" + "".join(f' {k}="{escape(v)}"' for k, v in attrs.items()) + ">"


def parse(html: str) -> Element:
    at = root = Element("", {}, None)
    for e in stream(html):
        if e.kind == "text":
            at.children.append(e.value)
        elif e.kind == "open":
            at.children.append(Element(e.value, e.attrs, at))
            at = at.children[-1]
        else:
            at = at.parent
    return root
