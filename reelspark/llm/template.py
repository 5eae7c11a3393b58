"""Deduce the template of a site's pages from equivalence classes of tokens, and extract what remains in its slots.

A token is an element's start or end with its path, or a word of the text with its path. Its occurrence vector says how
often it occurs on each page of the host; tokens with the same vector form a class. Vectors are compared by
fingerprints: sums, over the pages, of a hash of page and count, which add up partition by partition. Classes with
enough support that hold elements are kept; on a page a class is valid if its tokens come in the same order each time
and its occurrences nest with those of the others. Valid classes nested in each other are the template; text outside
them fills its slots. A slot lies in the elements of the template that are open around it, and the classes of these
elements name its place; words of the template are no text of a slot.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.page_html import BLOCKS, RAW, UNREAD, events
from reelspark.session import materialize, spread

MIN_PAGES = 8
MIN_SHARE = 0.02
LONG_WORD = 40  # characters; a longer word stands in its token as a hash
BROADCAST_TOKENS = 200_000
HELD_TOKENS = 300_000
PAGES = ""  # stands for the page itself among its tokens

STATS = "host string, token string, f1 long, f2 long, pages long, place double"
STATS_ARROW = pa.schema([("host", pa.string()), ("token", pa.string()), ("f1", pa.int64()), ("f2", pa.int64()), ("pages", pa.int64()), ("place", pa.float64())])
#: ``asides`` are the inline code and formulas of a text, where it has the sign ASIDE.
#: ``lead`` is what a block begins with: # of a heading, - or a number of an item, > of a quotation; ``row`` numbers table rows.
SLOTS = "array<struct<slot:string,place:string,tag:string,lead:string,row:int,code:boolean,text:string,asides:array<string>>>"
SLOTS_ARROW = pa.list_(
    pa.struct(
        [("slot", pa.string()), ("place", pa.string()), ("tag", pa.string()), ("lead", pa.string()), ("row", pa.int32()), ("code", pa.bool_()), ("text", pa.string())]
        + [("asides", pa.list_(pa.string()))]
    )
)
ASIDE = "\x01"
TEXT, CODE, FORMULA = 0, 1, 2
MATH_SIGNS = {"msup": "^", "msub": "_", "mfrac": "/"}


def word_token(path: str, word: str) -> str:
    return f"w{path} {word}" if len(word) <= LONG_WORD else f"w{path} \x02{xxhash.xxh3_64_hexdigest(word)}"


def page_tokens(page: list[tuple[str, str, str]], worded: dict[str, set[str]] | None = None) -> Iterator[str]:
    """The tokens of a page in order; with ``worded``, words only of the paths in it."""
    for kind, path, text in page:
        if kind == "text":
            if worded is not None and path not in worded:
                continue
            lead = f"w{path} "
            for word in text.split():
                yield lead + word if len(word) <= LONG_WORD else word_token(path, word)
        else:
            yield ("o" if kind == "open" else "c") + path


#: What a token has summed up is one whole number of four fields: two hashes, the pages, the first places.
FIELD, MASK = 64, (1 << 64) - 1


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, dict[str, int]] = {}

    def rows() -> pa.RecordBatch:
        sums = [(host, token, v & MASK, v >> FIELD & MASK, v >> 2 * FIELD & MASK, float(v >> 3 * FIELD)) for host, tokens in held.items() for token, v in tokens.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sums, strict=True), STATS_ARROW, strict=True)], schema=STATS_ARROW)

    size = 0
    for batch in batches:
        for key, host, html in zip(batch.column("id").to_pylist(), batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not html:
                continue
            own = held.setdefault(host, {})
            size -= len(own)
            tokens = list(page_tokens(events(html)))
            counts = Counter(tokens)
            first = dict(zip(reversed(tokens), range(len(tokens) - 1, -1, -1), strict=True))
            # Tokens that occur as often on this page share its contribution to their vectors.
            shares = {}
            for n in set(counts.values()):
                h = xxhash.xxh3_64_intdigest(f"{key}:{n}")
                shares[n] = (h & 0x7FFFFFFF) + ((h >> 33) << FIELD) + (1 << 2 * FIELD)
            own[PAGES] = own.get(PAGES, 0) + (1 << 2 * FIELD)
            for token, n in counts.items():
                own[token] = own.get(token, 0) + shares[n] + (first[token] << 3 * FIELD)
            size += len(own)
            if size > HELD_TOKENS:
                yield rows()
                size = 0
    if held:
        yield rows()


def deduce_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Columns host, template: per host its candidate classes as JSON, a list of token lists in page order.

    ``pages`` has id, host, html. The tokens of a host's template are at most its mean tokens per page / ``min_share``.
    """
    stats = pages.where("html is not null and html != ''").mapInArrow(_stats, STATS)
    tokens = stats.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("f1", "f2", "pages", "place")])
    # Few tokens have the support; written once, so that pages are parsed once.
    frequent = materialize(tokens.where((F.col("pages") >= min_pages) | (F.col("token") == PAGES)), "tokens")
    sizes = frequent.where(F.col("token") == PAGES).select(F.col("host").alias("h"), F.col("pages").alias("n"))
    known = frequent.where((F.col("token") != PAGES) & (F.col("pages") >= min_pages)).join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") >= min_share * F.col("n"))
    classes = (
        known.groupBy("host", "f1", "f2", "pages")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("at"), "token"))).alias("tokens"), F.count_if(~F.col("token").startswith("w")).alias("elements"))
        .where("elements >= 2")
    )
    return classes.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list("tokens.token"))).alias("template"), F.sum(F.size("tokens")).alias("n_tokens"))


def template_words(classes: dict[str, tuple[int, int]]) -> dict[str, set[str]]:
    """The words of a template by path."""
    out: dict[str, set[str]] = {}
    for token in classes:
        if token.startswith("w"):
            path, _, word = token[1:].partition(" ")
            out.setdefault(path, set()).add(word)
    return out


def valid_classes(tokens: list[str], classes: dict[str, tuple[int, int]], sizes: list[int]) -> set[int]:
    """The classes whose tokens come in order and nest on this page; ``classes`` gives (class, place in it) of a token."""
    present = {classes[t][0] for t in tokens if t in classes}
    while True:
        bad: set[int] = set()
        stack: list[list[int]] = []
        for t in tokens:
            at = classes.get(t)
            if at is None or at[0] not in present or at[0] in bad:
                continue
            c, k = at
            while stack and stack[-1][0] in bad:
                stack.pop()
            if k == 0:
                if any(s[0] == c for s in stack):
                    bad.add(c)  # begins again before it has ended
                elif sizes[c] > 1:
                    stack.append([c, 0])
            elif [c, k - 1] in stack:
                # Classes still open inside give way if they are smaller, else this one does.
                while stack[-1][0] != c and sizes[stack[-1][0]] <= sizes[c]:
                    bad.add(stack.pop()[0])
                if stack[-1][0] != c:
                    bad.add(c)
                elif k == sizes[c] - 1:
                    stack.pop()
                else:
                    stack[-1][1] = k
            else:
                bad.add(c)
        bad |= {s[0] for s in stack}
        if not bad:
            return present
        present -= bad


class _Page:
    """Reads the events of one page and gathers the texts of its slots, block by block."""

    def __init__(self, classes: dict[str, tuple[int, int]], sizes: list[int], valid: set[int], worded: dict[str, set[str]]) -> None:
        self.classes, self.sizes, self.valid, self.worded = classes, sizes, valid, worded
        self.out: list[dict] = []
        self.parts: list[tuple[str, int]] = []
        self.where: tuple = (None, "", "")
        self.frames: list[tuple[int, int]] = []  # open classes of the template, with the token that was read last
        self.math: list[list] = []  # open elements of a formula, with the children they have had
        self.lists: list[list] = []  # open lists: their tag and the items so far
        self.lead, self.quotes, self.rows, self.row = "", 0, 0, 0

    def flush(self) -> None:
        if not self.parts:
            return
        text, code, asides = _united(self.parts)
        if text.strip():
            place, tag, slot = self.where
            self.out.append({"slot": slot, "place": place, "tag": tag, "lead": "> " * self.quotes + self.lead, "row": self.row, "code": code, "text": text, "asides": asides})
            self.lead = ""
        self.parts.clear()

    def text(self, path: str, text: str, place: str | None, tag: str, code: bool) -> None:
        if (place, tag) != self.where[:2]:
            self.flush()
            self.where = (place, tag, "/".join([f"{c}.{k}" for c, k in self.frames]))
        for word in self.worded.get(path, ()):
            # A hash stands for a long word, so then every long word must be looked at.
            if word[0] == "\x02" or word in text:
                text = " ".join([x for x in text.split(" ") if not self._of_template(path, x.strip())])
                break
        if self.math and self.parts and self.parts[-1][1] == FORMULA:
            self.parts[-1] = (self.parts[-1][0] + text.strip(), FORMULA)
        else:
            self.parts.append((text.replace(ASIDE, " "), CODE if code else TEXT))

    def _of_template(self, path: str, word: str) -> bool:
        at = self.classes.get(word_token(path, word)) if word else None
        return at is not None and at[0] in self.valid

    def formula(self, kind: str, name: str) -> None:
        if kind == "close":
            self.math.pop()
            return
        if not self.math:
            self.parts.append(("", FORMULA))
        else:
            if self.math[-1][1] and self.math[-1][0] in MATH_SIGNS and self.parts and self.parts[-1][1] == FORMULA:
                self.parts[-1] = (self.parts[-1][0] + MATH_SIGNS[self.math[-1][0]], FORMULA)
            self.math[-1][1] += 1
        self.math.append([name, 0])

    def frame(self, token: str) -> None:
        """Go on in the template, if the token is one of it."""
        at = self.classes.get(token)
        if at is None or at[0] not in self.valid or self.sizes[at[0]] < 2:
            return
        c, k = at
        if k == 0:
            self.frames.append((c, 0))
        elif self.frames and self.frames[-1][0] == c:
            self.frames.pop()
            if k < self.sizes[c] - 1:
                self.frames.append((c, k))

    def block(self, kind: str, name: str) -> None:
        """What the block that begins or ends here means for the next text."""
        if name in ("ul", "ol"):
            if kind == "open":
                self.lists.append([name, 0])
            elif self.lists:
                self.lists.pop()
        elif name == "li":
            self.lead = ""
            if kind == "open":
                if self.lists:
                    self.lists[-1][1] += 1
                self.lead = "  " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- ")
        elif name == "blockquote":
            self.quotes = max(0, self.quotes + (1 if kind == "open" else -1))
        elif name == "tr":
            self.rows += kind == "open"
            self.row = self.rows if kind == "open" else 0
        elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
            self.lead = "#" * int(name[1]) + " " if kind == "open" else ""


def fill_slots(html: str, classes: dict[str, tuple[int, int]], sizes: list[int], inside: str, part: str) -> list[dict]:
    """What a page has in the slots of its template, block by block in page order.

    ``place`` is the name that the template gives a slot: None outside its elements of the class ``inside``, "caption" in
    those of the class ``part`` within them, else "body". An element that the page's host has too seldom to be in any
    class is its page's own and names its slots too. Words of the template are left out of the texts.
    """
    page = events(html)
    worded = template_words(classes)
    valid = valid_classes([t for t in page_tokens(page, worded) if t in classes], classes, sizes)
    read = _Page(classes, sizes, valid, worded)
    known: dict[str, tuple[str | None, str, bool, bool, bool]] = {"": (None, "", False, False, False)}

    def about(path: str) -> tuple[str | None, str, bool, bool, bool]:
        """Of a path: its place, its block, whether its text is hidden or code, whether its element is of the part's class."""
        got = known.get(path)
        if got is None:
            above, _, last = path.rpartition("/")
            place, block, hidden, code, _ = about(above)
            name, *own = last.split(".")
            at = classes.get("o" + path)
            named = at is None or at[0] in valid  # not one that breaks the template's order here
            if named and place is None and inside in own:
                place = "body"
            if named and place == "body" and part in own:
                place = "caption"
            got = known[path] = (place, name if name in BLOCKS else block, hidden or name in RAW, code or name in UNREAD, part in own)
        return got

    for kind, path, text in page:
        place, block, hidden, code, of_part = about(path)
        if kind == "text":
            if not hidden:
                read.text(path, text, place, block, code)
            continue
        if text == "math" or read.math:
            read.formula(kind, text)
        read.frame(("o" if kind == "open" else "c") + path)
        if text in BLOCKS or text == "pre" or of_part:
            read.flush()
            read.where = (None, "", "")
            read.block(kind, text)
        elif text == "br" and kind == "open":
            read.parts.append(("\n", TEXT))
    read.flush()
    return read.out


def _united(parts: list[tuple[str, int]]) -> tuple[str, bool, list[str]]:
    """A block as one text, its inline code and formulas set aside; a block of code alone as code."""
    if parts and all(kind == CODE or not text.strip() for text, kind in parts) and any(kind == CODE for _, kind in parts):
        return "".join(text for text, _ in parts), True, []
    shown = [(text, kind) for text, kind in parts if kind == TEXT or text.strip()]
    return "".join(text if kind == TEXT else ASIDE for text, kind in shown), False, [f"`{t.strip()}`" if kind == CODE else f"${t}$" for t, kind in shown if kind != TEXT]


def parse_template(text: str | None) -> tuple[dict[str, tuple[int, int]], list[int]]:
    groups = json.loads(text) if text else []
    return {t: (c, k) for c, tokens in enumerate(groups) for k, t in enumerate(tokens)}, [len(g) for g in groups]


@dataclass(frozen=True)
class Finish:
    """What is made of a page's slots where they are read, so that they need not travel: a function, its type for Spark and for Arrow."""

    of: Callable[[list[dict]], list]
    ddl: str
    arrow: pa.DataType


WHOLE = Finish(lambda slots: slots, SLOTS, SLOTS_ARROW)


def _extract(templates, inside: str, part: str, finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict = {}
        for batch in batches:
            given = batch.column("template").to_pylist() if templates is None else [templates.value.get(h) for h in batch.column("host").to_pylist()]
            rows = []
            for html, text in zip(batch.column("html").to_pylist(), given, strict=True):
                if text not in parsed:
                    if len(parsed) > 200:
                        parsed.clear()
                    parsed[text] = parse_template(text)
                rows.append(finish.of(fill_slots(html, *parsed[text], inside, part)) if html else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, finish.arrow)], names=["id", "slots"])

    return run


def site(html: str = "html", path: str = "path") -> Column:
    """The site a page says it belongs to (its canonical address, else the base of its links), else the first folder of its path."""
    link = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?https?://([^/\"'\s>]+)"
    base = r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?https?://([^/\"'\s>]+)"
    said = [F.when(F.col(html).contains(sign), F.nullif(F.regexp_extract(html, form, 1), F.lit(""))) for sign, form in (("canonical", link), ("<base", base))]
    return F.coalesce(*[F.lower(x) for x in said], F.split(path, "/")[0])


def extract_slots(pages: DataFrame, *, item: str = "page_id", html: str = "html", host: Column | None = None, inside: str = "post-body", part: str = "caption-text", finish: Finish = WHOLE) -> DataFrame:
    """Columns item, slots: per page the texts in the slots of its host's template, in page order, or what ``finish`` makes of them.

    ``host`` defaults to ``site``. Pages with null or empty HTML have no slots. A host with fewer
    than ``MIN_PAGES`` pages has no template: all its text is in slots. Templates are broadcast while they have at most
    ``BROADCAST_TOKENS`` tokens together, else joined by host.
    """
    rows = spread(pages.select(F.col(item).alias("id"), (site(html) if host is None else host).alias("host"), F.col(html).alias("html")))
    templates = deduce_templates(rows)
    templates = materialize(templates, "templates")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, slots {finish.ddl}"
    if (templates.agg(F.sum("n_tokens")).first()[0] or 0) <= BROADCAST_TOKENS:
        small = rows.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in templates.select("host", "template").collect()})
        found = rows.mapInArrow(_extract(small, inside, part, finish), schema)
    else:
        own = templates.select(F.col("host").alias("t_host"), "template")
        found = rows.join(own, F.col("host").eqNullSafe(F.col("t_host")), "left").mapInArrow(_extract(None, inside, part, finish), schema)
    return found.withColumnRenamed("id", item)
