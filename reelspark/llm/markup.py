"""Foreign markup in running text: which languages it is in, and its text in one plain form."""

from __future__ import annotations

from html import unescape
from html.entities import html5

import regex

from reelspark.llm.page_html import BLOCKS, events

_ENTITY = regex.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
_TAG = regex.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:[.:-][\w.:-]*)?(?:\s+[^<>]*)?/?>")
_COMMENT = regex.compile(r"<!--.*?-->|<!--|<!DOCTYPE[^>]*>|<!\[CDATA\[", regex.DOTALL | regex.IGNORECASE)

_MARKDOWN = [
    r"(?m)^\s{0,3}#{1,6}\s+\S",
    r"(?m)^\s{0,3}[-*+]\s+\S",
    r"(?m)^\s{0,3}\d{1,3}[.)]\s+\S",
    r"(?m)^\s{0,3}>\s?\S",
    r"(?m)^\s{0,3}(?:```|~~~)",
    r"(?m)\S[^\n]*\n\s{0,3}(?:={3,}|-{3,})\s*$",
    r"(?m)^\s*(?:-{3,}|\*{3,}|_{3,})\s*$",
    r"(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$",
    r"!\[[^\]\n]*\]\([^)\s]+[^)\n]*\)",
    r"\[[^\]\n]+\]\((?:[a-z]+://|/|\.|#|mailto:|\w)[^)\n]*\)",
    r"(?<!\[)\[[^\]\[\n]+\]\[[^\]\[\n]*\](?!\])",
    r"(?<![\w*])(\*{1,3})(?=[^\s*])[^*\n]*[^\s*](?<!\\)\1(?![\w*])|(?<![\w*])\*[^\s*]\*(?![\w*])",
    r"(?<![\w_])(_{1,3})(?=[^\s_])[^\n]*?[^\s_]\1(?![\w_])",
    r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}])(\*{2,3}|~~|__)(?=[^\s*~_])[^*~_\n]+\1",
    r"(?<![\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\w*])(\*{1,3})(?=[^\s*])[^*\n]*[^\s*]\1(?=[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}])",
    r"(?<![\w_])__(?=[^\s_])[^\n_]*[^\s_]__(?=[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}])",
    r"(?<!~)~~(?=\S)[^~\n]+(?<=\S)~~(?!~)",
    r"(?<!`)(`+)(?=[^\s`])[^`\n]*[^\s`]?\1(?!`)",
]
_WIKI = [
    r"(?m)^\s*(={2,6})\s*[^=\n]+?\s*\1\s*$",
    r"(?<!\[)\[\[[^\[\]\n]+\]\]",
    r"\{\{[^{}]+\}\}",
    r"(?<!')('{5}|'{3}|'{2})(?=[^\s'])[^\n]*?[^\s']\1(?!')",
    r"\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]\n]+)?\](?!\()",
    r"(?m)^\s*\{\|",
    r"(?m)^\s*\|\}",
    r"</?(?:ref|nowiki|gallery)\b[^>]*>",
    r"__(?:NO)?TOC__",
]
_LATEX = [
    r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}",
    r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{",
    r"\\\([^\n]+?\\\)",
    r"\\\[.+?\\\]",
    r"(?<![\w\\$])\$(?=[^\s$\d.,])[^$\n]*?(?<=[^\s$\\])\$(?![\w$])",
    r"(?<![\w\\$])\$(?=[^\s$])(?=[^$\n]*[\\^_=])[^$\n]*?(?<=[^\s$\\])\$(?![\w$])",
    r"\$\$(?=[^$]*[\\^_=A-Za-z])[^$]+\$\$",
    r"\\(?:item|alpha|beta|gamma|sum|frac|int|leq|geq|cdot|times|infty|ldots|par|noindent)\b",
]
MARKDOWN, WIKI, LATEX = ([regex.compile(p, regex.DOTALL if "begin" in p or r"\\\[" in p else 0) for p in block] for block in (_MARKDOWN, _WIKI, _LATEX))


_ENVIRONMENT = regex.compile(r"\\begin\{(\w+\*?)\}.*?\\end\{\1\}", regex.DOTALL)
_COMMAND = regex.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")


def has_html(text: str) -> bool:
    if "<" in text and (_TAG.search(text) or _COMMENT.search(text)):
        return True
    return "&" in text and any(m.group(1) is None or f"{m.group(1)};" in html5 for m in _ENTITY.finditer(text))


_SIGNS = regex.compile(r"[<>&*_`~#|\[\]{}$\\'=]|^\s*(?:[-+]|\d{1,3}[.)])\s|-{3}", regex.MULTILINE)


def languages(text: str) -> set[str]:
    """The markup languages readable in a text: html, markdown, wiki, latex."""
    if not _SIGNS.search(text):
        return set()
    found = set()
    if has_html(text):
        found.add("html")
    # A formula or template may hold signs that mean something else outside.
    bare = text
    if any(p.search(text) for p in LATEX):
        found.add("latex")
        for p in (_ENVIRONMENT, *LATEX[2:7], _COMMAND):
            bare = p.sub(" ", bare)
    if any(p.search(bare) for p in WIKI):
        found.add("wiki")
        for p in (r"\{\{[^{}]*\}\}", r"(?m)^\s*\{\|.*?^\s*\|\}", r"\[\[[^\[\]\n]+\]\]"):
            bare = regex.sub(p, " ", bare, flags=regex.DOTALL)
    if "<" in bare:
        bare = _TAG.sub("", _COMMENT.sub("", bare))
    if any(p.search(bare) for p in MARKDOWN):
        found.add("markdown")
    return found


#: Code and formulas, set aside before anything else is read; the outermost one that begins first counts.
_ASIDE = regex.compile(
    r"(?m:^[ \t]*(?P<mark>```|~~~)[^\n]*\n(?P<fence>(?s:.*?))\n?[ \t]*(?P=mark)[ \t]*$)"
    r"|<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(?P<pre>(?s:.*?))(?:</code>\s*)?</pre>"
    r"|<code\b[^>]*>(?P<span>(?s:.*?))</code>"
    r"|\\begin\{(?P<env>verbatim|lstlisting)\}\s*(?P<verbatim>(?s:.*?))\s*\\end\{(?P=env)\}"
    r"|\\begin\{(?P<math>equation|align|displaymath|math|gather)\*?\}\s*(?P<display>(?s:.*?))\s*\\end\{(?P=math)\*?\}"
    r"|\\\[\s*(?P<square>(?s:.+?))\s*\\\]|\\\(\s*(?P<round>[^\n]+?)\s*\\\)|\$\$(?=[^$]*[\\^_=A-Za-z])\s*(?P<dollars>[^$]+?)\s*\$\$"
    rf"|(?P<dollar>{_LATEX[4]}|{_LATEX[5]})"
    r"|(?<!`)(?P<ticks>`+)(?=[^`])(?P<inline>[^\n]*?[^`])(?P=ticks)(?!`)",
    regex.IGNORECASE,
)
_FENCED = ("fence", "pre", "verbatim")
_DISPLAY = ("display", "square", "dollars")
_ODD_AMPERSAND = regex.compile(r"&(?!#\d{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]{1,30};)")
DEPTH = 100  # levels of nesting that are read; what lies deeper stays as it stands


def _aside(m: regex.Match) -> str:
    """Code or a formula in its one form."""
    kind = next(k for k in (*_FENCED, *_DISPLAY, "span", "round", "dollar", "inline") if m[k] is not None)
    if kind in _FENCED:
        code = unescape(m[kind]) if kind == "pre" else m[kind]
        return "\n```\n" + code.strip("\n") + "\n```\n"
    if kind in _DISPLAY:
        return f"\n$${m[kind]}$$\n" if kind == "display" else f"$${m[kind]}$$"
    return {"span": lambda: f"`{unescape(m['span'])}`", "round": lambda: f"${m['round']}$"}.get(kind, m.group)()


def from_html(text: str) -> str:
    """Text with HTML elements: headings, list items, quotations and table rows as lines, all other elements as their text."""
    blocks: list[tuple[str, bool]] = []  # text, whether it is a row of a table
    now: list[str] = []
    lists: list[list] = []
    row: list[str] | None = None
    lead, quotes = "", 0

    def flush() -> None:
        nonlocal lead
        said = "".join(now).strip()
        now.clear()
        if said:
            blocks.append(("> " * quotes + lead + said, False))
            lead = ""

    for kind, path, name in events(_ODD_AMPERSAND.sub("&amp;", text)):
        if kind == "text":
            if not path.endswith(("/script", "/style")):
                now.append(name)
        elif name == "br":
            now.append("\n" if kind == "open" else "")
        elif name in ("td", "th") and row is not None:
            if kind == "close":
                row.append(" ".join("".join(now).split()))
            now.clear()
        elif name in BLOCKS:
            if row is None or name in ("tr", "table"):
                flush()
            if name == "tr":
                if row:
                    blocks.append((" | ".join(row), True))
                row = [] if kind == "open" else None
            elif name in ("ul", "ol"):
                if kind == "open":
                    lists.append([name, 0])
                elif lists:
                    lists.pop()
            elif name == "li":
                lead = ""
                if kind == "open":
                    if lists:
                        lists[-1][1] += 1
                    lead = "  " * (len(lists) - 1) + (f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- ")
            elif name == "blockquote":
                quotes += 1 if kind == "open" else -1
            elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
                lead = "#" * int(name[1]) + " " if kind == "open" else ""
    flush()
    out = ""
    for i, (said, of_table) in enumerate(blocks):
        out += ("" if not i else "\n" if of_table and blocks[i - 1][1] else "\n\n") + said
    return out


_WIKI_SIGN = regex.compile(r"(?m)\{\{|\}\}|\[\[|\]\]|^[ \t]*\{\||^[ \t]*\|\}")
_WIKI_ENDS = {"{{": "}}", "[[": "]]", "{|": "|}"}
_FILE = regex.compile(r"\s*(?:File|Image|Datei|Fichier|Archivo|Category|Kategorie)\s*:", regex.IGNORECASE)


def _wiki_part(sign: str, inner: str) -> str:
    if sign == "[[":
        if "\n" in inner or regex.search(r"\]\s*,?\s*\[", inner) or not inner.strip():
            return f"[[{inner}]]"
        name, *rest = inner.split("|")
        if _FILE.match(name):
            words = [x for x in rest if "=" not in x and not regex.fullmatch(r"\s*(?:thumb|frame|left|right|center|none|\d+px)\s*", x)]
            return words[-1] if words else ""
        return rest[-1] if rest else name
    parts = [x.strip() for x in inner.split("|")]
    if sign == "{|":
        return inner
    name, rest = parts[0].lower(), parts[1:]
    if name == "convert" and len(rest) >= 2:
        return f"{rest[0]} {rest[1]}"
    named = [x for x in rest if regex.match(r"[\w ]+=", x)]
    if named:
        return "\n" + "\n".join(f"{k.strip()}: {v.strip()}" for k, v in (x.split("=", 1) for x in named)) + "\n"
    return rest[-1] if rest else ""


def _wiki_table(inner: str) -> str:
    """Rows of a table, by line; the first line has only its attributes."""
    rows: list[list[str]] = [[]]
    for line in inner.split("\n")[1:]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows[-1:] = [[line[2:].strip()], []]
        elif line[:1] in ("|", "!"):
            rows[-1] += [c.strip() for c in regex.split(r"\|\||!!", line[1:])]
        elif line and rows[-1]:
            rows[-1][-1] += f" {line}"
        elif line:
            rows[-1].append(line)
    return "\n" + "\n".join(" | ".join(c for c in r if c) for r in rows if any(r)) + "\n"


def from_wiki(text: str) -> str:
    """Templates, links and tables by their brackets, innermost first; then headings, marks and outer links."""
    open_: list[tuple[str, str, list[str]]] = []  # kind, sign as it stands, parts up to now
    base: list[str] = []

    def put(x: str) -> None:
        (open_[-1][2] if open_ else base).append(x)

    at = 0
    for m in _WIKI_SIGN.finditer(text):
        put(text[at : m.start()])
        at, sign = m.end(), m.group().strip()
        if sign in _WIKI_ENDS and len(open_) < DEPTH:
            open_.append((sign, m.group(), []))
        elif open_ and sign == _WIKI_ENDS[open_[-1][0]]:
            kind, _, parts = open_.pop()
            inner = "".join(parts)
            put(_wiki_table(inner) if kind == "{|" else _wiki_part(kind, inner))
        else:
            put(m.group())
    put(text[at:])
    while open_:  # never closed
        _, sign, parts = open_.pop()
        put(sign)
        put("".join(parts))
    text = "".join(base)
    text = regex.sub(r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]\n]+)\](?!\()", r"\1", text)
    text = regex.sub(r"(?m)^\s*(={2,6})\s*([^=\n]+?)\s*\1\s*$", lambda m: f"{'#' * len(m[1])} {m[2]}", text)
    return regex.sub(r"'{2,5}|__(?:NO)?TOC__", "", text)


_COMMAND_HEAD = regex.compile(r"~?\\([A-Za-z]+)\*?")
_NO_TEXT = frozenset(("cite", "citep", "citet", "ref", "label", "eqref", "pageref", "vspace", "hspace", "index"))
_BARE = {"par": "\n\n", "noindent": "", "ldots": "…", "dots": "…", "maketitle": "", "newline": "\n"}


def _group(text: str, at: int, ends: str) -> int:
    """Behind the bracket that closes the one at ``at``; -1 if none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == ends[0]:
            depth += 1
        elif text[i] == ends[1]:
            depth -= 1
            if not depth:
                return i + 1
    return -1


def from_latex(text: str, depth: int = 0) -> str:
    """Commands by their arguments, read by balanced braces: sections as headings, items as list lines, others as their last argument."""
    if "\\" not in text or depth >= DEPTH:
        return text
    out: list[str] = []
    lists: list[int | None] = []
    at = 0
    while m := _COMMAND_HEAD.search(text, at):
        name, end, args = m[1], m.end(), []
        while end < len(text) and text[end] in "[{":
            stop = _group(text, end, "[]" if text[end] == "[" else "{}")
            if stop < 0 or (text[end] == "[" and name != "item" and "{" not in text[stop : stop + 1] and not args):
                break
            if text[end] == "{":
                args.append(text[end + 1 : stop - 1])
            end = stop
        out.append(text[at : m.start()])
        at = end
        if name in ("begin", "end") and args:
            if args[0].rstrip("*") in ("enumerate", "itemize", "description"):
                if name == "begin":
                    lists.append(0 if args[0].startswith("enum") else None)
                elif lists:
                    lists.pop()
            out.append("\n")
        elif name == "item":
            if lists and lists[-1] is not None:
                lists[-1] += 1
            while out and not out[-1].strip():
                out.pop()
            if out:
                out[-1] = out[-1].rstrip()
            out.append(f"\n{lists[-1]}. " if lists and lists[-1] is not None else "\n- ")
            at += len(text) - at - len(text[at:].lstrip())
        elif name in _NO_TEXT and args:
            if out and out[-1].endswith("(") and text[at : at + 1] == ")":
                out[-1], at = out[-1][:-1].rstrip(), at + 1
        elif args:
            last = from_latex(args[-1], depth + 1)
            if name.endswith("section") or name in ("chapter", "part"):
                level = 1 if name in ("chapter", "part") else 2 + name.count("sub")
                out.append(f"\n{'#' * level} {last}\n")
            elif name == "footnote":
                out.append(f" ({last})")
            elif name == "frac" and len(args) > 1:
                out.append(f"{from_latex(args[0], depth + 1)}/{last}")
            else:
                out.append(last)
        elif name in _BARE:
            out.append(_BARE[name])
            at += len(text) - at - len(text[at:].lstrip(" "))
        else:
            out.append(m.group())  # a path, or a sign of its own
    out.append(text[at:])
    return "".join(out)


_EMPHASIS = regex.compile(r"(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1|(?<!\w)(_{1,3})(?=[^\s_])([^\n_]*?[^\s_])\3(?!\w)|~~(?=\S)([^~\n]+)~~")
_MARKDOWN_PLAIN = [
    (regex.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (regex.compile(r"\[([^\]\n]+)\]\([^)\n]*\)"), r"\1"),
    (regex.compile(r"(?<!\[)\[([^\]\[\n]+)\]\[[^\]\[\n]*\]"), r"\1"),
    (regex.compile(r"(?m)^(\S[^\n]*)\n\s{0,3}={3,}\s*$"), r"# \1"),
    (regex.compile(r"(?m)^([^\s|][^\n|]*)\n\s{0,3}-{3,}\s*$"), r"## \1"),
    (regex.compile(r"(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$\n?"), ""),
    (regex.compile(r"(?m)^\s*\|(.*)\|\s*$"), lambda m: " | ".join(x.strip() for x in m[1].split("|"))),
    (regex.compile(r"(?m)^(\s*)[*+]\s+(?=\S)"), r"\1- "),
    (regex.compile(r"(?m)^\s{0,3}>\s?(?=\S)"), "> "),
]


def from_markdown(text: str) -> str:
    """Links and images as their text, headings, lists, quotations and table rows in one form, emphasis without its signs."""
    for p, form in _MARKDOWN_PLAIN:
        text = p.sub(form, text)
    while True:
        bare = _EMPHASIS.sub(lambda m: next(g for g in (m[2], m[4], m[5]) if g is not None), text)
        if bare == text:
            return text
        text = bare


def to_plain(text: str) -> str:
    """The text without its markup: headings as #, items as - or numbered, quotations as >, table rows by |, code in
    ticks or fences, formulas in dollar signs."""
    kept: list[str] = []

    def put(m: regex.Match) -> str:
        kept.append(_aside(m))
        return f"\x00{len(kept) - 1}\x00"

    if _SIGNS.search(text) or "\\" in text:
        text = _ASIDE.sub(put, text.replace("\x00", " "))
        if "<" in text and (_TAG.search(text) or _COMMENT.search(text)):
            text = from_html(text)
        else:
            text = _ENTITY.sub(lambda m: unescape(m.group()), text)
        text = from_markdown(from_latex(from_wiki(text)))
    lines = [x[: len(x) - len(x.lstrip())].replace("\t", "  ") * (x.lstrip()[:2] == "- ") + " ".join(x.split()) for x in text.split("\n")]
    text = "\n".join(lines)
    if kept:
        text = regex.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)
    return regex.sub(r"\n{3,}", "\n\n", text).strip()
