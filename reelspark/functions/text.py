"""Scalar text functions as column expressions; null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspark.functions.udf import arrow_udf

# The code points for which Python's str.isspace() holds.
UNICODE_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Language names and codes that a target language may be given by.
TARGETS = {
    "korean": "ko", "한국어": "ko", "ko": "ko", "kr": "ko", "japanese": "ja", "日本語": "ja", "ja": "ja", "jp": "ja",
    "chinese": "zh", "中文": "zh", "zh": "zh", "russian": "ru", "ru": "ru", "arabic": "ar", "ar": "ar", "english": "en", "en": "en",
}
# The characters that speak for a script, by target language.
SCRIPTS = {"ko": "\\uac00-\\ud7a3", "ja": "\\u3040-\\u30ff\\u4e00-\\u9fff", "zh": "\\u4e00-\\u9fff", "ru": "\\u0400-\\u04ff", "ar": "\\u0600-\\u06ff", "en": "a-zA-Z"}
# Names that are never listed, besides all that begin with a point.
HIDDEN = (".obsidian", ".playwright-cli", ".DS_Store", ".git", "__pycache__", "_run_summary.json", "index.html")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def collapse_ws(c: Column | str) -> Column:
    """Each run of Unicode white space becomes one space, the ends are trimmed."""
    return F.trim(F.regexp_replace(_c(c), f"[{UNICODE_SPACE}]+", " "))


def safe_name(c: Column | str) -> Column:
    """Slashes and colons as hyphens, ends stripped."""
    return _strip(F.regexp_replace(_c(c), r"[/\\:]", "-"), UNICODE_SPACE)


def safe_name_url(c: Column | str) -> Column:
    """Fit for a URL path: separators as hyphens, quotes and brackets dropped, runs collapsed."""
    c = F.regexp_replace(_c(c), r"[/\\:?#&+%]", "-")
    c = collapse_ws(F.regexp_replace(c, r"[\"'<>(){}\[\]|]", ""))
    return _strip(F.regexp_replace(c, "-{2,}", "-"), " \\-")


def safe_name_file(c: Column | str) -> Column:
    """Fit for a file name: reserved and control characters as spaces, at most 120 characters, never empty."""
    c = collapse_ws(F.regexp_replace(_c(c), r"[\\/:*?\"<>|#%&{}\[\]\x00-\x1f]+", " "))
    c = _strip(c, ". ")
    return F.left(F.when(c == "", F.lit("untitled")).otherwise(c), F.lit(120))


def ms_to_ts(ms: Column | str) -> Column:
    """Milliseconds as HH:MM:SS,mmm; hours are unbounded."""
    ms = _c(ms).cast("long")
    part = lambda unit, mod: F.pmod(F.floor(ms / unit), F.lit(mod)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("long"), part(60000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def ts_to_s(ts: Column | str) -> Column:
    """HH:MM:SS,mmm (or a point) as seconds; the last part always counts thousandths."""
    at = lambda i: F.regexp_extract(_c(ts), r"(\d+):(\d+):(\d+)[.,](\d+)", i).try_cast("long")
    return at(1) * 3600 + at(2) * 60 + at(3) + at(4) / 1000.0


def ts_display(seconds: Column | str, always_hours: bool = False) -> Column:
    """H:MM:SS from one hour on, else M:SS; with ``always_hours`` HH:MM:SS."""
    s = F.floor(_c(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.pmod(F.floor(s / 60).cast("long"), F.lit(60)), F.pmod(s, F.lit(60))
    if always_hours:
        return F.format_string("%02d:%02d:%02d", h, m, r)
    return F.when(s.isNull(), None).when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def hms_to_seconds(c: Column | str) -> Column:
    """H:M:S, M:S or S as seconds; of more than three parts the last three count."""
    parts = F.split(_c(c), ":")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    return F.when(_c(c).isNotNull(), at(-3) * 3600 + at(-2) * 60 + at(-1))


def video_id(url: Column | str, query_only: bool = False) -> Column:
    """The 11-character id after v= or youtu.be/ (``query_only``: after ?v= or &v=); null without one."""
    pattern = r"[?&]v=([A-Za-z0-9_-]{11})" if query_only else r"(?:v=|youtu\.be/)([A-Za-z0-9_\-]{11})"
    return F.nullif(F.regexp_extract(_c(url), pattern, 1), F.lit(""))


def hidden_name(c: Column | str) -> Column:
    return _c(c).startswith(".") | _c(c).isin(*HIDDEN)


def target_code(c: Column | str) -> Column:
    """The code of a language name or code; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    return F.try_element_at(table, F.lower(_strip(_c(c), UNICODE_SPACE)))


def slug(c: Column | str) -> Column:
    return F.coalesce(target_code(c), F.regexp_replace(F.lower(_c(c)), f"[{UNICODE_SPACE}]+", "-"))


def script_ratio(text: Column | str, code: str) -> Column:
    """The share of a target's script among the letters; null without letters or for an unknown target."""
    if code not in SCRIPTS:
        return F.lit(None).cast("double")
    hits = F.char_length(F.regexp_replace(_c(text), f"[^{SCRIPTS[code]}]", ""))
    letters = F.char_length(F.regexp_replace(_c(text), f"[^\\p{{L}}{SCRIPTS[code]}]", ""))
    return F.when(letters > 0, hits / letters)


def already_target(text: Column | str, code: str) -> Column:
    """Whether more than half of the letters are in the target's script; false without letters or for unknown targets."""
    return F.coalesce(script_ratio(text, code) > 0.5, F.lit(False))


def url_quote(c: Column | str) -> Column:
    """Percent-encoding that leaves slashes and is idempotent; a percent sign that encodes nothing is encoded itself."""
    # Plus signs stand for themselves in paths, so they and stray percent signs are encoded before the decoding.
    whole = F.replace(F.regexp_replace(_c(c), "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    c = F.url_encode(F.url_decode(whole))
    for raw, ref in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def html_escape(c: Column | str) -> Column:
    c = _c(c)
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


@arrow_udf("struct<file:string,anchor:string>")
def _resolve(href: str | None, base: str | None):
    from posixpath import join, normpath
    from urllib.parse import unquote

    if href is None:
        return None
    path, _, anchor = href.partition("#")
    path = unquote(path)
    return (normpath(join(base or "", path)) if path else None, anchor or None)


def resolve_href(href: Column | str, base: Column | str) -> Column:
    """(file, anchor) of a link, the file normalised against the folder it stands in; a bare anchor has no file."""
    return _resolve(_c(href), _c(base))


def source_label(url: Column | str) -> Column:
    """The link without scheme and www., cut to 45 characters and an ellipsis if longer than 48."""
    c = F.regexp_replace(F.regexp_replace(_c(url), "^https?://", ""), r"^www\.", "")
    return F.when(F.char_length(c) > 48, F.concat(F.left(c, F.lit(45)), F.lit("…"))).otherwise(c)


def md_alt_safe(c: Column | str) -> Column:
    return F.translate(collapse_ws(c), "[]", "()")


def tokens(c: Column | str) -> Column:
    """The distinct lower-cased words of letters, digits and Hangul."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-z0-9가-힣]+)"), F.lit(1)))


def est_cost(n: Column | str, unit_price: Column | float, allowance: float = 1.3) -> Column:
    """Units times price with an allowance on top; prices are the caller's."""
    return _c(n) * (unit_price if isinstance(unit_price, Column) else F.lit(unit_price)) * allowance


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "<[^>]+>", "")


def numeric_only(c: Column | str) -> Column:
    return _c(c).rlike(rf"^(?U)[{UNICODE_SPACE}\d:./\-,▶•]+$")


RANKER_ITEM = "struct<frame_index:int,include:boolean,alt_text:string,caption:string,confidence:double>"


def parse_ranker_json(answer: Column | str, expected: Column | int) -> Column:
    """(items, error): the answer without code fences as an array of the expected length, or what is wrong with it."""
    bare = F.trim(F.regexp_replace(F.trim(_c(answer)), r"^```(?:json)?\s*|\s*```$", ""))
    items = F.from_json(bare, f"array<{RANKER_ITEM}>", {"mode": "PERMISSIVE"})
    ok = bare.startswith("[") & items.isNotNull()
    n = expected if isinstance(expected, Column) else F.lit(expected)
    error = F.when(~F.coalesce(ok, F.lit(False)), F.lit("not a JSON array")).when(F.size(items) != n, F.lit("wrong length"))
    return F.struct(F.when(error.isNull(), items).alias("items"), error.alias("error"))


def translated_payload(answer: Column | str, expected: Column | int) -> Column:
    """(items, error): a list of (id, text), bare or under ``items`` or ``translations``, of the expected length."""
    item = "array<struct<id:int,text:string>>"
    bare = F.trim(F.regexp_replace(F.trim(_c(answer)), r"^```(?:json)?\s*|\s*```$", ""))
    wrapped = F.from_json(bare, f"struct<items:{item},translations:{item}>")
    items = F.when(bare.startswith("["), F.from_json(bare, item)).otherwise(F.coalesce(wrapped["items"], wrapped["translations"]))
    n = expected if isinstance(expected, Column) else F.lit(expected)
    error = F.when(items.isNull(), F.lit("no list of items")).when(F.size(items) != n, F.lit("wrong length"))
    return F.struct(F.when(error.isNull(), items).alias("items"), error.alias("error"))


def render_prompt(template: Column | str, start: Column, end: Column, window: Column) -> Column:
    c = _c(template)
    for name, value in (("window_start", start), ("window_end", end), ("transcript_window", window)):
        c = F.replace(c, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return c


def prompt_body(text: Column | str) -> Column:
    """What follows the first line of three hyphens; the whole text without one."""
    at = F.instr(_c(text), "---")
    return F.when(at > 0, F.substring(_c(text), at + 3, F.char_length(_c(text)))).otherwise(_c(text))


def is_reasoning_model(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike("(?i)^(gpt-5|o[1-4])"), F.lit(False))


def frontmatter(title: Column | str, source: Column | str) -> Column:
    """A YAML header; the source line only where there is one."""
    head = F.concat(F.lit('title: "'), F.replace(F.coalesce(_c(title), F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    src = F.when(F.coalesce(_c(source), F.lit("")) != "", F.concat(F.lit("source: "), _c(source)))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", head, src), F.lit("\n---\n"))
