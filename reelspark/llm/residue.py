"""Find template residue, filler, error pages and script notices that stand in for content.

Character n-gram models of filler, of error and script notices, and of placeholders are set against a model of natural
prose. The models of residue start from a few neutral examples (``residue_seeds``) and are then fitted on the corpus
itself: every distinct sentence that the models so far mark with a wide margin joins the residue and leaves the prose,
and the models are fitted again (``ROUNDS`` times, over all sentences). Sentences count once however often they stand,
so a notice that fills a third of the rows weighs no more than one that stands once.

The log likelihood ratio of every n-gram is looked up and summed over sliding windows inside each sentence; a sentence
whose covered share is large enough is filler or a notice, a stretch of windows in the shape of a placeholder is one.
Code and quotations are blanked first. Texts are scored many at a time, as one array of code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm import residue_seeds as seeds
from reelspark.session import materialize, spread

BITS = 18
BUCKETS = 1 << BITS
ORDERS = (3, 5)
SHAPE_ORDERS = (3, 5)
KINDS = ("filler", "notice")
WINDOW = 24
COVERAGE = 0.5
CLIP = 4.0
PROSE_IN_RESIDUE = 0.15
PROSE_PRIOR = 0.02  # share of the prose model given to sentences that talk about errors, scripts and templates; each counts once at least
THRESHOLD = 0.6  # mean log ratio of a window
ROUNDS = 3
LEARN_COVERAGE = 0.9  # share of a sentence that windows must cover for it to be learned from
LEARN_MEAN = 0.7
SHAPE_WINDOW = 4
SHAPE_THRESHOLD = 0.9
WORDED_WINDOW = 4
WORDED_THRESHOLD = 1.2
SHARED = 3  # worded examples of placeholders that must have an n-gram for it to count
CHUNK = 300_000  # code points scored at a time

FENCE = regex.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", regex.DOTALL)
CODE = regex.compile(r"`+[^`\n]+`+")
QUOTE = regex.compile(r"\"[^\"\n]+\"|“[^”\n]+[”“]|„[^“”\n]+[“”]|«[^»\n]+»|»[^«\n]+«|‘[^’\n]+’|「[^」\n]+」|『[^』\n]+』")
PAYLOAD = regex.compile(r"(?m)^\s*\{\s*\"(?:error|errors|status|message|code)\".*\}\s*$", regex.IGNORECASE)
MAY_BLANK = regex.compile(r"[`\"“„«»‘「『]|~~~")
SENTENCE_BREAK = re.compile(r"\n+|(?<=[.!?…])\s+|(?<=[。！？])")  # as `Chunk` has it
ZEROS = bytes.maketrans(b"123456789", b"0" * 9)
HELD_SENTENCES = 500_000  # whose hashes a task remembers at a time
LATIN_ENDS = tuple(ord(c) for c in ".!?…")
DENSE_ENDS = tuple(ord(c) for c in "。！？")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point below 65,536: lower case with digits as 0 and white space as a space; its shape; whether it is white space."""
    low, shape, space = np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        c = chr(i)
        if c.isdigit():
            low[i] = shape[i] = ord("0")
        elif c.isspace():
            low[i] = shape[i] = ord(" ")
            space[i] = True
        elif c.isalpha():
            small = c.lower()
            low[i] = ord(small) if len(small) == 1 else i
            shape[i] = ord("A") if c.isupper() else ord("a")
    return low, shape, space


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Views:
    """Code points as two sequences, padded by spaces, each with the place of every point in the text.

    ``plain``: lower case, digits as 0, runs of white space as one. ``shape``: letters as a or A, digits as 0, all else
    as it is, runs of more than two alike cut to two.
    """

    def __init__(self, tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.low, self.form, self.space = tables or _tables()

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.low, self.form, self.space

    @staticmethod
    def _map(points: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.full(len(points) + 2, ord(" "), np.uint32)
        if len(points) and points.max() >= 1 << 16:
            out[1:-1] = np.where(points < (1 << 16), table[np.minimum(points, (1 << 16) - 1)], points)
        else:
            out[1:-1] = table[points]
        return out

    def plain(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self._map(points, self.low)
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
        at = np.flatnonzero(keep)
        return out[at], at - 1

    def shape(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self._map(points, self.form)
        keep = np.ones(len(out), bool)
        last = out[2:]
        alike = (last == out[1:-1]) & (last == out[:-2])
        keep[2:] = ~(alike & ((last == 97) | (last == 65) | (last == 48) | (last == 32)))
        at = np.flatnonzero(keep)
        return out[at], at - 1

    def is_space(self, points: np.ndarray) -> np.ndarray:
        return self.space[np.minimum(points, (1 << 16) - 1)] & (points < (1 << 16))


def hashed(points: np.ndarray, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """For each order the buckets of the n-grams that start at each place."""
    h = np.zeros(len(points), np.uint32)
    out = []
    for k in range(max(orders)):
        n = max(0, len(points) - k)
        h = (h[:n] * np.uint32(0x01000193)) ^ points[k:]
        if k + 1 in orders:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(k * 0x3C6EF372 & 0xFFFFFFFF)
            out.append(mixed >> np.uint32(32 - BITS))
    return out


def count(texts: list[str], view, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Per bucket how often the n-grams of the texts fall into it."""
    out = np.zeros(BUCKETS, np.int64)
    points = view(codes(" \0 ".join(texts)))[0]
    parts = np.concatenate([[0], np.cumsum(points == 0)])
    for k, h in zip(orders, hashed(points, orders), strict=True):
        out += np.bincount(h[parts[k:] == parts[:-k]], minlength=BUCKETS)
    return out


def log_ratio(residue: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """Per bucket the log likelihood ratio of residue against prose, at most ``CLIP``.

    Residue is modelled as its examples mixed with ``PROSE_IN_RESIDUE`` of prose, so an n-gram no example has speaks
    against residue, however rare it is in prose.
    """
    p = (prose + 0.02) / (prose.sum() + 0.02 * BUCKETS)
    r = (1 - PROSE_IN_RESIDUE) * residue / max(1, residue.sum()) + PROSE_IN_RESIDUE * p
    return np.minimum(np.log(r) - np.log(p), CLIP).astype(np.float32)


def blank_asides(text: str) -> str:
    """The text with code and quotations as spaces; error payloads, which are quoted by nature, stay."""
    if not MAY_BLANK.search(text):
        return text
    keep = [m.span() for m in PAYLOAD.finditer(text)]

    def blank(m: regex.Match) -> str:
        if any(a <= m.start() < b for a, b in keep):
            return m.group()
        return regex.sub(r"[^\n]", " ", m.group())

    for form in (FENCE, CODE, QUOTE):
        text = form.sub(blank, text)
    return text


def _mean_ratios(hashes: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    n = len(hashes[-1])
    return sum(table[h[:n]] for h in hashes) / len(hashes)


class Chunk:
    """Many texts as one array: the sentences of all, and the n-grams that start in each."""

    def __init__(self, views: Views, texts: list[str]) -> None:
        self.points = codes("\n".join(texts))
        self.views = views
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # where each text begins
        space = views.is_space(self.points)
        # A cut stands before a place: behind a line end, behind an end mark with a space behind it, behind a dense end mark.
        cut = np.zeros(len(self.points) + 1, bool)
        if len(self.points):
            cut[1:] = (self.points == 10) | np.isin(self.points, DENSE_ENDS)
            cut[1:-1] |= np.isin(self.points[:-1], LATIN_ENDS) & space[1:]
        self.ink = np.flatnonzero(~space)
        part = np.cumsum(cut[:-1])[self.ink]
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        first = np.flatnonzero(new)
        self.starts = self.ink[first]
        self.ends = self.ink[np.concatenate([first[1:], [len(self.ink)]]).astype(np.int64) - 1] + 1 if len(first) else self.starts
        self.inked = np.diff(np.concatenate([first, [len(self.ink)]]))
        self.plain, self.at = views.plain(self.points)
        self.hashes = hashed(self.plain)
        n = len(self.hashes[-1])
        # The n-grams of a sentence start on the space before it and end on the one behind it.
        self.first = np.minimum(np.maximum(np.searchsorted(self.at, self.starts) - 1, 0), n)
        self.last = np.minimum(np.maximum(np.searchsorted(self.at, self.ends) + 2 - max(ORDERS), self.first), n)

    def ratios(self, table: np.ndarray) -> np.ndarray:
        return _mean_ratios(self.hashes, table)

    def covered(self, table: np.ndarray, threshold: float, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentences, mean ratio, share of their places in windows above the threshold) of those with a mean above ``floor``."""
        r = self.ratios(table)
        sums = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
        means = (sums[self.last] - sums[self.first]) / np.maximum(self.last - self.first, 1)
        some = np.flatnonzero((means > floor) & (self.last > self.first))
        return some, means[some], np.array([covered(r[self.first[i] : self.last[i]], threshold) for i in some])

    def owners(self, places: np.ndarray) -> np.ndarray:
        """Which text each place lies in."""
        return np.searchsorted(self.base, places, side="right") - 1


def covered(ratios: np.ndarray, threshold: float, window: int = WINDOW) -> float:
    """The share of the places that lie in a window whose mean ratio is above the threshold."""
    n = len(ratios)
    if n == 0:
        return 0.0
    w = min(window, n)
    sums = np.concatenate([[0.0], np.cumsum(ratios, dtype=np.float64)])
    hot = np.flatnonzero((sums[w:] - sums[:-w]) / w > threshold)
    mark = np.bincount(hot, minlength=n + 1) - np.bincount(hot + w, minlength=n + 1)
    return float((np.cumsum(mark[:n]) > 0).mean())


def hot_stretches(ratios: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the stretches covered by windows whose mean ratio is above the threshold."""
    w = min(window, len(ratios))
    if w == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.concatenate([[0.0], np.cumsum(ratios, dtype=np.float64)])
    hot = np.flatnonzero((sums[w:] - sums[:-w]) / w > threshold)
    if not len(hot):
        return hot, hot
    new = np.ones(len(hot), bool)
    new[1:] = hot[1:] > hot[:-1] + w
    first = np.flatnonzero(new)
    return hot[first], hot[np.concatenate([first[1:], [len(hot)]]) - 1] + w - 1


def in_chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of stretches of about ``size`` code points; a longer text is a stretch of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


class Models:
    """The likelihood-ratio tables, from counts of prose and of what was learned from the corpus so far."""

    def __init__(self, prose: np.ndarray, prose_shapes: np.ndarray, learned: tuple[np.ndarray, ...] = (), views: Views | None = None) -> None:
        self.views = views or Views()
        learned = learned or tuple(np.zeros(BUCKETS, np.int64) for _ in KINDS)
        mention = count(seeds.lines(seeds.MENTION), self.views.plain)
        prose = np.maximum(prose - 1 - sum(learned), 0)  # no sentence speaks for itself
        prose = prose + count(seeds.lines(seeds.PROSE), self.views.plain)
        prose = prose + mention * max(1.0, PROSE_PRIOR * prose.sum() / mention.sum())
        # Square roots: a pattern that was learned a thousand times doesn't drown those that were learned once.
        started = [count(seeds.lines(block), self.views.plain) for block in (seeds.FILLER, seeds.NOTICE)]
        self.tables = {kind: log_ratio(s + np.sqrt(more), prose) for kind, s, more in zip(KINDS, started, learned, strict=True)}
        # A placeholder is a stretch of a sentence; of its examples only the odd n-grams speak for it: those with signs
        # in them, and those that several worded examples share.
        self.shape = log_ratio(sum(self._odd(self.views.shape(codes(x))[0]) for x in seeds.shapes()), np.maximum(prose_shapes - 1, 0) + count(seeds.lines(seeds.PROSE), self.views.shape, SHAPE_ORDERS))
        shared = sum((count([x], self.views.plain) > 0).astype(np.int64) for x in seeds.lines(seeds.WORDED))
        self.worded = log_ratio(np.where(shared >= SHARED, shared, 0), prose)

    def state(self) -> tuple:
        """All arrays, as they are sent to the executors: a few megabytes, whatever the input."""
        return self.views.tables(), self.tables, self.worded, self.shape

    @classmethod
    def of(cls, state: tuple) -> Models:
        made = cls.__new__(cls)
        tables, made.tables, made.worded, made.shape = state
        made.views = Views(tables)
        return made

    @staticmethod
    def _odd(shape: np.ndarray) -> np.ndarray:
        """Counts of the n-grams that hold a sign or a double underscore."""
        plain = np.isin(shape, [ord(c) for c in "aA0_ "])
        odd = ~plain
        odd[:-1] |= (shape[:-1] == ord("_")) & (shape[1:] == ord("_"))
        sums = np.concatenate([[0], np.cumsum(odd)])
        out = np.zeros(BUCKETS, np.int64)
        for k, h in zip(SHAPE_ORDERS, hashed(shape, SHAPE_ORDERS), strict=True):
            out += np.bincount(h[sums[k:] > sums[:-k]], minlength=BUCKETS)
        return out

    def learnable(self, chunk: Chunk, kind: str) -> np.ndarray:
        """The sentences that speak for a kind with a wide margin."""
        some, means, shares = chunk.covered(self.tables[kind], THRESHOLD, LEARN_MEAN)
        return some[shares >= LEARN_COVERAGE]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """Per text (start, end, kind, coverage) of the sentences that hold residue, in order."""
        out: list[list] = [[] for _ in texts]
        for at, some in in_chunks(texts):
            clean = [blank_asides(t) for t in some]
            chunk = Chunk(self.views, clean)
            blanked = [i for i, (a, b) in enumerate(zip(some, clean, strict=True)) if a is not b]
            for text, *span in self._spans(chunk, {i: some[i] for i in blanked}):
                out[at + text].append(tuple(span))
        return [sorted(spans) for spans in out]

    def _spans(self, chunk: Chunk, originals: dict[int, str]) -> Iterator[tuple[int, int, int, str, float]]:
        found: dict[int, tuple[str, float]] = self._placeholders(chunk)
        for kind, table in self.tables.items():
            some, means, shares = chunk.covered(table, THRESHOLD, THRESHOLD / 4)
            for i, share in zip(some.tolist(), shares.tolist(), strict=True):
                if share >= COVERAGE and share > found.get(i, ("", 0.0))[1] and found.get(i, ("",))[0] != "placeholder":
                    found[i] = (kind, share)
        if not found:
            return
        at = np.array(sorted(found))
        owners = chunk.owners(chunk.starts[at])
        for i, text in zip(at.tolist(), owners.tolist(), strict=True):
            a, b = int(chunk.starts[i] - chunk.base[text]), int(chunk.ends[i] - chunk.base[text])
            kind, share = found[i]
            if text in originals and kind != "placeholder":
                # Most of the line's sentence is a quotation or code: somebody shows it.
                line = originals[text]
                lo, hi = a, b
                while lo > 0 and line[lo - 1] != "\n" and (line[lo - 1].isspace() or chunk.points[chunk.base[text] + lo - 1] == 32):
                    lo -= 1
                while hi < len(line) and line[hi] != "\n" and chunk.points[chunk.base[text] + hi] == 32:
                    hi += 1
                if chunk.inked[i] < 0.6 * len("".join(line[lo:hi].split())):
                    continue
            yield text, a, b, kind, round(share, 4)

    def _placeholders(self, chunk: Chunk) -> dict[int, tuple[str, float]]:
        """The sentences with a stretch in the shape, or with the words, of a placeholder; the share it covers."""
        found: dict[int, tuple[str, float]] = {}
        shape, at = self.views.shape(chunk.points)
        odd = _mean_ratios(hashed(shape, SHAPE_ORDERS), self.shape)
        stretches = [(*hot_stretches(odd, SHAPE_WINDOW, SHAPE_THRESHOLD), at, max(SHAPE_ORDERS))]
        stretches.append((*hot_stretches(chunk.ratios(self.worded), WORDED_WINDOW, WORDED_THRESHOLD), chunk.at, max(ORDERS)))
        for first, last, places, order in stretches:
            if not len(first) or not len(chunk.starts):
                continue
            a, b = places[first], places[np.minimum(last + order - 1, len(places) - 1)]
            near = np.searchsorted(chunk.starts, np.minimum(b, np.maximum(a, 0) + 1), side="right") - 1
            for i, x, y in zip(near.tolist(), a.tolist(), b.tolist(), strict=True):
                if i < 0:
                    continue
                lo, hi = int(chunk.starts[i]), int(chunk.ends[i])
                share = (min(y + 1, hi) - max(x, lo)) / (hi - lo)
                if share > 0:
                    found[i] = ("placeholder", min(1.0, found.get(i, ("", 0.0))[1] + share))
        return found


def _counts_of(chunk: Chunk, sentences: np.ndarray | None = None) -> np.ndarray:
    """For each bucket the n-grams of the sentences given, of all if none are."""
    total = np.zeros(BUCKETS, np.int64)
    if sentences is None:
        for h in chunk.hashes:
            total += np.bincount(h, minlength=BUCKETS)
        return total
    for i in sentences.tolist():
        for h in chunk.hashes:
            np.add.at(total, h[chunk.first[i] : chunk.last[i]], 1)
    return total


def _text_chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[list[str]]:
    waiting: list[str] = []
    held = 0
    for batch in batches:
        for t in batch.column("text").to_pylist():
            waiting.append(t)
            held += len(t) + 1
            if held >= size:
                yield waiting
                waiting, held = [], 0
    if waiting:
        yield waiting


def _as_rows(totals: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for which, total in enumerate(totals):
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), which, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["view", "bucket", "n"])


def holding(points: np.ndarray, hashes: list[np.ndarray], orders: tuple[int, ...]) -> np.ndarray:
    """For each bucket the stretches between zeros that hold it; an n-gram over a zero doesn't count."""
    total = np.zeros(BUCKETS, np.int64)
    lines = np.concatenate([[0], np.cumsum(points == 0)])
    for k, h in zip(orders, hashes, strict=True):
        whole = lines[k:] == lines[:-k]
        once = np.sort((lines[:-k][whole] << BITS) | h[whole])
        first = np.ones(len(once), bool)
        first[1:] = once[1:] != once[:-1]
        total += np.bincount(once[first] & (BUCKETS - 1), minlength=BUCKETS)
    return total


def _count_batches(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bucket the sentences of a partition that hold it, in both views, as the buckets that are not empty."""
        totals = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
        views = Views(given.value)
        for texts in _text_chunks(batches):
            points = codes(" \0 ".join(texts))
            for total, view, orders in zip(totals, (views.plain, views.shape), (ORDERS, SHAPE_ORDERS), strict=True):
                seen = view(points)[0]
                total += holding(seen, hashed(seen, orders), orders)
        yield from _as_rows(totals)

    return run


def _learn_batches(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models.of(given.value)
        totals = [np.zeros(BUCKETS, np.int64) for _ in KINDS]
        for texts in _text_chunks(batches):
            chunk = Chunk(models.views, texts)
            for total, kind in zip(totals, KINDS, strict=True):
                total += _counts_of(chunk, models.learnable(chunk, kind))
        yield from _as_rows(totals)

    return run


def _sentence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sentences of a partition, most repeats left out already."""
    held: set[int] = set()
    for batch in batches:
        out: list[str] = []
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            for sentence in SENTENCE_BREAK.split(text.encode("utf-8", "replace").translate(ZEROS).decode()):
                said = " ".join(sentence.split())
                key = hash(said)
                if said and key not in held:
                    held.add(key)
                    out.append(said)
        if len(held) > HELD_SENTENCES:
            held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])


def distinct_sentences(documents: DataFrame) -> DataFrame:
    """Column text: every sentence of the documents once, with ASCII digits as 0 and runs of white space as one space.

    Neither changes the n-grams of the views. Sentences meet by their own text, after each partition has dropped its
    repeats, so a sentence that stands in every row is no hot key.
    """
    return documents.select("text").mapInArrow(_sentence_batches, "text string").distinct()


def _summed(counted: DataFrame, tables: int) -> list[np.ndarray]:
    """Tables of ``BUCKETS`` numbers, whatever the input."""
    sums = counted.groupBy("view", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(BUCKETS, np.int64) for _ in range(tables)]
    view, bucket, n = (sums.column(c).to_numpy() for c in ("view", "bucket", "n"))
    for which, total in enumerate(out):
        total[bucket[view == which]] = n[view == which]
    return out


def fit(documents: DataFrame, rounds: int = ROUNDS):
    """(prose, prose shapes, what was learned per kind): counts over all distinct sentences, the models' whole state."""
    sc = documents.sparkSession.sparkContext
    # Read once per round, so written once; texts repeat, so it is smaller than the documents.
    sentences = materialize(distinct_sentences(documents), "sentences")
    schema = "view int, bucket int, n long"
    views = Views()
    prose, shapes = _summed(sentences.mapInArrow(_count_batches(sc.broadcast(views.tables())), schema), 2)
    learned: tuple[np.ndarray, ...] = ()
    for _ in range(rounds):
        given = sc.broadcast(Models(prose, shapes, learned, views).state())
        learned = tuple(_summed(sentences.mapInArrow(_learn_batches(given), schema), len(KINDS)))
    return prose, shapes, learned


SPANS = "array<struct<start:int,stop:int,kind:string,coverage:double>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("coverage", pa.float64())]))


def _detect(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models.of(given.value)
        for batch in batches:
            found = models.spans([t or "" for t in batch.column("text").to_pylist()])
            rows = [[dict(zip(("start", "stop", "kind", "coverage"), s, strict=True)) for s in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_chars"), pa.array(rows, ARROW_SPANS)], names=["id", "n_chars", "spans"])

    return run


def residue_spans(documents: DataFrame, *, item: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns item, spans, coverage: for every row the sentences with residue, with place, kind and the share covered by windows.

    ``kind`` is placeholder, filler or notice. ``coverage`` is the share of the text's characters that windows of residue
    cover. Null, blank and clean texts get an empty array and coverage 0; so does residue that is quoted or shown as
    code. Equal texts get equal spans. Texts are read whole; other columns aren't read.
    """
    rows = spread(documents.select(F.col(item).alias("id"), F.col(text).alias("text")))
    given = documents.sparkSession.sparkContext.broadcast(Models(*fit(rows)).state())
    found = rows.select("id", F.char_length("text").alias("n_chars"), "text").mapInArrow(_detect(given), f"id {rows.schema['id'].dataType.simpleString()}, n_chars int, spans {SPANS}")
    held = F.aggregate("spans", F.lit(0.0), lambda sum_, s: sum_ + (s["stop"] - s["start"]) * s["coverage"])
    return found.select(F.col("id").alias(item), "spans", F.round(F.coalesce(held / F.nullif("n_chars", F.lit(0)), F.lit(0.0)), 6).alias("coverage"))


def exclude_residue(spans: DataFrame, max_coverage: float = 0.0) -> DataFrame:
    """The rows whose residue covers at most ``max_coverage`` of their text; by default none is allowed at all."""
    return spans.where(F.col("coverage") <= max_coverage)
