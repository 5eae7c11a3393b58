"""Languages of texts and of the stretches of mixed texts, with a confidence.

Words known from labelled rows are scored by their log frequency in each language; an unseen word falls back to its
character n-grams, the longest ones that are known, down to single characters. Sentences are scored as a whole; inside
a sentence a Viterbi pass finds longer stretches of another language, so that loan words and names don't count as one.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_PER_LANGUAGE`` rows of at most ``SAMPLE_CHARS``
characters for each language); labels may be wrong: sentences are relabelled by the model and it is fitted again.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import collapse_ws
from reelspark.session import spread

SAMPLE_PER_LANGUAGE = 2000
SAMPLE_CHARS = 1500
MAX_ORDER = 4
HELD_WORDS = 200_000  # distinct unseen words whose scores a worker remembers
TOGETHER = 256  # texts scored together
WORD_CLIP = 4.0  # the most that one word can say against a language
UNSEEN_CLIP = 1.2
SWITCH = 9.0  # cost of changing the language inside a sentence
STRETCH_GAIN = 13.0
STRETCH_WORDS = 4
STRETCH_CHARS = 8  # of scripts without spaces
SHORT_MARGIN = 2.5  # of each word of a sentence of two words; a single word needs another script and WORD_CLIP

WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
#: Links, mail addresses, code spans, paths, names joined by signs and stuttered syllables: no text in any language.
NO_TEXT = re.compile(
    r"\b\w+://\S+|\bwww\.\S+|\S+@\S+\.\S+|(?<!\S)(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9+/=_.&?:#%~-]{12,}|(?<!\S)\S*[A-Za-z0-9][_/\\]\S*[A-Za-z0-9]\S*"
)
CODE = re.compile(r"`[^`]*`")
STUTTER = re.compile(r"(?<!\S)(?=\S{5})(\S{1,4}?)\1{4,}\S*")
#: The tokens that may hold what NO_TEXT looks for.
MAY_BE_NO_TEXT = re.compile(r"(?<!\S)\S*?[@/\\_]\S*|(?<!\S)(?=\S{12})\S*?\d\S*|\bwww\.\S+")
SENTENCE = regex.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』）\"”»)]*| (?:[/|–—]|-{1,2}) ")
END_MARKS = frozenset(".!?…。！？")
CLOSERS = "\"'”’»」』)]"
LATIN = regex.compile(r"\p{Latin}")
DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def squeeze(text: str) -> str:
    """Each run of white space as one space, the ends trimmed."""
    return " ".join(text.split())


def sentences(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def blank_no_text(text: str) -> str:
    """The text with spaces for what is no text in any language; places stay."""
    if "`" in text:
        text = CODE.sub(_spaces, text)
    text = MAY_BE_NO_TEXT.sub(lambda m: NO_TEXT.sub(_spaces, m.group()), text)
    return STUTTER.sub(_spaces, text)


def _spaces(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def grams(word: str) -> list[str]:
    """For each place of the padded word, the longest n-gram that starts there."""
    padded = f"^{word}$"
    return [padded[i : i + MAX_ORDER] for i in range(len(padded) - 1)]


def _is_closed(sentence: str) -> bool:
    """Whether it ends with an end mark, closing quotes and brackets aside."""
    return sentence.rstrip().rstrip(CLOSERS)[-1:] in END_MARKS


class Scorer:
    """Scores of words as vectors over the languages, relative to their best language (0 for it, negative for others)."""

    def __init__(self, langs: list[str], words: tuple[dict[str, int], np.ndarray], chars: tuple[dict[str, int], np.ndarray]) -> None:
        self.langs = langs
        self.k = len(langs)
        self.word, self.word_scores = words
        self.gram, self.gram_scores = chars
        self.forget()

    def forget(self) -> None:
        """Drop the scores of unseen words."""
        self.rows = dict(self.word)
        self.matrix = np.zeros((max(1024, 2 * len(self.rows)), self.k))
        self.matrix[: len(self.rows)] = self.word_scores

    def row(self, word: str) -> int:
        """Where the scores of a word stand in ``matrix``; every distinct word is scored once."""
        got = self.rows.get(word)
        if got is None:
            got = self.rows[word] = len(self.rows)
            if got == len(self.matrix):
                self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[got] = self._unseen(word)
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        rows = list(map(self.rows.get, words))
        if None in rows:
            for w in {w for w, r in zip(words, rows, strict=True) if r is None}:
                self.row(w)
            rows = list(map(self.rows.get, words))
        return self.matrix[rows]

    def _unseen(self, word: str) -> np.ndarray:
        total = np.zeros(self.k)
        for g in grams(word):
            while g:
                hit = self.gram.get(g)
                if hit is not None:
                    total += self.gram_scores[hit]
                    break
                g = g[:-1]
        total -= total.max()
        clip = WORD_CLIP * max(1, len(word) / 3) if DENSE.search(word) else UNSEEN_CLIP if word.isascii() else WORD_CLIP
        return np.maximum(total, -clip)


def _relative(counts: np.ndarray, totals: np.ndarray, alpha: float, clip: float) -> np.ndarray:
    p = np.log((counts + alpha) / (totals + alpha * 1000))
    return np.maximum(p - p.max(axis=1, keepdims=True), -clip)


class Vocabulary:
    """The words of the sample and all their n-grams, indexed once; only the counts change from round to round."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.gram: dict[str, int] = {}
        owners, members = [], []
        for i, w in enumerate(words):
            for g in grams(w):
                for order in range(1, len(g) + 1):
                    owners.append(i)
                    members.append(self.gram.setdefault(g[:order], len(self.gram)))
        self.owners, self.members = np.array(owners, np.int64), np.array(members, np.int64)
        self.length = np.array([len(g) for g in self.gram], np.int64)
        # A run of a script without spaces is no word: it is always read by its n-grams.
        self.spaced = np.array([DENSE.search(w) is None for w in words], bool)

    def tables(self, counts: np.ndarray) -> tuple[tuple[dict[str, int], np.ndarray], tuple[dict[str, int], np.ndarray]]:
        """Index and scores of the known words, and of the character n-grams of all words, from counts by word and language."""
        k = counts.shape[1]
        by_gram = np.stack([np.bincount(self.members, counts[self.owners, lang], len(self.gram)) for lang in range(k)], axis=1)
        known, common = np.flatnonzero((counts.sum(axis=1) > 1) & self.spaced), np.flatnonzero(by_gram.sum(axis=1) > 1)
        n = np.maximum(1.0, counts.sum(axis=0))
        totals = np.ones((MAX_ORDER + 1, k))
        np.add.at(totals, self.length[common], by_gram[common])
        names = list(self.gram)
        return (
            ({self.words[i]: row for row, i in enumerate(known.tolist())}, _relative(counts[known], n, 0.05, WORD_CLIP) if len(known) else np.zeros((0, k))),
            ({names[i]: row for row, i in enumerate(common.tolist())}, _relative(by_gram[common], totals[self.length[common]], 0.5, 3.0) if len(common) else np.zeros((0, k))),
        )


def fit(samples: list[tuple[str, str]], langs: list[str], rounds: int = 3):
    """The score tables from (text, language) pairs, some of which are wrong."""
    k = len(langs)
    at = {lang: i for i, lang in enumerate(langs)}
    index: dict[str, int] = {}
    tokens: list[int] = []
    bounds: list[int] = []
    given: list[int] = []
    for text, lang in samples:
        clean = blank_no_text(text)
        for a, b in sentences(clean):
            found = [w.lower() for w in WORD.findall(clean[a:b])]
            if found:
                bounds.append(len(tokens))
                given.append(at[lang])
                tokens += [index.setdefault(w, len(index)) for w in found]
    vocabulary = Vocabulary(list(index))
    words, labels = np.array(tokens, np.int64), np.array(given, np.int64)
    lengths = np.diff([*bounds, len(tokens)])
    tables = vocabulary.tables(np.zeros((len(index), k))) if not tokens else None
    for turn in range(rounds if tokens else 0):
        if turn:
            totals = np.add.reduceat(Scorer(langs, *tables).scores(vocabulary.words)[words], bounds, axis=0)
            best, rows = totals.argmax(axis=1), np.arange(len(totals))
            # Doubtful sentences keep their label.
            labels = np.where(totals[rows, best] - totals[rows, labels] > 3, best, labels)
        counts = np.bincount(words * k + np.repeat(labels, lengths), minlength=len(index) * k).reshape(-1, k).astype(float)
        tables = vocabulary.tables(counts)
    return tables


def _viterbi(scores: np.ndarray, switch: float) -> list[int]:
    n, k = scores.shape
    back = np.zeros((n, k), int)
    best = scores[0].copy()
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - switch) + scores[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1]


def stretches(scorer: Scorer, text: str) -> list[tuple[int, int, int, float]]:
    """(start, end, language, confidence) of the stretches of a text, neighbours of one language united."""
    return stretches_of(scorer, [text])[0]


def stretches_of(scorer: Scorer, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """The stretches of many texts, whose words are scored together."""
    if len(scorer.rows) > len(scorer.word) + HELD_WORDS:
        scorer.forget()
    starts: list[int] = []
    ends: list[int] = []
    words: list[str] = []
    bounds: list[int] = []  # where each sentence with words begins among the words
    whole: list[bool] = []  # which of them stand between sentence ends, not between dashes or strokes
    firsts: list[int] = []  # where each text begins among the sentences
    dense: list[int] = []  # how many signs of scripts without spaces each word has
    for text in texts:
        firsts.append(len(bounds))
        blank = blank_no_text(text)
        low = blank.lower()
        # Few letters change their length with their case; only then every word is lowered on its own.
        found = list(WORD.finditer(low if len(low) == len(blank) else blank))
        if not found:
            continue
        first = len(words)
        places = [m.start() for m in found]
        starts += places
        ends += [m.end() for m in found]
        words += [m.group() for m in found] if len(low) == len(blank) else [m.group().lower() for m in found]
        dense += [len(DENSE.findall(w)) for w in words[first:]] if DENSE.search(blank) else [0] * len(found)
        closed, at, n = True, 0, len(places)
        for a, b in sentences(blank):
            before, closed = closed, _is_closed(blank[a:b])
            upto = n if b >= len(blank) else bisect_left(places, b, at)
            if upto > at:
                bounds.append(first + at)
                whole.append(before and closed)
                at = upto
    firsts.append(len(bounds))
    if not words:
        return [[] for _ in texts]
    # All sentences at once: their totals, and how much the words that are for another language could gain at most.
    scores = scorer.scores(words)
    totals = np.add.reduceat(scores, bounds, axis=0)
    leads = totals.argmax(axis=1)
    counts = np.diff([*bounds, len(words)])
    gain = scores - scores[np.arange(len(words)), np.repeat(leads, counts)][:, None]
    possible = np.add.reduceat(np.maximum(gain, 0), bounds, axis=0).max(axis=1)
    margins = totals.max(axis=1) - np.partition(totals, -2, axis=1)[:, -2] if scorer.k > 1 else np.full(len(totals), 9.0)
    mixed = (possible > STRETCH_GAIN) & (counts > STRETCH_WORDS)
    lead, n_words, plain, margin = leads.tolist(), counts.tolist(), (~mixed).tolist(), margins.tolist()
    out = []
    for i, j in zip(firsts, firsts[1:], strict=False):
        if i == j:
            out.append([])
            continue
        if lead[i:j].count(lead[i]) == j - i and all(plain[i:j]):  # every sentence is in one language, and all in the same
            first, last = bounds[i], bounds[j - 1] + n_words[j - 1]
            size = last - first + _thirds(dense[first:last])
            out.append([(starts[first], ends[last - 1], lead[i], _confidence(sum(margin[i:j]), size))])
            continue
        parts: list[list] = []  # start, end, lang, margin, words, whether it may stand in another language than the text
        for s in range(i, j):
            first, n = bounds[s], n_words[s]
            for x, y, lang in [(first, first + n, lead[s])] if plain[s] else _parts(scores, gain, first, n, lead[s], dense):
                some = scores[x:y].sum(axis=0)
                best = some[lang]
                some[lang] = -math.inf
                ahead = float(best - some.max()) if scorer.k > 1 else 9.0
                size = y - x + _thirds(dense[x:y])
                if size >= 3:
                    alone = ahead >= 5.0
                elif whole[s] and not any(LATIN.search(w) for w in words[x:y]):
                    alone = ahead >= WORD_CLIP
                else:
                    alone = whole[s] and size == 2 and ahead >= SHORT_MARGIN * size
                parts.append([starts[x], ends[y - 1], lang, ahead, size, alone])
        out.append(_united(parts, scorer.k))
    return out


def _thirds(dense: list[int]) -> int:
    """Three signs of a script without spaces count as a further word."""
    return sum(n // 3 for n in dense) if any(dense) else 0


def _parts(scores: np.ndarray, gain: np.ndarray, first: int, n: int, lead: int, dense: list[int]) -> list[tuple[int, int, int]]:
    """The stretches of a sentence that may be mixed, as (first word, behind the last word, language)."""
    sums = np.vstack([np.zeros(scores.shape[1]), gain[first : first + n].cumsum(axis=0)])
    if (sums - np.minimum.accumulate(sums, axis=0)).max() <= STRETCH_GAIN:
        return [(first, first + n, lead)]
    path = _viterbi(scores[first : first + n], SWITCH)
    cuts = [0, *[i for i in range(1, n) if path[i] != path[i - 1]], n]
    found = [(first + i, first + j, path[i]) for i, j in zip(cuts, cuts[1:], strict=False)]
    long = [p for p in found if p[1] - p[0] >= STRETCH_WORDS or sum(dense[p[0] : p[1]]) >= STRETCH_CHARS]
    return long or [(first, first + n, lead)]


def _united(parts: list[list], k: int) -> list[tuple[int, int, int, float]]:
    # Sentences too undecided for their length to stand on their own go with the language of the text.
    weight = np.zeros(k)
    for _, _, lang, margin, _, _ in parts:
        weight[lang] += max(margin, 0.01)
    main = int(weight.argmax())
    united: list[list] = []
    for *s, certain in parts:
        if s[2] != main and not certain:
            s[2], s[3] = main, 0.1
        if united and united[-1][2] == s[2]:
            united[-1][1] = s[1]
            united[-1][3] += s[3]
            united[-1][4] += s[4]
        else:
            united.append(s)
    return [(a, b, lang, _confidence(margin, size)) for a, b, lang, margin, size in united]


def _confidence(margin: float, size: int) -> float:
    return round(1 / (1 + math.exp(-min(30.0, 3 * margin / math.sqrt(max(size, 1))))), 4)


SEGMENTS = "array<struct<start:int,stop:int,lang:string,confidence:double>>"
ARROW_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def _segmenter(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, chars = model.value
        scorer = Scorer(langs, words, chars)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [f for i in range(0, len(texts), TOGETHER) for f in stretches_of(scorer, [squeeze(t) if t else "" for t in texts[i : i + TOGETHER]])]
            rows = [[{"start": a, "stop": b, "lang": langs[k], "confidence": c} for a, b, k, c in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(rows, ARROW_SEGMENTS)], names=["id", "label", "segments"])

    return run


def labelled(items: DataFrame, labels: DataFrame, item: str, text: str, lang: str) -> DataFrame:
    """id, text, and the language its label names (null: missing or not listed)."""
    # The labels of the languages are a fixed list; Spark broadcasts it as long as it is small.
    known = labels.select(F.lower(F.trim("label")).alias("known"), F.col("lang").alias("label")).where("known is not null").dropDuplicates(["known"])
    rows = spread(items.select(F.col(item).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))).select("id", "text", F.lower(collapse_ws("lang")).alias("given"))
    return rows.join(known, F.col("given") == F.col("known"), "left").select("id", "text", "label")


def sample_labelled(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """About ``per_language`` labelled rows of each language, at most 1.5 times as many, chosen by a hash of the id."""
    fit_for = rows.where(F.col("label").isNotNull() & F.char_length("text").between(20, chars))
    counts = {r[0]: r[1] for r in fit_for.groupBy("label").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(per_language / n))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) / 1_000_003.0
    # The share gives about as many; the order by the same hash makes the bound an exact one, and the same each time.
    picked = fit_for.withColumn("draw", draw).where(F.col("draw") < share[F.col("label")]).orderBy("draw", "id", "text").select("text", "label").limit(int(1.5 * per_language * len(counts)))
    return sorted((squeeze(r[0]), r[1]) for r in picked.collect())


def language_segments(items: DataFrame, labels: DataFrame, *, item: str, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Columns item, label, segments: per row its stretches of one language each, in order, with start, stop and confidence.

    ``label`` is the language the given label names, null where it is missing or not in ``labels``. Offsets count code
    points of the text with collapsed white space. Null, blank and letterless texts get no segments. Without any
    labelled row there is no model, and no segments. Texts are read whole; other columns aren't read.
    """
    rows = labelled(items, labels, item, text, lang)
    samples = sample_labelled(rows, per_language)
    langs = sorted({x for _, x in samples})
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label string, segments {SEGMENTS}"
    if not langs:
        return rows.select(F.col("id").alias(item), "label", F.array().cast(SEGMENTS).alias("segments"))
    model = items.sparkSession.sparkContext.broadcast((langs, *fit(samples, langs)))
    return rows.select("id", "label", "text").mapInArrow(_segmenter(model), schema).withColumnRenamed("id", item)


def language_cases(segmented: DataFrame, item: str) -> DataFrame:
    """Columns item, lang: each language of the rows whose label is missing or wrong or that hold more than one."""
    langs = F.array_distinct(F.col("segments.lang"))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | (F.get("langs", F.lit(0)) != F.col("label"))
    return segmented.withColumn("langs", langs).where((F.size("langs") > 0) & wrong).select(item, F.explode("langs").alias("lang"))
