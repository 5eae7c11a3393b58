"""Collapse runs of equal or nearly equal consecutive events by optimal segmentation.

A segmentation of an entity's ordered events costs, per run, a boundary penalty, the dissimilarity of its neighbours and,
weighted by ``centre_weight``, the dissimilarity of its events to the run's centre (the member nearest to all of them).
Two neighbours whose second event does not continue the first can't share a run. A dynamic program over the positions
finds the cheapest segmentation. Run starts that cannot win any more are pruned: one that costs at least as much as a
fresh start here never catches up, as a run never costs less than its two parts (exact, not a heuristic).

With ``centre_weight`` 0 only neighbours count; a step of one word costs less than a boundary, so runs are the longest
stretches of events that continue each other. With a weight, a stretch that drifts away word by word is cut where that
is cheapest.

The events are sorted by range over the whole table, so a hot entity spreads over many tasks. Stretches that lie inside a
partition are segmented there; the first and the last stretch of each partition, as blocks of equal events (without centres
as one block each), are segmented afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reelspark.llm.nearest import to_ms
from reelspark.session import materialize

BOUNDARY_PENALTY = 1.0
NEAR_COST = 0.5
MIN_WORDS = 4
WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str) -> tuple[str, ...]:
    return tuple(WORD.findall(text.lower()))


def one_edit(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether inserting, deleting or replacing one word makes the lists equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def step_cost(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Dissimilarity of neighbours; infinite where the second doesn't continue the first."""
    if a == b:
        return 0.0
    return NEAR_COST if len(a) >= MIN_WORDS and len(b) >= MIN_WORDS and one_edit(a, b) else math.inf


def dissimilarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Word edits between two lists, as a share of the longer one."""
    if a == b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] / max(len(a), len(b), 1)


@dataclass
class _Start:
    """A run that may begin at a position: what it costs up to now."""

    at: int
    before: float
    steps: float = 0.0
    members: dict[tuple[str, ...], int] = field(default_factory=dict)
    centres: dict[tuple[str, ...], float] = field(default_factory=dict)  # cost of the run around each member

    def take(self, event: tuple[str, ...], n: int, step: float, weight: float) -> None:
        self.steps += step
        if not weight:
            return
        for c in self.centres:
            self.centres[c] += n * dissimilarity(c, event)
        if event not in self.centres:
            self.centres[event] = sum(k * dissimilarity(event, m) for m, k in self.members.items())
        self.members[event] = self.members.get(event, 0) + n

    def cost(self, weight: float) -> float:
        return self.before + self.steps + (weight * min(self.centres.values()) if weight else 0.0)


class Segmenter:
    """Pruned dynamic programming over one stretch of events that continue each other; feed them, then read the runs."""

    def __init__(self, centre_weight: float = 0.0, penalty: float = BOUNDARY_PENALTY) -> None:
        self.weight, self.penalty = centre_weight, penalty
        self.best = 0.0  # cost of the best segmentation of all events so far
        self.back: list[int] = []  # where the last run of that segmentation begins, by position
        self.open: list[_Start] = []

    def add(self, event: tuple[str, ...], n: int = 1, step: float = 0.0) -> None:
        """Take ``n`` equal events, ``step`` away from the last one."""
        self.open.append(_Start(len(self.back), self.best + self.penalty))
        for s in self.open:
            s.take(event, n, step if s.at < len(self.back) else 0.0, self.weight)
        first = min(self.open, key=lambda s: (s.cost(self.weight), s.at))
        self.best = first.cost(self.weight)
        self.back.append(first.at)
        if not self.weight:
            self.open = [first]  # what follows costs every open run the same
        else:
            self.open = [s for s in self.open if s.cost(self.weight) < self.best + self.penalty]

    def runs(self) -> list[tuple[int, int]]:
        """[from, to) of each run, in order."""
        out, end = [], len(self.back)
        while end:
            out.append((self.back[end - 1], end))
            end = self.back[end - 1]
        return out[::-1]


@dataclass
class Block:
    """Consecutive equal events, or a run: ids, count, times, first and last words."""

    entity: object
    first_id: object
    last_id: object
    n: int
    start_ms: int
    until_ms: int
    end_ms: int
    head: tuple[str, ...]
    tail: tuple[str, ...]

    def absorb(self, other: Block) -> None:
        """Go on with what follows."""
        self.last_id, self.end_ms, self.tail = other.last_id, other.end_ms, other.tail
        self.n += other.n
        self.until_ms = max(self.until_ms, other.until_ms)


class Stretch:
    """Blocks that continue each other."""

    def __init__(self, centre_weight: float) -> None:
        self.weight = centre_weight
        self.segmenter = Segmenter(centre_weight)
        self.blocks: list[Block] = []
        self.steps: list[float] = []

    def add(self, block: Block, step: float) -> None:
        if self.blocks and self.blocks[-1].tail == block.head:
            self.blocks[-1].absorb(block)  # between equal events a cut is never needed
            return
        if not self.weight:
            # One start is open at a time; while it stays the same, all since then is one run.
            self.segmenter.add(block.head, block.n, step)
            if self.segmenter.back[-1] < len(self.segmenter.back) - 1:
                self.segmenter.back.pop()
                self.blocks[-1].absorb(block)
                return
        self.blocks.append(block)
        self.steps.append(step)

    def runs(self) -> list[Block]:
        if not self.weight:
            return self.blocks
        for b, step in zip(self.blocks, self.steps, strict=True):
            self.segmenter.add(b.head, b.n, step)
        out = []
        for i, j in self.segmenter.runs():
            for b in self.blocks[i + 1 : j]:
                self.blocks[i].absorb(b)
            out.append(self.blocks[i])
        return out


def _schema(entity: T.DataType, event: T.DataType) -> T.StructType:
    fields = [("part", T.IntegerType()), ("nth", T.LongType()), ("edge", T.IntegerType()), ("entity", entity), ("first_id", event), ("last_id", event), ("n", T.LongType())]
    fields += [(c, T.LongType()) for c in ("start_ms", "until_ms", "end_ms")] + [(c, T.ArrayType(T.StringType())) for c in ("head", "tail")]
    return T.StructType([T.StructField(*f) for f in fields])


def _rows(blocks: list[Block], part: int, nth: int, edge: int | None) -> list[dict]:
    """Words are only needed where a stretch may go on in another partition."""
    keep = edge is not None
    return [{**vars(b), "part": part, "nth": nth + i, "edge": edge, "head": list(b.head) if keep else None, "tail": list(b.tail) if keep else None} for i, b in enumerate(blocks)]


def _step(before: Block, after: Block, gap_ms: int) -> float:
    return step_cost(before.tail, after.head) if before.entity == after.entity and after.start_ms - before.end_ms <= gap_ms else math.inf


def _segment(gap_ms: int, centre_weight: float, min_events: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        stretch, last, stretches, nth = Stretch(centre_weight), None, 0, 0
        text_before, words_before = None, ()
        for batch in batches:
            cols = batch.to_pydict()
            for entity, at, key, end, text in zip(cols["entity"], cols["at"], cols["id"], cols["end"], cols["text"], strict=True):
                if last is not None and last.entity == entity and last.last_id == key:
                    continue  # delivered again
                if text != text_before:
                    text_before, words_before = text, words(text)
                event = Block(entity, key, key, 1, at, end, end, words_before, words_before)
                step = math.inf if last is None else _step(last, event, gap_ms)
                if step == math.inf and stretch.blocks:
                    # The first stretch may go on from the partition before.
                    rows = _rows(stretch.blocks, part, nth, 0) if not stretches else _rows([b for b in stretch.runs() if b.n >= min_events], part, nth, None)
                    out += rows
                    nth += len(rows)
                    stretch, stretches = Stretch(centre_weight), stretches + 1
                stretch.add(event, 0.0 if step == math.inf else step)
                last = event
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if stretch.blocks:
            out += _rows(stretch.blocks, part, nth, 1 if stretches else 0)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _join_up(gap_ms: int, centre_weight: float, schema: pa.Schema):
    """The blocks of the edge stretches of all partitions, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, last, place = Stretch(centre_weight), None, None
        out: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(*(r[c] for c in ("entity", "first_id", "last_id", "n", "start_ms", "until_ms", "end_ms")), tuple(r["head"]), tuple(r["tail"]))
                here = (r["part"], r["edge"])
                parted = last is None or (place[0] == here[0] and place[1] != here[1])
                step = math.inf if parted else _step(last, block, gap_ms)
                if step == math.inf and stretch.blocks:
                    out += _rows(stretch.runs(), 0, 0, None)
                    stretch = Stretch(centre_weight)
                stretch.add(block, 0.0 if step == math.inf else step)
                last, place = block, here
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        out += _rows(stretch.runs(), 0, 0, None)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def collapse_runs(
    events: DataFrame, *, entity: str = "video_id", event: str = "cue_id", start: str = "start_s", end: str = "end_s", text: str = "text", gap_s: float = 5.0, centre_weight: float = 0.0, min_events: int = 2
) -> DataFrame:
    """Columns entity, first_cue_id, last_cue_id, n_cues, start_s, end_s, duration_s: one row per run of ``min_events`` or more.

    Events without an entity, an id, a start (null or NaN) or a letter or digit in the text are left out. The rest of
    an entity is ordered by start, then id. An event continues the one before it if it starts at most ``gap_s`` after
    that one's end (its start, where the end is null or earlier) and the word lists are equal, or both have four words
    or more and one inserted, deleted or replaced word makes them equal; runs are cut as the module says. Events
    delivered again count once. Ids may be of any type that orders. Ties, empty tables and further columns are fine.
    """
    gap_ms = round(gap_s * 1000)
    at, until = to_ms(F.col(start)), to_ms(F.col(end))
    ordered = (
        events.select(F.col(entity).alias("entity"), at.alias("at"), F.col(event).alias("id"), F.greatest(at, until).alias("end"), F.col(text).alias("text"))
        .where("entity is not null and id is not null and at is not null")
        .where(F.col("text").rlike(r"[\p{L}\p{N}]"))
        .repartitionByRange("entity", "at", "id")
        .sortWithinPartitions("entity", "at", "id")
    )
    schema = _schema(ordered.schema["entity"].dataType, ordered.schema["id"].dataType)
    arrow = to_arrow_schema(schema)
    runs = materialize(ordered.mapInArrow(_segment(gap_ms, centre_weight, min_events, arrow), schema), "runs")
    # Two stretches per partition, whatever the input; without centres each is one row.
    edges = runs.where("edge is not null").repartition(1).sortWithinPartitions("part", "nth")
    whole = runs.where("edge is null").unionByName(edges.mapInArrow(_join_up(gap_ms, centre_weight, arrow), schema)).where(F.col("n") >= min_events)
    return whole.select(
        F.col("entity").alias(entity),
        F.col("first_id").alias("first_cue_id"),
        F.col("last_id").alias("last_cue_id"),
        F.col("n").alias("n_cues"),
        (F.col("start_ms") / 1000).alias("start_s"),
        (F.col("until_ms") / 1000).alias("end_s"),
        ((F.col("until_ms") - F.col("start_ms")) / 1000).alias("duration_s"),
    )
