"""Pack items of varying length into containers of fixed capacity, over a hierarchy of window lengths.

Items are routed to tiers of context size: the shortest tier that holds them. From the longest tier down, the items of
a tier are packed into windows of the tier's own length (best fit, long items first), and the gaps these windows leave
are filled from the shorter tiers before those build windows themselves. Windows of a short tier that stay too empty, and
those that would leave a container incomplete, are opened again and their items packed into windows of the whole
capacity. A container holds one window of the capacity or as many of a shorter tier as go into it, and step groups hold
containers of one tier, dealt so that groups carry nearly equal loads.

Lengths are whole numbers up to the capacity, so the histogram of lengths says everything that packing needs, and its
size depends on the capacity alone: the plan is made on it. Items get their place by their rank among equal lengths.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.session import materialize

TIERS = (512, 1024, 2048, 4096)
LEAST_FILL = 0.98  # of a short tier's window, or it is opened again
BROADCAST_ROWS = 200_000  # of the plan
ROWS_PER_BUCKET = 100_000  # of equal lengths, ranked in one task


@dataclass(frozen=True, order=True)
class Run:
    """``count`` windows of ``size`` with the same contents: (length, items of it) in each, and ``room`` left."""

    room: int
    size: int
    contents: tuple[tuple[int, int], ...]
    count: int


class _Open:
    """Runs of windows of one size by their room, least first."""

    def __init__(self) -> None:
        self.runs: list[Run] = []

    def add(self, run: Run) -> None:
        if run.count:
            insort(self.runs, run)

    def best_fit(self, length: int) -> Run | None:
        """The run with the least room that takes an item, taken out."""
        i = bisect_left(self.runs, length, key=lambda r: r.room)
        return self.runs.pop(i) if i < len(self.runs) else None

    def place(self, length: int, left: int, window: int | None) -> int:
        """Put ``left`` items into the open windows, and into new ones of size ``window`` if given; how many found no place."""
        while left:
            run = self.best_fit(length)
            if run is None:
                if window is None:
                    return left
                run = Run(window, window, (), -(-left // (window // length)))
            each = run.room // length
            full = min(run.count, left // each)
            self.add(_with(run, length, each, full))
            left -= full * each
            rest = run.count - full
            if rest and 0 < left < each:
                self.add(_with(run, length, left, 1))
                left, rest = 0, rest - 1
            self.add(replace(run, count=rest))
        return 0


def _with(run: Run, length: int, each: int, count: int) -> Run:
    return Run(run.room - each * length, run.size, (*run.contents, (length, each)), count)


def tier_edges(capacity: int, tiers: tuple[int, ...]) -> list[int]:
    return sorted({t for t in tiers if 0 < t < capacity} | {capacity})


def plan_packing(counts: dict[int, int], capacity: int, tiers: tuple[int, ...] = TIERS, least_fill: float = LEAST_FILL) -> list[Run]:
    """Runs of windows that hold the items given per length, by size from long to short and by room."""
    left = {n: c for n, c in counts.items() if c}
    edges = tier_edges(capacity, tiers)
    packed: dict[int, list[Run]] = {}
    for low, high in reversed(list(zip([0, *edges], edges, strict=False))):
        windows = _Open()
        for length in sorted((n for n in left if low < n <= high), reverse=True):
            windows.place(length, left.pop(length), high)
        for length in sorted((n for n in left if n <= low), reverse=True):  # gaps of long windows, from shorter tiers
            left[length] = windows.place(length, left[length], None)
            if not left[length]:
                del left[length]
        packed[high] = windows.runs
    # Short windows that are too empty, or that don't make a whole container, are opened again.
    opened: dict[int, int] = {}
    for high in edges[:-1]:
        kept = [r for r in packed[high] if r.room <= (1 - least_fill) * high]
        odd = sum(r.count for r in kept) % (capacity // high)
        again = [r for r in packed[high] if r.room > (1 - least_fill) * high]
        for i in range(len(kept) - 1, -1, -1):  # the emptiest first
            n = min(odd, kept[i].count)
            odd -= n
            again.append(replace(kept[i], count=n))
            kept[i] = replace(kept[i], count=kept[i].count - n)
        packed[high] = [r for r in kept if r.count]
        for run in again:
            for length, each in run.contents:
                opened[length] = opened.get(length, 0) + each * run.count
    whole = _Open()
    whole.runs = packed[capacity]
    for length in sorted(opened, reverse=True):
        if opened[length]:
            whole.place(length, opened[length], capacity)
    return [r for high in reversed(edges) for r in sorted(packed[high])]


def placements(plan: list[Run], capacity: int, step_size: int) -> list[tuple[int, int, int, int, int, int, int, int, int, int, int]]:
    """Rows (length, first rank, items, items per window, first window, window size, window fill, windows per container,
    first window of the size, first container of the size, containers of the size), and so where each item goes."""
    ranks: dict[int, int] = {}
    per_size: dict[int, int] = {}
    for run in plan:
        per_size[run.size] = per_size.get(run.size, 0) + run.count
    starts, window, container = {}, 0, 0
    for size, n in sorted(per_size.items(), reverse=True):
        per = capacity // size
        boxes = -(-n // per)
        starts[size] = (per, window, container, boxes)
        window, container = window + n, container + boxes
    rows, at = [], 0
    for run in plan:
        for length, each in run.contents:
            rank = ranks.get(length, 0)
            rows.append((length, rank, each * run.count, each, at, run.size, run.size - run.room, *starts[run.size]))
            ranks[length] = rank + each * run.count
        at += run.count
    return rows


def ranked_in(df: DataFrame, key: str, unique: list[str], buckets: Column) -> DataFrame:
    """Add ``rank``, from 0 among the rows of equal ``key``, without gathering a key in one task.

    Rows are ranked inside hash buckets of their key, ``buckets`` of them; a bucket starts where the ones before it end.
    """
    salted = df.withColumn("_b", F.pmod(F.xxhash64(*unique), buckets).cast("int"))
    inside = salted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*unique)) - 1)
    sizes = salted.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before)
    joined = inside.join(starts, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn("rank", (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_r", "_k", "_c", "_n", "_before")


def token_pieces(documents: DataFrame, capacity: int) -> DataFrame:
    """Columns doc_id, piece, n_tokens, start_token: a document above the capacity is cut into full pieces and a rest.

    A token is one UTF-8 byte of the text (the ByT5 vocabulary without special tokens). Null and empty texts have no
    tokens and no pieces.
    """
    sized = documents.select("doc_id", F.octet_length("text").cast("long").alias("size")).where("doc_id is not null and size > 0")
    return sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / capacity).cast("int"))).alias("piece")).select(
        "doc_id",
        "piece",
        F.least(F.lit(capacity), F.col("size") - F.col("piece") * F.lit(capacity).cast("long")).cast("int").alias("n_tokens"),
        (F.col("piece") * F.lit(capacity).cast("long")).alias("start_token"),
    )


def pack(documents: DataFrame, capacity: int, *, step_size: int = 8, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Columns doc_id, piece, n_tokens, start_token, tier, window_size, window, window_fill, container, step_group.

    Every document with tokens is placed exactly once; only one above the capacity is split. ``tier`` is the context
    size its length routes it to, ``window_size`` that of the window it fills, ``window_fill`` the tokens of that window.
    A container holds ``capacity / window_size`` windows. Step groups hold ``step_size`` containers of one window size,
    dealt in turns by fill, back and forth. Equal lengths and equal texts are told apart by doc_id and piece, so a
    doc_id must be unique; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    # The texts are read once; packing works on these numbers.
    pieces = materialize(token_pieces(documents, capacity), "pieces")
    # At most `capacity` rows, whatever the input.
    counts = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}
    rows = placements(plan_packing(counts, capacity, tiers), capacity, step_size)
    # Its rows depend on the capacity alone: each length splits few runs. Beyond the bound Spark joins as it sees fit.
    hint = F.broadcast if len(rows) <= BROADCAST_ROWS else lambda df: df
    plan = spark.createDataFrame(
        rows or [(0,) * 11],
        "size int, from_rank long, items long, each long, first_window long, window_size int, window_fill int, per int, size_window long, size_container long, size_containers long",
    )
    many = spark.createDataFrame([(n, -(-c // ROWS_PER_BUCKET)) for n, c in counts.items() if c > ROWS_PER_BUCKET] or [(0, 1)], "many int, buckets int")
    split = pieces.join(F.broadcast(many), F.col("n_tokens") == F.col("many"), "left").withColumn("buckets", F.coalesce("buckets", F.lit(1))).drop("many")
    ranked = ranked_in(split, "n_tokens", ["doc_id", "piece"], F.col("buckets"))
    in_range = (F.col("n_tokens") == F.col("size")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("items"))
    placed = ranked.join(hint(plan), in_range).withColumn("window", F.col("first_window") + F.expr("(rank - from_rank) div each"))
    placed = placed.withColumn("nth", F.expr("(window - size_window) div per")).withColumn("groups", F.greatest(F.lit(1), F.expr(f"(size_containers + {step_size - 1}) div {step_size}")))
    tier = F.coalesce(*[F.when(F.col("n_tokens") <= t, F.lit(t)) for t in tier_edges(capacity, tiers)])
    turn = F.col("nth") % F.col("groups")
    group = F.when(F.expr("nth div groups") % 2 == 0, turn).otherwise(F.col("groups") - 1 - turn)
    return placed.select(
        "doc_id",
        "piece",
        "n_tokens",
        "start_token",
        tier.alias("tier"),
        "window_size",
        "window",
        "window_fill",
        (F.col("size_container") + F.col("nth")).alias("container"),
        F.concat_ws("-", F.col("window_size").cast("string"), group.cast("string")).alias("step_group"),
    )


def container_limit(size_limits: DataFrame) -> int:
    row = size_limits.where("limit_name = 'container'").select("max_size").first()
    if row is None:
        raise ValueError("size_limits has no container")
    return row[0]


def split_documents(packed: DataFrame) -> DataFrame:
    """Column doc_id: the documents whose pieces lie in more than one container."""
    spans = packed.groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return spans.where("first < last").select("doc_id")


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """A row per window size: containers, pieces, tokens, room left, share used, pieces filled in from shorter tiers, lightest and heaviest step group."""
    boxes = packed.groupBy("window_size", "step_group", "container").agg(
        F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.count_if(F.col("tier") < F.col("window_size")).alias("from_shorter")
    )
    groups = boxes.groupBy("window_size", "step_group").agg(
        F.count("*").alias("boxes"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.max("t").alias("most"), F.sum("from_shorter").alias("from_shorter")
    )
    return groups.groupBy("window_size").agg(
        F.sum("boxes").alias("containers"),
        F.sum("n").alias("pieces"),
        F.sum("from_shorter").alias("filled_in"),
        F.sum("t").alias("tokens"),
        F.max("most").alias("fullest"),
        (F.sum("boxes") * capacity - F.sum("t")).alias("room_left"),
        F.round(F.sum("t") / (F.sum("boxes") * capacity), 6).alias("share_used"),
        F.min("t").alias("lightest_group"),
        F.max("t").alias("heaviest_group"),
    )
