"""Greedy removal of near-duplicate hashes in a given order."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.session import materialize


def sign_hash(vector: Column | str) -> Column:
    """The signs of the first 64 numbers as the bits of a long."""
    bits = F.transform(F.slice(F.col(vector) if isinstance(vector, str) else vector, 1, 64), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(bits, F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


#: Up to so many distinct hashes of a key, rows that may be near each other share this many bands.
SHARED_BANDS = ((2_000, 1), (200_000, 2), (None, 3))


def band_keys(hash_: str, threshold: int, shared: int) -> Column:
    """Two hashes within the threshold agree in at least ``shared`` of threshold + shared bands; one entry per choice of bands.

    More shared bands give longer keys, which fewer hashes have in common, and more entries for each hash.
    """
    bands = threshold + shared
    cuts = [64 * i // bands for i in range(bands + 1)]
    part = [F.shiftrightunsigned(hash_, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.struct(F.lit(1000 * shared + n).alias("band"), F.xxhash64(*[part[i] for i in chosen]).alias("part")) for n, chosen in enumerate(combinations(range(bands), shared))])


def near_pairs(nodes: DataFrame, threshold: int) -> DataFrame:
    """k, first, later: hashes of one key within the threshold, the one that comes first first. ``nodes`` has k, h, at."""
    sizes = nodes.groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("_n"))
    sized = nodes.join(sizes, F.col("k") == F.col("_k")).drop("_k")
    keys = F.lit(None)
    for most, shared in reversed(SHARED_BANDS):
        entries = band_keys("h", threshold, min(shared, 64 - threshold))
        keys = entries if most is None else F.when(F.col("_n") <= most, entries).otherwise(keys)
    filed = sized.select("k", "h", "at", F.inline(keys))
    a, b = filed.alias("a"), filed.alias("b")
    near = (F.col("a.k") == F.col("b.k")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.at") < F.col("b.at"))
    near = near & (F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))) <= threshold)
    return a.join(b, near).select(F.col("a.k").alias("k"), F.col("a.h").alias("first"), F.col("b.h").alias("later")).distinct()


def greedy_dedup(rows: DataFrame, *, key: str, order: list[str], item: str, hash_: str, threshold: int = 5) -> DataFrame:
    """key, item: what remains if each row is dropped that differs in at most ``threshold`` bits from an earlier kept one.

    Only hashes that share bands are compared, after equal ones were reduced to their first; keys with more hashes share
    longer ones. Then, round by round, a hash with a kept earlier neighbour is dropped, one whose earlier neighbours are
    all dropped is kept. There are as many rounds as the longest chain of neighbours has links. Rows with a null key, item
    or hash are dropped. ``order`` and ``item`` make the order total.
    """
    if not 0 <= threshold < 64:
        raise ValueError("the threshold must lie between 0 and 63")
    place = F.struct(*order, F.col(item).alias("_id"))
    base = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull() & F.col(hash_).isNotNull()).groupBy(F.col(key).alias("k"), F.col(hash_).alias("h")).agg(F.min(place).alias("at"))
    nodes = materialize(base, "hashes")
    pairs = materialize(near_pairs(nodes, threshold), "near")
    # Only hashes with an earlier neighbour have to wait; kept: null while that is open.
    waiting = pairs.select("k", F.col("later").alias("h")).distinct().withColumn("kept", F.lit(None).cast("boolean"))
    known = pairs.select("k", F.col("first").alias("h")).distinct().join(waiting, ["k", "h"], "left_anti").withColumn("kept", F.lit(True))
    state = materialize(waiting.unionByName(known), "state")
    while not state.where("kept is null").isEmpty():
        # The earliest open hash of each key is always decided, so this ends.
        open_ = state.where("kept is null").select("k", F.col("h").alias("later"))
        earlier = pairs.join(open_, ["k", "later"], "left_semi").join(state.withColumnRenamed("h", "first"), ["k", "first"])
        seen = earlier.groupBy("k", F.col("later").alias("h")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("_hit"), F.count_if(F.col("kept").isNull()).alias("_open"))
        decided = seen.select("k", "h", F.when(F.col("_hit"), F.lit(False)).when(F.col("_open") == 0, F.lit(True)).alias("kept"))
        state = materialize(state.where("kept is not null").unionByName(decided), "state")
    dropped = state.where("not kept").select("k", "h")
    return nodes.join(dropped, ["k", "h"], "left_anti").select(F.col("k").alias(key), F.col("at._id").alias(item))
