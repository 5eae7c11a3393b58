"""Mix sources to target shares of the total size.

A source gives complete epochs first; the rest of its budget is a weighted sample without replacement after Efraimidis
and Spirakis: each document draws an exponential key divided by its quality weight, and documents are taken in the
order of their keys until the sum of their tokens is as near to the budget as that order allows. The sums are made over
ranges of the key first; only documents of the range where a budget ends are ordered against each other. Ranges are cut
around the median key of each source, so that they hold about equal numbers whatever the weights of its documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.session import materialize

KEY_RANGES = 4096


def tokens(text: str = "text") -> Column:
    """Tokens of the ByT5 vocabulary: one per UTF-8 byte."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Between 0.05 and 1: the share of letters among the characters, less for texts of under 200 characters."""
    n = F.char_length(text)
    letters = F.char_length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), letters / F.greatest(n, F.lit(1)) * 1.25) * F.least(F.lit(1.0), F.lit(0.25) + n / 266.0))


def source_name(source: str = "source") -> Column:
    return F.lower(F.trim(source))


def keyed_documents(documents: DataFrame, seed: int) -> DataFrame:
    """source, doc_id, n_tokens, key of all documents with tokens: the texts are read once, all else works on these numbers."""
    bits = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    uniform = (bits + F.lit(1)).cast("double") / F.lit(float((1 << 52) + 1))
    rows = documents.select(source_name().alias("source"), "doc_id", tokens().alias("n_tokens"), (-F.log(uniform) / quality_weight()).alias("key")).where("n_tokens > 0")
    return materialize(rows, "keyed")


def source_budgets(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source_name, target_permille, max_repeats, source_tokens, drawn_tokens, total_tokens, budget, epochs, rest, reachable.

    Sources are compared trimmed and in lower case. ``budget`` = share of the tokens of all documents, null sources
    too. ``drawn_tokens`` are those of documents with an id, the only ones that can be drawn: ``epochs`` complete passes
    over them come first, at most ``max_repeats``; ``rest``, less than one pass, is what a fractional pass may add. A
    target with a null name, or a source without documents, has no tokens and can't reach a share above zero.
    """
    sums = keyed.groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("source_tokens"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n_tokens"))).alias("drawn_tokens"))
    total = keyed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()[0]
    t = targets.select("source_name", "target_permille", "max_repeats")
    own = t.join(sums.where("s is not null"), source_name("source_name") == F.col("s"), "left").drop("s")
    own = own.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("source_tokens", "drawn_tokens")})
    share = F.coalesce("target_permille", F.lit(0)).cast("decimal(38,0)") * F.lit(total).cast("decimal(20,0)")
    cap = F.coalesce("max_repeats", F.lit(0)).cast("long")
    epochs = F.when(F.col("drawn_tokens") > 0, F.least(cap, F.expr("budget div drawn_tokens"))).otherwise(0).cast("long")
    return (
        own.withColumn("total_tokens", F.lit(total).cast("long"))
        .withColumn("budget", F.floor(share / 1000).cast("long"))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.when(F.col("epochs") < cap, F.col("budget") - F.col("epochs") * F.col("drawn_tokens")).otherwise(0).cast("long"))
        .withColumn("reachable", share <= 1000 * cap.cast("decimal(20,0)") * F.col("source_tokens").cast("decimal(20,0)"))
    )


def key_range(key: Column, median: Column, ranges: int = KEY_RANGES) -> Column:
    """Which of the ranges a key lies in. It grows with the key, and its steps stretch with the median, as the keys do."""
    return F.floor(F.lit(ranges) * key / (key + median)).cast("int")


def _mix(keyed: DataFrame, budgets: DataFrame) -> DataFrame:
    # One row per target; Spark broadcasts them while they are few.
    plan = budgets.where("drawn_tokens > 0 and (epochs > 0 or rest > 0)").select(source_name("source_name").alias("b_source"), "epochs", "rest")
    docs = keyed.where("doc_id is not null and source is not null")
    medians = docs.groupBy(F.col("source").alias("m_source")).agg(F.percentile_approx("key", 0.5).alias("median"))
    # Any median cuts exact ranges; written, so that the same one is used everywhere.
    medians = materialize(plan.join(medians, F.col("b_source") == F.col("m_source")).drop("m_source"), "medians")
    ranged = docs.join(medians, F.col("source") == F.col("b_source")).withColumn("range", key_range(F.col("key"), F.col("median")))
    sums = ranged.where("rest > 0").groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"), F.first("rest").alias("rest"))
    # At most KEY_RANGES + 1 rows per source; one of them is where its budget ends.
    upto = F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("upto", upto).where("upto > rest").groupBy(F.col("source").alias("e_source"))
    # One row per target; written, so that its size is known before it is joined.
    ends = materialize(over.agg(F.min("range").alias("end_range"), F.min_by(F.col("upto") - F.col("in_range"), "range").alias("before")), "ends")
    # Without a rest nothing more is drawn; a rest that no range passes takes all.
    placed = ranged.join(ends, F.col("source") == F.col("e_source"), "left").withColumn("end_range", F.coalesce("end_range", F.when(F.col("rest") > 0, F.lit(KEY_RANGES + 1)).otherwise(F.lit(-1))))
    # Only in that range do documents need an order.
    inner = Window.partitionBy("source").orderBy("key", "doc_id")
    ended = placed.where("range = end_range").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner))
    ended = ended.withColumn("extra", (2 * F.col("upto") - F.col("n_tokens") <= 2 * F.col("rest")).cast("int")).drop("upto")
    out = placed.where("range != end_range").withColumn("extra", (F.col("range") < F.col("end_range")).cast("int")).unionByName(ended)
    out = out.withColumn("repeats", (F.col("epochs") + F.col("extra")).cast("long")).where("repeats > 0")
    return out.select(F.col("source").alias("source_name"), "doc_id", "repeats", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Columns source_name, doc_id, repeats, n_tokens: how often each document enters the mix (1 or more).

    Documents without an id or tokens, and those of no target's source, don't enter. The same seed gives the same
    mix: a key depends on the id, the seed and the weight alone, ties go by id. No document exceeds ``max_repeats``.
    """
    keyed = keyed_documents(documents, seed)
    return _mix(keyed, source_budgets(keyed, targets))


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Per target the tokens it got, its share of the total it was meant from, and its share of the mix, in permille.

    ``short`` says that the mix has every document of the source as often as it may and still less than the share.
    """
    keyed = keyed_documents(documents, seed)
    budgets = source_budgets(keyed, targets)
    got = _mix(keyed, budgets).groupBy(F.col("source_name").alias("s")).agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("g"), F.max("repeats").alias("most_repeats"), F.count("*").alias("documents"))
    rows = budgets.join(got, source_name("source_name") == F.col("s"), "left").withColumn("mixed_tokens", F.coalesce("g", F.lit(0)).cast("long"))
    exhausted = F.col("mixed_tokens") >= F.coalesce("max_repeats", F.lit(0)).cast("long") * F.col("drawn_tokens")
    wanted = F.coalesce("target_permille", F.lit(0)).cast("decimal(18,0)") * F.col("total_tokens").cast("decimal(19,0)")
    everything = Window.partitionBy(F.lit(1))  # one row per target
    return rows.select(
        "source_name",
        "target_permille",
        "max_repeats",
        "source_tokens",
        "budget",
        "reachable",
        "mixed_tokens",
        (exhausted & (F.lit(1000) * F.col("mixed_tokens").cast("decimal(19,0)") < wanted)).alias("short"),
        F.coalesce("documents", F.lit(0)).cast("long").alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).cast("long").alias("most_repeats"),
        F.round(1000.0 * F.col("mixed_tokens") / F.greatest("total_tokens", F.lit(1)), 3).alias("reached_permille"),
        F.round(1000.0 * F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(everything), F.lit(1)), 3).alias("mix_permille"),
    )
