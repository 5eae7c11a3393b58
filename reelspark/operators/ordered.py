"""Previous rows and running sums over ordered keys, without gathering a key in one task.

Rows are range-partitioned by key and order, so a hot key spreads over many tasks. Each task works in one pass over its
sorted rows; what crosses from one partition to the next is one row per partition, settled afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.session import materialize


def _scan(key: str, lags: dict[str, str], sums: dict[str, str]):
    def work(pdf: pd.DataFrame, carry: dict | None, pid: int, head_key) -> tuple[pd.DataFrame, dict, object]:
        keys = pdf[key]
        first_batch = carry is None
        if first_batch:
            head_key = keys.iloc[0]
        new = keys.ne(keys.shift())
        if not first_batch:
            new.iloc[0] = keys.iloc[0] != carry["key"]
        for out, col in lags.items():
            before = pdf[col].shift()
            if not first_batch:
                before = before.astype(object)
                before.iloc[0] = carry["row"][col]
            pdf[out] = before.astype(object).where(~new, None)
        group = new.cumsum()
        for out, col in sums.items():
            add = pdf.groupby(group, sort=False)[col].cumsum()
            if not first_batch and not new.iloc[0]:
                add = add + (group == group.iloc[0]) * carry["sums"][out]
            pdf[out] = add.astype("int64")
        pdf["_pid"], pdf["_head"], pdf["_first"], pdf["_tail"] = pid, keys == head_key, False, False
        if first_batch:
            pdf.loc[pdf.index[0], "_first"] = True
        last = pdf.iloc[-1]
        return pdf, {"key": last[key], "row": last, "sums": {o: int(last[o]) for o in sums}}, head_key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, carry, head_key, held = TaskContext.get().partitionId(), None, None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            if held is not None:
                yield held
            held, carry, head_key = work(pdf.reset_index(drop=True), carry, pid, head_key)
        if held is not None:
            held.loc[held.index[-1], "_tail"] = True
            yield held

    return run


def ordered(df: DataFrame, key: str, order: list[str], *, lag: dict[str, str] | None = None, running: dict[str, Column] | None = None, descending: bool = False) -> DataFrame:
    """``df`` with new columns: ``lag`` names earlier rows' columns, ``running`` gives whole numbers to sum up to each row.

    ``order`` must be total within a key. Rows with a null key are left out. With ``descending`` the order is turned
    round, so that lags become leads. Without rows the result is empty.
    """
    lag, running = lag or {}, running or {}
    sums = {out: f"_v_{out}" for out in running}
    for out, value in running.items():
        df = df.withColumn(sums[out], F.coalesce(value.cast("long"), F.lit(0)))
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    fields = [*df.schema.fields, *[T.StructField(o, df.schema[c].dataType) for o, c in lag.items()], *[T.StructField(o, T.LongType()) for o in sums]]
    fields += [T.StructField("_pid", T.IntegerType()), *[T.StructField(c, T.BooleanType()) for c in ("_head", "_first", "_tail")]]
    spread = df.where(F.col(key).isNotNull()).repartitionByRange(F.col(key), *by).sortWithinPartitions(F.col(key), *by)
    rows = materialize(spread.mapInPandas(_scan(key, lag, sums), T.StructType(fields)), "ordered")
    # Two rows per partition at most, whatever the input.
    edges = rows.where("_first or _tail").select("_pid", F.col(key).alias("_key"), "_head", "_first", "_tail", *set(lag.values()), *sums).collect()
    fixes, before = [], None
    heads = {e["_pid"]: e["_key"] for e in edges if e["_first"]}
    for e in sorted((e for e in edges if e["_tail"]), key=lambda e: e["_pid"]):
        joined = before is not None and before["key"] == heads[e["_pid"]]
        add = {o: before["sums"][o] if joined else 0 for o in sums}
        fixes.append((e["_pid"], joined, *[before["row"][c] if joined else None for c in lag.values()], *[add[o] for o in sums]))
        before = {"key": e["_key"], "row": e, "sums": {o: e[o] + (add[o] if e["_head"] else 0) for o in sums}}
    schema = T.StructType(
        [T.StructField("_p", T.IntegerType()), T.StructField("_joined", T.BooleanType())]
        + [T.StructField(f"_l_{o}", df.schema[c].dataType) for o, c in lag.items()]
        + [T.StructField(f"_s_{o}", T.LongType()) for o in sums]
    )
    fixed = rows.join(F.broadcast(df.sparkSession.createDataFrame(fixes, schema)), F.col("_pid") == F.col("_p"), "left")
    at_edge = F.col("_first") & F.col("_joined")
    out = fixed.withColumns({o: F.when(at_edge, F.col(f"_l_{o}")).otherwise(F.col(o)) for o in lag} | {o: F.col(o) + F.when(F.col("_head"), F.coalesce(f"_s_{o}", F.lit(0))).otherwise(0) for o in sums})
    return out.select(*[c for c in df.columns if c not in sums.values()], *lag, *sums)


def numbered(df: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """Rows of each key numbered from 1."""
    return ordered(df, key, order, running={name: F.lit(1)})
