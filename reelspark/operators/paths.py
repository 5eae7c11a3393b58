"""File listings as trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions.text import hidden_name
from reelspark.operators.ordered import numbered


def ancestors(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def visible_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Pages (.html) outside hidden names and outside folders that stand beside a page of their name."""
    shown = files.where(F.lower(path).endswith(".html") & F.forall(F.split(path, "/"), lambda p: ~hidden_name(p))).select(F.col(path).alias("path")).distinct()
    assets = shown.select(F.regexp_replace("path", r"(?i)\.html$", "").alias("folder"))
    inside = shown.where(F.instr("path", "/") > 0).select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(assets, "folder", "left_semi").select("path").distinct()
    return shown.join(inside, "path", "left_anti")


def tree_nodes(files: DataFrame, path: str = "path") -> DataFrame:
    """path, parent, name, type, file_count: the files and their folders; folders without files don't appear.

    Counts are of all files below. Order siblings by ``tree_order``.
    """
    leaves = visible_files(files, path)
    folders = leaves.where(F.instr("path", "/") > 0).select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("file_count"))
    nodes = folders.withColumn("type", F.lit("dir")).unionByName(leaves.withColumn("type", F.lit("file")).withColumn("file_count", F.lit(1).cast("long")))
    return nodes.select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("parent"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "type", "file_count")


def tree_order() -> list[Column]:
    """Folders before files, then names without regard to case."""
    return [(F.col("type") != "dir").cast("int"), F.lower("name"), F.col("name")]


def filter_tree(nodes: DataFrame, text: str) -> DataFrame:
    """The files whose name contains a text, and the folders above them."""
    hits = nodes.where((F.col("type") == "file") & F.lower("name").contains(text.lower()))
    above = hits.where(F.instr("path", "/") > 0).select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return nodes.join(above.unionByName(hits.select("path")), "path", "left_semi")


def _next_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names in order, group by group: the own one, or the first of _1, _2, ... that no name before has."""
    group, taken, upto = None, set(), {}
    for batch in batches:
        out = []
        for g, name in zip(batch.column("_g").to_pylist(), batch.column("_name").to_pylist(), strict=True):
            if g != group:
                group, taken, upto = g, set(), {}
            dot = name.rfind(".")
            stem, ext = (name, "") if dot < 0 else (name[:dot], name[dot:])
            unique, k = name, upto.get(name, 0)
            while unique in taken:
                k += 1
                unique = f"{stem}_{k}{ext}"
            taken.add(unique)
            upto[name] = k
            out.append(unique)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "unique_name"])


def unique_names(rows: DataFrame, scope: str | None, name: str, order: list[str]) -> DataFrame:
    """``rows`` with ``unique_name``: the name, or with _1, _2, ... for the second and later of its scope, in their order.

    Where a suffixed name would meet another row's own name, the names of that root are given out one after another, each
    the first that is free; all others are numbered without gathering a name in one task. Null names stay null.
    """
    given = rows.where(F.col(name).isNotNull())
    scoped = F.concat_ws("\x1f", *([F.coalesce(F.col(scope).cast("string"), F.lit(""))] if scope else []), F.col(name))
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]*$", 0)
    root = F.concat_ws("\x1f", *([F.coalesce(F.col(scope).cast("string"), F.lit(""))] if scope else []), F.regexp_replace(stem, r"(?:_\d+)+$", ""), ext)
    named = numbered(given.withColumn("_k", scoped), "_k", order, "_n").withColumn("_g", root)
    named = named.withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), (F.col("_n") - 1).cast("string"), ext)))
    new = F.concat_ws("\x1f", *([F.coalesce(F.col(scope).cast("string"), F.lit(""))] if scope else []), "unique_name")
    own = named.where("_n = 1").select(F.col("_k").alias("_own"))
    meeting = named.where("_n > 1").select("_g", new.alias("_new")).join(own, F.col("_new") == F.col("_own"), "left_semi").select("_g").distinct()
    columns = [*rows.columns, "unique_name"]
    fine = named.join(meeting, "_g", "left_anti").select(*columns)
    clashing = named.join(meeting, "_g", "left_semi").select(*rows.columns, F.col(name).alias("_name"), "_g").repartition("_g").sortWithinPartitions("_g", *order)
    schema = T.StructType([*clashing.schema.fields, T.StructField("unique_name", T.StringType())])
    settled = clashing.mapInArrow(_next_free, schema).select(*columns)
    return fine.unionByName(settled).unionByName(rows.where(F.col(name).isNull()).withColumn("unique_name", F.lit(None).cast("string")))
