"""File listings, settings, and nothing that reads secrets on executors."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_of(globs: str | tuple[str, ...] | list[str]) -> str:
    """One pattern for several."""
    return globs if isinstance(globs, str) else "{" + ",".join(globs) + "}"


def without(rows: DataFrame, names: tuple[str, ...] | list[str], path: str = "path") -> DataFrame:
    """Rows whose file isn't called one of these names."""
    return rows.where(~F.element_at(F.split(path, "/"), -1).isin(list(names))) if names else rows


def list_files(spark: SparkSession, path: str, glob: str | tuple[str, ...] = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, size, modified of the files below a folder, by one or several name patterns; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob_of(glob)).load(path)
    return without(files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")), exclude)


def read_bytes(spark: SparkSession, path: str, glob: str | tuple[str, ...] = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, content of whole files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob_of(glob)).load(path)
    return without(files.select("path", "content"), exclude)


def relative_path(path: str, root: str):
    """Of a column of paths below ``root``."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "^" + re.escape(re.sub("^file:/*", "/", root).rstrip("/")) + "/", "")


def load_settings(path: str, into: dict | None = None) -> dict:
    """KEY=VALUE lines of a file on the driver; what is set already stays."""
    target = os.environ if into is None else into
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#"):
                    target.setdefault(name.strip(), value.strip())
    return target


def inside(root: str, path: str) -> bool:
    """Whether a relative output path stays below its folder."""
    full = os.path.normpath(os.path.join(root, path))
    return full == os.path.normpath(root) or full.startswith(os.path.normpath(root) + os.sep)


def write_bytes(rows: DataFrame, root: str, path: str = "out_path", content: str = "content") -> DataFrame:
    """out_path, error: writes one file per row below a shared folder; paths that leave it are refused.

    ``root`` is a path or an address of any store that pyarrow knows (file, hdfs, s3, gs), which all executors must reach.
    Each file is written under another name and moved, so a task that runs twice leaves the same file.
    """
    import pandas as pd
    from pyarrow import fs

    def run(batches):
        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for pdf in batches:
            errors = []
            for p, data in zip(pdf["p"], pdf["t"], strict=True):
                try:
                    if p is None or not inside(base, p):
                        raise ValueError("outside the folder")
                    full = os.path.join(base, p)
                    store.create_dir(os.path.dirname(full), recursive=True)
                    with store.open_output_stream(f"{full}.part") as out:
                        out.write(bytes(data) if data is not None else b"")
                    store.move(f"{full}.part", full)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
            yield pd.DataFrame({"out_path": pdf["p"], "error": pd.Series(errors, dtype=object)})

    return rows.select(F.col(path).alias("p"), F.col(content).alias("t")).mapInPandas(run, "out_path string, error string")


def write_texts(rows: DataFrame, root: str, path: str = "out_path", text: str = "html") -> DataFrame:
    """As ``write_bytes``, of texts in UTF-8."""
    return write_bytes(rows.select(path, F.encode(text, "UTF-8").alias("_bytes")), root, path, "_bytes")


def copy_files(spark: SparkSession, source: str, root: str, glob: str | tuple[str, ...] = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """out_path, error: the files of a folder under the same relative paths, byte by byte."""
    files = read_bytes(spark, source, glob, exclude)
    return write_bytes(files.select(relative_path("path", source).alias("out_path"), "content"), root)
