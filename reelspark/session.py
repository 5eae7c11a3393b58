"""Session construction and the shared folder that intermediate tables live in."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int = 8, app: str = "reelspark") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores or '*'}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REELSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset (tests, a laptop) a temporary folder of this machine is made and set.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if sc.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="reelspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        return f"file://{folder}"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage (a lost executor costs nothing that was written) and, unlike ``checkpoint()``, computes the plan
    a single time. Use it for results that are read more than once. ``release`` deletes what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; call it when the results built on them have been used."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return done


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        with contextlib.suppress(Exception):  # the session may be gone already
            release(spark)


atexit.register(_release_at_exit)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if a scan gives fewer.

    For costly work per row on few or small files. Large inputs come in enough partitions and pass without a shuffle;
    so does what was shuffled before, which has the partitions of its shuffle.
    """
    if df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
