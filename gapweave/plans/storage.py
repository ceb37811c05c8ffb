"""Session helpers and stage tables written to the cluster's shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Writes:
    """Writes under way and the settings before them, by application. A copy that travels with a pickled module starts anew: a lock cannot be pickled."""

    def __init__(self):
        self.lock, self.now, self.before = threading.Lock(), Counter(), {}

    def __reduce__(self):
        return _Writes, ()


_WRITES = _Writes()


def local_session(cores: str = "8", app: str = "gapweave") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local-mode session may fall back to a scratch folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="spark-gapweave-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "gapweave", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are removed as each of them ends, since the table holds what they held. With the last of writes at a time the session's own setting comes back."""
    app, w = spark.sparkContext.applicationId, _WRITES
    with w.lock:
        if not w.now[app]:
            w.before[app] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        w.now[app] += 1
    try:
        yield
    finally:
        with w.lock:
            w.now[app] -= 1
            if not w.now[app]:
                spark.conf.unset(_CLEANUP) if w.before[app] is None else spark.conf.set(_CLEANUP, w.before[app])


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a stage to parquet in the shared folder and read it back: flat lineage, prunable columns, no shuffle files left."""
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_all(builders: Mapping[str, Callable[[], DataFrame]], name: str, at_once: int = 2) -> list[DataFrame]:
    """Write independent stages, ``at_once`` at the same time: small shuffles overlap on the cluster, and not all of them are on disk together."""
    with ThreadPoolExecutor(max_workers=min(at_once, len(builders))) as pool:
        jobs = [pool.submit(lambda k=k, fn=fn: materialize(fn(), f"{name}-{k}")) for k, fn in builders.items()]
        return [j.result() for j in jobs]


def sequential_ids(df: DataFrame, order: list[str], id_col: str, name: str = "ordered") -> DataFrame:
    """Global 0-based ids in ``order`` without a one-task sort.

    The rows are range-sorted and written once; an id is the row's index in its file plus the row
    counts of the files before it, in the order of their part numbers. Only one row per file is ordered globally.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.orderBy(*order).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(files, "_file").select((F.col("_offset") + F.col("_row")).alias(id_col), *df.columns)
