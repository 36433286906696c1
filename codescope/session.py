"""Session settings, the shared folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("codescope")
    partitions = "8" if cores == "*" else str(cores)
    settings = {**LOCAL_DEFAULTS, "spark.sql.shuffle.partitions": partitions, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would lose its files together with the executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


_SCRATCH: list[str] = []
# The scratch paths of the innermost ``disk_released``, if there is one.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, for tables written between stages."""
    path = f"{shared_dir(spark).rstrip('/')}/codescope/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    passing = _PASSING.get()
    if passing is not None:
        passing.append(path)
    return path


def scratch_paths() -> list[str]:
    """The scratch paths given out by this process and not removed since, the oldest first."""
    return list(_SCRATCH)


def remove_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the scratch tables of this process, or those of ``paths``; results that still read
    them are lost.

    Checkpoints go by themselves with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    for name in scratch_paths() if paths is None else paths:
        if name in _SCRATCH:
            _SCRATCH.remove(name)
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def disk_released(spark: SparkSession) -> Iterator[None]:
    """Jobs within give their disk back: the shuffle files of an action go when it ends, not when
    the driver happens to collect its garbage, and the scratch tables written within go at the
    end. So several results that are small take the disk of the largest job, not of all."""
    passing: list[str] = []
    token, before = _PASSING.set(passing), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        _PASSING.reset(token)
        remove_scratch(spark, passing)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a scratch table: read by column, and planned by its size on disk."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy.

    A loop that grows a plan by one join per round needs this: the plan stays
    short, and a lost executor costs one read instead of every earlier round.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# A looked-up side of at most this many narrow rows (ids, labels, depths) is broadcast.
BROADCAST_ROWS = 100_000


def cut_and_count(df: DataFrame, which: str = "true") -> tuple[DataFrame, int]:
    """``cut_lineage`` with the number of rows that satisfy ``which``, counted while they
    are written."""
    observed = Observation()
    kept = cut_lineage(df.observe(observed, F.count_if(F.expr(which)).alias("n")))
    return kept, observed.get["n"]


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a join side, and so its join, for a shuffle: an estimate, which counts neither what
    an explode adds nor what strings weigh unpacked, must not have it broadcast."""
    return df.hint("merge")


def lookup_side(df: DataFrame, rows: int) -> DataFrame:
    """Mark a join side for broadcast if its counted size allows, else for a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else shuffled(df)


# Rows of a key-wise shuffle that one task sorts or aggregates.
ROWS_A_TASK = 250_000


def in_bounded_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of about ``ROWS_A_TASK`` of its ``rows``, if that takes
    more tasks than run at once: adaptive execution sizes tasks by compressed bytes, of which
    narrow rows take so few that the rows of a task would grow with the input."""
    tasks = -(-rows // ROWS_A_TASK)
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(tasks, *keys)
