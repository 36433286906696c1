"""What the text operators share: scratch tables, column names, and tables of the driver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codescope.session import scratch_path

# Space, tab, line feed, vertical tab, form feed and carriage return part words.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, columnar, and safe from lost
    executors. Its size on disk is known, so joins with it can be planned by size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer name if a column of ``df`` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch, for wide rows: both sides of the exchange hold
    whole batches. What is to be computed so must be written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_unused() -> None:
    """Give back the memory of batches that are done with. To be called where a task ends: its
    Python worker stays, and would hold it while others run."""
    pa.default_memory_pool().release_unused()
