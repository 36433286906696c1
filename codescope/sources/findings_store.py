"""Stored scan results."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS_PER_FILE = 5_000_000


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by domain and detector, so that a reader of one detector reads only it.

    The rebalance hint gathers a detector's rows into few files and lets adaptive execution
    split a detector that has too many for one task."""
    (
        findings.hint("rebalance", "domain", "detector")
        .write.mode(mode)
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy("domain", "detector")
        .parquet(path)
    )


def read_findings(
    spark: SparkSession,
    path: str,
    detector: str,
    limit: int = 50,
    offset: int = 0,
    order: tuple[str, ...] = ("project", "path", "line", "member"),
) -> DataFrame:
    """One page of a detector's findings, with ``total_records`` and ``has_more``.

    The total is a separate pre-aggregated count: a window over the whole result
    would move every row to one task.
    """
    rows = spark.read.parquet(path).where(F.col("detector") == detector)
    total = rows.agg(F.count("*").alias("n")).scalar()
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("total_records", total).withColumn(
        "has_more", F.col("total_records") > offset + limit
    )


# --- pages of any depth -------------------------------------------------------------


def write_paged(
    findings: DataFrame,
    path: str,
    order: tuple[str, ...] = ("project", "path", "line", "member"),
    key: str = "detector",
    rows_per_file: int = MAX_ROWS_PER_FILE,
) -> None:
    """Findings in the order in which pages show them, with an index of the counts per range.

    Rows are range-partitioned by detector and order, so a hot detector is cut too, and each
    knows its place in its range. Rows that tie in ``order`` follow their other columns. The
    names ``_range`` and ``_place`` are taken. ``path`` must be new.
    """
    spark = findings.sparkSession
    rest = sorted(c for c in findings.columns if c not in (key, *order))
    along = [F.col(f"`{c}`") for c in (key, *order, *rest)]
    ranged = findings.repartitionByRange(*along).withColumn("_range", F.spark_partition_id())
    # Sorted by range first, as the writer wants it, so that it doesn't sort again.
    ranged = ranged.sortWithinPartitions("_range", *along)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    writer = ranged.withColumn("_place", place).write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("_range").parquet(f"{path}/rows")
    stored = spark.read.schema(ranged.schema.add("_place", "long")).parquet(f"{path}/rows")
    index = stored.groupBy(F.col(f"`{key}`").alias("key"), "_range").agg(F.min("_place").alias("first"), F.count("*").alias("n"))
    # A row per range and detector in it: both are few.
    index.coalesce(1).write.mode("errorifexists").parquet(f"{path}/index")
    # No rows, for the columns: an empty store has no file to tell them.
    findings.limit(0).coalesce(1).write.mode("errorifexists").parquet(f"{path}/columns")


def page_ranges(spark: SparkSession, path: str, value: str | None, limit: int, offset: int) -> tuple[int, list]:
    """The total of a detector, and (range, from, upto): where its page lies."""
    index = spark.read.parquet(f"{path}/index").where(F.col("key").eqNullSafe(F.lit(value)))
    group = Window.partitionBy("key")
    before = F.sum("n").over(group.orderBy("_range")) - F.col("n")
    known = index.select("*", before.alias("before"), F.sum("n").over(group).alias("total"))
    start = F.greatest(F.lit(offset) - F.col("before"), F.lit(0))
    upto = F.least(F.lit(offset + limit) - F.col("before"), F.col("n"))
    here = known.select("_range", "total", (F.col("first") + start).alias("from"), (F.col("first") + upto).alias("upto"))
    # At most ``limit`` rows.
    ranges = here.where("from < upto").orderBy("_range").collect()
    total = ranges[0]["total"] if ranges else index.agg(F.sum("n").alias("total")).first()["total"]
    return total or 0, ranges


def read_page(spark: SparkSession, path: str, value: str | None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a detector's findings as ``write_paged`` stored them, with ``total_records``
    and ``has_more``.

    The index names the ranges that hold the page; only their files are read, and of these the
    row groups with the page's places. So a page costs the same at any depth. A page beyond the
    end, or of an unknown detector, is empty.
    """
    total, ranges = page_ranges(spark, path, value, limit, offset)
    root, rows = f"{path}/rows", spark.read.parquet(f"{path}/columns")
    if ranges:
        stored = rows.schema.add("_place", "long").add("_range", "integer")
        rows = spark.read.schema(stored).option("basePath", root).parquet(*[f"{root}/_range={r['_range']}" for r in ranges])
        here = [(F.col("_range") == r["_range"]) & (F.col("_place") >= r["from"]) & (F.col("_place") < r["upto"]) for r in ranges]
        rows = rows.where(reduce(or_, here)).orderBy("_range", "_place").limit(limit)
    return rows.drop("_range", "_place").withColumns({"total_records": F.lit(total).cast("long"), "has_more": F.lit(total > offset + limit)})
