"""Findings that follow the files (O11): changed versions are scanned, and replace what was found.

The store is a folder with three tables, each with a part per micro-batch: ``versions`` (the
text that came), ``findings``, and ``scanned`` (path, deleted), written last. The findings of a
path are those of the last batch that scanned it. A batch that is run again writes its parts
anew, so it changes nothing; a batch that broke off before ``scanned`` is not seen by readers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codescope.operators.rulepack import RULES, Rule
from codescope.operators.text_rules import rule_scan
from codescope.sources.files import explode_lines
from codescope.streaming.stateful import rocksdb


# Paths share state keys: a call for each path would cost far more than its rows do.
PATH_BUCKETS = 2048


class ChangedVersions(StatefulProcessor):
    """Passes on the newest version of a path if its content is another than that passed on
    before. The state of a bucket of paths is a digest and a version's number for each; a
    micro-batch touches the buckets of its paths, and holds their newest texts one bucket at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "path STRING, digest STRING, version LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = None
        for part in rows:
            both = part if newest is None else pd.concat([newest, part], ignore_index=True)
            newest = both.sort_values(["version", "digest"], kind="stable").drop_duplicates("path", keep="last")
        known = {path: (digest, version) for path, digest, version in self.known.get()} if self.known.exists() else {}
        changed, moved = [], False
        for path, digest, version in zip(newest["path"], newest["digest"], newest["version"].tolist()):
            before = known.get(path)
            counts = before is None or version >= before[1]
            changed.append(counts and (before is None or digest != before[0]))
            if counts and (digest, version) != before:
                known[path], moved = (digest, version), True
        if moved:
            self.known.put([(path, *last) for path, last in known.items()])
        if any(changed):
            yield newest[changed].drop(columns=["digest", "bucket"])


def changed_versions(files: DataFrame) -> DataFrame:
    """The versions in ``files`` (project, path, content, version) that change their path's
    content. A null content is a deleted file. Versions older than one that came before are
    ignored; of one path's versions in a micro-batch the newest counts; a null version is 0."""
    rows = files.select("project", "path", "content", F.coalesce(F.col("version"), F.lit(0)).cast("long").alias("version"))
    schema = rows.schema
    rows = rows.withColumn("digest", F.coalesce(F.sha2("content", 256), F.lit("deleted")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(PATH_BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(ChangedVersions(), schema, "append", "none")


def replace_findings(store: str, scan: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: scans a batch's versions and writes its parts of the store."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda table: f"{store}/{table}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at("versions"))
        versions = spark.read.schema(batch.schema).parquet(at("versions"))
        scan(versions.where("content IS NOT NULL")).write.mode("overwrite").parquet(at("findings"))
        scanned = versions.select("path", "version", F.col("content").isNull().alias("deleted"))
        scanned.write.mode("overwrite").parquet(at("scanned"))

    return sink


def scan_versions(rules: Sequence[Rule] = tuple(RULES)) -> Callable[[DataFrame], DataFrame]:
    return lambda versions: rule_scan(explode_lines(versions), rules)


def rescan_replaced(files: DataFrame, store: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keep the findings in ``store`` those of the newest versions in the stream ``files``. A
    store belongs to one checkpoint: its parts are named by the checkpoint's batch numbers."""
    with rocksdb(files.sparkSession):
        return (
            changed_versions(files)
            .writeStream.foreachBatch(replace_findings(store, scan or scan_versions()))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def scans(spark: SparkSession, store: str) -> DataFrame:
    """(path, version, deleted, batch): every scan of a path."""
    return spark.read.parquet(f"{store}/scanned")


def current_findings(spark: SparkSession, store: str) -> DataFrame:
    """The findings of the newest scanned version of every path that is not deleted."""
    last = scans(spark, store).groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{store}/findings").join(last, ["path", "batch"]).drop("batch")


def compact(spark: SparkSession, store: str, into: str) -> None:
    """Write the current findings, the last scan of every path, and its text as a new store that
    a stream can go on with: parts of earlier batches become one part."""
    every = scans(spark, store)
    last = every.groupBy("path").agg(F.max("batch").alias("batch"))
    top = last.agg(F.max("batch").alias("n")).first()["n"]
    for table in ("versions", "findings", "scanned"):
        rows = spark.read.parquet(f"{store}/{table}").join(last, ["path", "batch"]).drop("batch")
        rows.write.mode("overwrite").parquet(f"{into}/{table}/batch={top or 0}")
