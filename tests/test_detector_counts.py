import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from codescope.plans.catalog import QUERIES
from codescope.plans.registry import Detector, count_findings
from codescope.session import disk_released, scratch_path, scratch_paths, written

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (blocks.apply(i).getName() for i in range(blocks.size()))
    return {name for name in names if name.startswith("shuffle_")}


def _left(spark, before):
    """The shuffle files not there ``before``, once there are none or after 20 s: their end is not waited for."""
    for _ in range(40):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.5)
    return left


def test_detector_counts_give_back_their_disk(spark):
    before, scratch = _shuffle_files(spark), scratch_paths()
    found = QUERIES["T8_detector_counts"](spark, "/root/testdata/sf0.001")
    assert not _left(spark, before)
    assert scratch_paths() == scratch
    assert found.count() == 55 and found.agg(F.sum("n_findings")).first()[0] > 0


def test_groups_are_counted_one_after_the_other(spark):
    before, scratch, seen = _shuffle_files(spark), scratch_paths(), []

    def find(df):
        seen.append((len(_left(spark, before)), len(scratch_paths()) - len(scratch)))
        return written(df.groupBy("path").count().where("count > 1"), "twice").select("path")

    known = [Detector(name, "size", "Info", ("t",), find) for name in ("first", "second", "none")]

    def groups():
        t = written(spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "path STRING"), "t")
        yield ["first"], {"t": t}
        yield ["second"], {"t": t.where("path <> 'b'")}
        yield ["none"], {"t": t.limit(1)}

    assert rows(count_findings(spark, groups(), known)) == [("first", 2), ("second", 1)]
    # What all groups read stays until the last; what one wrote is gone when the next begins.
    assert seen == [(0, 1)] * 3
    assert not _left(spark, before) and scratch_paths() == scratch


def test_released_disk_leaves_the_session_as_it_was(spark):
    scratch, held = scratch_paths(), spark.conf.get(CLEANUP, None)
    kept = scratch_path(spark, "kept")
    with pytest.raises(ValueError):
        with disk_released(spark):
            inner = written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "inner")
            assert inner.count() == 3 and spark.conf.get(CLEANUP) == "true"
            raise ValueError
    assert scratch_paths() == [*scratch, kept]
    assert spark.conf.get(CLEANUP, None) == held
