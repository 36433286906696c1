import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from codescope.functions.ordered import ordered_rows
from codescope.operators import search


def _data(spark):
    random.seed(3)
    data = []
    for i in range(400):
        key = None if i % 50 == 0 else random.choice(["hot"] * 8 + ["a", "b"])
        data.append((key, i, random.randint(-5, 9), random.random() < 0.3))
    return spark.createDataFrame(data, "k STRING, o INT, v INT, f BOOLEAN").repartition(7)


@pytest.fixture
def uncoalesced(spark):
    """Small pieces would be put together by adaptive execution."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_pieces_equal_plain_window(spark, uncoalesced):
    df = _data(spark)
    specs = dict(
        total=("sum", F.col("v")),
        high=("max", F.col("v")),
        low=("min", F.when(F.col("f"), F.col("v"))),
        before=("lag", F.col("v")),
        whole=("total_sum", F.col("v")),
        first=("total_min", F.when(F.col("f"), F.struct("o", "v"))),
    )
    group = Window.partitionBy("k")
    ordered = group.orderBy("o")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = F.when(F.col("f"), F.col("v"))
    columns = ["k", "o", "total", "high", "low", "before", "whole", "first"]
    expected = df.select(
        "k",
        "o",
        F.sum("v").over(running).alias("total"),
        F.max("v").over(running).alias("high"),
        F.min(flagged).over(running).alias("low"),
        F.lag("v").over(ordered).alias("before"),
        F.sum("v").over(group).alias("whole"),
        F.min(F.when(F.col("f"), F.struct("o", "v"))).over(group).alias("first"),
    )
    pieces = ordered_rows(df, ["k"], ["o"])
    assert pieces.df.where("k = 'hot'").select("_piece").distinct().count() > 1
    found = pieces.running(**specs).result().select(columns)
    key = lambda r: (r["o"],)
    assert sorted(found.collect(), key=key) == sorted(expected.collect(), key=key)


def test_hot_symbol_timeline(spark):
    random.seed(5)
    kinds = ["read", "write", "call", "out"]
    data = [
        ("s" if i % 3 else f"t{i}", f"p{random.randint(0, 9)}", i, 0, "c", random.choice(kinds)) for i in range(200)
    ]
    references = spark.createDataFrame(
        data, "symbol_id STRING, path STRING, line INT, col INT, caller_id STRING, ref_kind STRING"
    )
    found = search.access_timeline(references).collect()
    assert len(found) == 200
    for symbol in {r.symbol_id for r in found}:
        own = sorted((r for r in found if r.symbol_id == symbol), key=lambda r: r.nth_access)
        assert [r.nth_access for r in own] == list(range(1, len(own) + 1))
        assert [(r.path, r.line) for r in own] == sorted((r.path, r.line) for r in own)
        assert [r.prev_kind for r in own] == [None, *(r.ref_kind for r in own[:-1])]
