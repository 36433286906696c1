"""Innermost intervals against brute force."""

import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codescope.operators import search
from codescope.operators.intervals import innermost


def innermost_of(point, intervals):
    path, line = point
    around = [(a, -b, n or "", c or "") for p, a, b, n, c in intervals if p == path and a <= line <= b]
    return max(around)[2] if around else None


@pytest.mark.parametrize("nested", [True, False])
def test_innermost_equals_brute_force(spark, nested):
    rng = random.Random(nested)
    intervals, points = [], []

    def nest(path, a, b, depth):
        intervals.append((path, a, b, f"{path}-{a}-{b}", "c"))
        while depth and b - a > 2 and rng.random() < 0.9:
            x = rng.randrange(a, b)
            y = rng.randrange(x, b)
            nest(path, x, y, depth - 1)
            a = y + 1

    for k in range(4):
        if nested:
            nest(f"p{k}", 1, 400, 6)
        else:
            for i in range(120):
                a = rng.randrange(400)
                intervals.append((f"p{k}", a, a + rng.randrange(200), f"n{i % 9}", f"c{i % 2}"))
        points += [(f"p{k}", rng.randrange(450)) for _ in range(200)]
    points += [(None, 3), ("p0", None), ("unknown", 1)]
    intervals += [(None, 1, 9, "x", "c"), ("p0", None, 9, "x", "c"), ("p0", 1, None, "x", "c"), ("p1", 9, 3, "x", "c")]
    found = innermost(
        spark.createDataFrame(points, "path string, line_no int"),
        spark.createDataFrame(intervals, "path string, line int, end_line int, name string, container string"),
    )
    known = [x for x in intervals if None not in x[:3]]
    wanted = sorted(((p, n, None if None in (p, n) else innermost_of((p, n), known)) for p, n in points), key=str)
    assert sorted(rows(found.select("path", "line_no", F.col("found")[0]["name"].alias("name"))), key=str) == wanted


def test_kinds_are_found_apart(spark):
    intervals = [("a", 1, 100, "T", "c", "type"), ("a", 5, 50, "m", "c", "method"), ("a", 10, 20, "f", "c", "local"), ("a", 12, 18, "g", "c", "local"), ("a", 60, 70, "n", "c", "method")]
    hits = spark.createDataFrame([("a", n) for n in (1, 5, 11, 15, 19, 21, 55, 60, 101)], "path string, line_no int")
    found = search.enclosing_levels(hits, spark.createDataFrame(intervals, "path string, line int, end_line int, name string, container string, kind string"))
    assert [r[2:] for r in rows(found)] == [
        ("T", None, None), ("T", "m", None), ("T", "m", "f"), ("T", "m", "g"), ("T", "m", "f"), ("T", "m", None), ("T", None, None), ("T", "n", None), (None, None, None),
    ]


def test_one_path_with_very_many_of_both(spark):
    """10^5 hits and 10^5 nested definitions of one path: their product would be 10^10."""
    n = 100_000
    line = F.col("id") + 1
    hits = spark.range(n).select(F.lit("hot").alias("path"), line.alias("line_no"))
    # Ever shorter intervals from each line on, inside of one that holds all.
    members = spark.range(n).select(F.lit("hot").alias("path"), line.alias("line"), (line + F.pmod(-line, F.lit(10))).alias("end_line"), F.concat(F.lit("d"), line).alias("name"), F.lit("c").alias("container"))
    outer = spark.createDataFrame([("hot", 0, 2 * n, "all", "c")], members.schema)
    start = time.time()
    found = search.enclosing_members(hits, members.unionByName(outer))
    assert found.where("member = concat('d', line_no)").count() == n
    assert search.enclosing_members(hits, outer).where("member = 'all'").count() == n
    assert time.time() - start < 120
