"""Sequence patterns against a plain run of their automata."""

import random

from conftest import rows
from codescope.operators import sequences as sq

SCHEMA = "symbol_id STRING, path STRING, line INT, col INT, caller_id STRING, ref_kind STRING"


def plain(data, patterns):
    found = []
    for key in {r[0] for r in data if r[0] is not None}:
        run = sorted((r for r in data if r[0] == key), key=lambda r: [(v is not None, v) for v in r])
        for p in patterns:
            state = 0
            for r in run:
                if (state, r[5]) in p.reports:
                    found.append((p.id, *r))
                state = p.moves.get((state, r[5]), state)
            if state in p.open_ends:
                found.append((p.id, *run[-1]))
    return sorted(found, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def accesses(n, seed):
    rng = random.Random(seed)
    kinds = ["create", "read", "read", "write", "wait", "release", None, "other"]
    # One symbol with most of the rows, and many with a row or two.
    return [
        (rng.choice(["hot"] * 6 + ["b", "c", None, f"s{i % 97}"]), f"f{rng.randrange(40)}", rng.randrange(30), rng.randrange(3), "m", rng.choice(kinds))
        for i in range(n)
    ]


def test_patterns_over_cut_keys(spark):
    data = accesses(6000, 5)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive execution would join small pieces
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        pieces = df.repartitionByRange("symbol_id", "path", "line").where("symbol_id = 'hot'").selectExpr("spark_partition_id() AS p").distinct().count()
        assert pieces > 2
        found = sq.sequence_findings(df)
        assert rows(found, "detector", "symbol_id", "path", "line", "col", "caller_id", "ref_kind") == plain(data, sq.PATTERNS)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_small_and_empty(spark):
    for data in ([], [("a", "f", 1, 1, "m", "create")], [("a", None, None, None, None, "wait")] * 2, [(None, "f", 1, 1, "m", "wait")]):
        found = sq.sequence_findings(spark.createDataFrame(data, SCHEMA))
        assert rows(found, "detector", "symbol_id", "path", "line", "col", "caller_id", "ref_kind") == plain(data, sq.PATTERNS)


def test_batches_do_not_matter(spark):
    data = accesses(400, 9)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        found = sq.sequence_findings(spark.createDataFrame(data, SCHEMA))
        assert rows(found, "detector", "symbol_id", "path", "line", "col", "caller_id", "ref_kind") == plain(data, sq.PATTERNS)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
