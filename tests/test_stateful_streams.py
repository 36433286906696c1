"""Streams with typed state: call limits, and findings that follow the files."""

import random

from conftest import rows
from pyspark.sql import functions as F

from codescope.operators import outcomes
from codescope.operators.rulepack import Rule
from codescope.streaming import jobs, limits, rescan
from codescope.streaming.stateful import rocksdb

CALLS = "tool string, ts timestamp, event_id long, note string"


def limited(spark, folder, parts, **settings):
    """The decisions on calls that arrive in parts, the stream being started anew for each."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/calls")
        stream = spark.readStream.schema(CALLS).parquet(f"{folder}/calls")
        with rocksdb(spark):
            jobs.append_to_parquet(limits.rate_limit_stream(stream, **settings), f"{folder}/out", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def some_calls(spark, n, seconds, seed):
    rng = random.Random(seed)
    made = [(rng.choice(["a", "B", None]), rng.uniform(0, seconds), i, None) for i in range(n)]
    df = spark.createDataFrame(made, "tool string, at double, event_id long, note string")
    return df.select("tool", F.timestamp_seconds("at").alias("ts"), "event_id", "note")


def test_limits_equal_the_batch_operator(spark, folder):
    calls = some_calls(spark, 400, 900, 1)
    settings = {"limits": {"b": 2}, "default_limit": 4, "window_s": 60}
    wanted = rows(outcomes.rate_limit(calls, **settings), "event_id", "accepted", "limit")
    second = F.unix_seconds("ts")
    found = limited(spark, folder, [calls.where(second < 200), calls.where((second >= 200) & (second < 700)), calls.where(second >= 700)], **settings)
    assert rows(found, "event_id", "accepted", "limit") == wanted
    assert {r[1] for r in wanted} == {True, False}
    assert found.columns == [*calls.columns, "limit", "accepted"]


def test_limiter_keeps_at_most_limit_times(spark, folder):
    calls = some_calls(spark, 300, 50, 2)
    limited(spark, folder, [calls], default_limit=3, window_s=60)
    kept = spark.read.format("statestore").option("stateVarName", "accepted").load(f"{folder}/progress")
    assert 0 < kept.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 3


def test_idle_tools_keep_no_state(spark, folder):
    day = spark.createDataFrame([("a", 1), ("b", 2)], "tool string, id long").select("tool", F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.lit(None).cast("string").alias("note"))
    later = day.where("tool = 'b'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    found = limited(spark, folder, [day, later, later.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))], default_limit=1)
    assert found.where("accepted").count() == 4
    kept = spark.read.format("statestore").option("stateVarName", "newest").load(f"{folder}/progress")
    assert [r["key"]["tool"] for r in kept.select("key").collect()] == ["b"]


def test_clock_of_a_tool_does_not_run_back(spark, folder):
    made = lambda *at: spark.createDataFrame([("a", float(s), s) for s in at], "tool string, at double, event_id long").select("tool", F.timestamp_seconds("at").alias("ts"), "event_id", F.lit(None).cast("string").alias("note"))
    found = limited(spark, folder, [made(100, 101), made(50, 170), made(162)], default_limit=3, window_s=60)
    # The call at 50 counts as one at 101: a third in its window.
    assert rows(found, "event_id", "accepted") == [(50, True), (100, True), (101, True), (162, True), (170, True)]
    none = spark.createDataFrame([("a", None, 7, None)], CALLS)
    assert limited(spark, folder, [none], default_limit=3, window_s=60).where("event_id = 7").count() == 0


# --- findings -----------------------------------------------------------------------

FILES = "project string, path string, content string, version long"
RULES = [Rule("bad", "d", "Info", "bad", "bad word"), Rule("mail", "d", "Info", "@", "mail")]


def scanned(spark, folder, *arrivals):
    for rows_ in arrivals:
        spark.createDataFrame(rows_, FILES).coalesce(1).write.mode("append").parquet(f"{folder}/files")
        stream = spark.readStream.schema(FILES).parquet(f"{folder}/files")
        rescan.rescan_replaced(stream, f"{folder}/store", f"{folder}/progress", rescan.scan_versions(RULES)).awaitTermination()
    return rows(rescan.current_findings(spark, f"{folder}/store"), "path", "detector", "line")


def test_only_changes_are_scanned_and_replace_findings(spark, folder):
    a1, a2 = "bad\nfine\nbad @", "fine\nbad"
    found = scanned(spark, folder, [("p", "a", a1, 1), ("p", "b", "@", 1), ("p", "c", "fine", 1)])
    assert found == [("a", "bad", 1), ("a", "bad", 3), ("a", "mail", 3), ("b", "mail", 1)]
    found = scanned(spark, folder, [("p", "a", a1, 2), ("p", "b", None, 2)], [("p", "a", a2, 3), ("p", "c", "fine", 2)])
    assert found == [("a", "bad", 2)]
    # Of three arrivals of a, one unchanged, two are scanned; c never changes.
    assert rows(rescan.scans(spark, f"{folder}/store"), "path", "version", "deleted") == [("a", 1, False), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("c", 1, False)]
    # Of several versions of a path at once the newest counts; an old one changes nothing.
    found = scanned(spark, folder, [("p", "a", "fine", 5), ("p", "a", "@", 4), ("p", "c", "bad", 0), ("p", "b", "@", None)])
    assert found == []
    found = scanned(spark, folder, [("p", "b", "@", 3), ("q", "d", "", None)])
    assert found == [("b", "mail", 1)]


def test_a_replayed_batch_changes_nothing(spark, folder):
    before = scanned(spark, folder, [("p", "a", "bad", 1)], [("p", "a", "@", 2), ("p", "b", "bad\nbad", 1)])
    store = f"{folder}/store"
    newest = rescan.scans(spark, store).agg(F.max("batch")).first()[0]
    batch = spark.read.schema(FILES).parquet(f"{store}/versions/batch={newest}")
    kept = spark.createDataFrame(batch.collect(), FILES)
    sink = rescan.replace_findings(store, rescan.scan_versions(RULES))
    for _ in range(2):
        sink(kept, newest)
    assert rows(rescan.current_findings(spark, store), "path", "detector", "line") == before
    assert rescan.scans(spark, store).count() == 3


def test_a_compacted_store_goes_on(spark, folder):
    before = scanned(spark, folder, [("p", "a", "bad", 1), ("p", "b", "@", 1)], [("p", "a", "bad\nbad", 2)])
    rescan.compact(spark, f"{folder}/store", f"{folder}/store2")
    assert rows(rescan.current_findings(spark, f"{folder}/store2"), "path", "detector", "line") == before
    assert rescan.scans(spark, f"{folder}/store2").count() == 2
    stream = spark.readStream.schema(FILES).parquet(f"{folder}/files")
    spark.createDataFrame([("p", "a", "@", 3)], FILES).write.mode("append").parquet(f"{folder}/files")
    rescan.rescan_replaced(stream, f"{folder}/store2", f"{folder}/progress", rescan.scan_versions(RULES)).awaitTermination()
    assert rows(rescan.current_findings(spark, f"{folder}/store2"), "path", "detector", "line") == [("a", "mail", 1), ("b", "mail", 1)]


def test_paths_share_state_and_batches(spark, folder, monkeypatch):
    monkeypatch.setattr(rescan, "PATH_BUCKETS", 3)
    first = [("p", f"f{i}", "@" if i % 2 else "fine", 1) for i in range(40)]
    scanned(spark, folder, first)
    assert spark.read.format("statestore").option("stateVarName", "known").load(f"{folder}/progress").select("key").distinct().count() <= 3
    found = scanned(spark, folder, [(p, f, "fine" if i < 4 else c, 2) for i, (p, f, c, _) in enumerate(first)] + [("p", None, "@", 1)])
    assert found == sorted((f"f{i}", "mail", 1) for i in range(5, 40, 2))
    assert rows(rescan.scans(spark, f"{folder}/store").where("batch = 1"), "path") == [(None,), ("f1",), ("f3",)]
