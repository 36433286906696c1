import datetime
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codescope.operators import outcomes
from codescope.plans import catalog_text  # noqa: F401  (registers queries)
from codescope.plans.catalog import QUERIES
from codescope.plans.projections import Source
from codescope.streaming import jobs

START = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "counts, derived",
    [
        ({"Succeeded": 2}, "CompletedFully"),
        ({"Succeeded": 2, "Skipped": 1}, "CompletedFully"),
        ({"Succeeded": 1, "AlreadySatisfied": 1}, "CompletedWithNoOps"),
        ({"AlreadySatisfied": 1}, "CompletedWithNoOps"),
        ({"Succeeded": 1, "Failed": 1}, "PartialProgress"),
        ({"AlreadySatisfied": 1, "Blocked": 1}, "NoProgress"),
        ({"Failed": 3}, "NoProgress"),
        ({"Skipped": 3}, "NothingToDo"),
    ],
)
def test_derived_outcome(spark, counts, derived):
    data = [("c", o) for o, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(data, "change_id STRING, outcome STRING")
    found = outcomes.outcome_summary(df).collect()[0]
    assert found.outcome == derived and found.attempted == sum(counts.values())


def test_failure_sample_and_filters(spark):
    data = [("c", f"f{i:02}", "m", "Failed", f"r{i % 2}", START) for i in range(14)]
    data += [("c", "g", "m", "Skipped", None, START), ("d", "f00", "m", "Blocked", "r", START)]
    df = spark.createDataFrame(data, "change_id STRING, path STRING, member STRING, outcome STRING, reason STRING, ts TIMESTAMP")
    sample = outcomes.failure_sample(df, ["path"])
    assert sample.where("change_id = 'c'").count() == 10 and sample.where("change_id = 'd'").count() == 1
    assert rows(outcomes.reason_counts(df)) == [("c", "r0", 7), ("c", "r1", 7), ("d", "r", 1)]
    page = outcomes.operation_detail(df, "c", "err", 5).collect()
    assert len(page) == 5 and page[0].total_items == 14 and page[0].has_more
    assert outcomes.operation_detail(df, "c", "file:F0").count() == 10
    assert outcomes.operation_detail(df, "c", "warnings").count() == 1
    assert not outcomes.operation_detail(df, "c").collect()[0].has_more
    with pytest.raises(ValueError):
        outcomes.operation_detail(df, "c", "nonsense")


def _batches(seed, n, with_reset):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        session = rng.choice(["hot", "hot", "hot", "a"])
        shape = rng.choice([(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 2), (3, 1, 1, 0), (0, 0, 1, 1)])
        data.append((session, i, *shape, with_reset and rng.random() < 0.06))
    return data


def _breaker(data):
    state, out = {}, []
    for session, no, ok, failed, rolled, skipped, reset in data:
        s = state.setdefault(session, dict(attempts=0, failures=0, score=0, streak=0, open=False))
        if reset:
            s.update(attempts=0, failures=0, score=0, streak=0, open=False)
        s["attempts"] += ok + failed + rolled + skipped
        s["failures"] += failed + rolled
        s["score"] += 2 * rolled + failed
        if ok:
            s["streak"] = 0
        elif failed + rolled:
            s["streak"] += 1
        rate = s["failures"] / s["attempts"] if s["attempts"] else 0
        s["open"] |= s["streak"] >= 8 or (s["attempts"] >= 20 and rate > 0.30) or s["score"] > 20
        calm = not (s["streak"] >= 4 or (s["attempts"] >= 10 and rate >= 0.15) or s["score"] >= 10)
        severity = "halt" if s["open"] else "ok" if calm else "caution"
        out.append((session, no, s["attempts"], s["failures"], s["score"], s["streak"], s["open"], severity))
    return sorted(out)


COLUMNS = ["session", "batch_no", "attempts", "failures", "score", "streak", "open", "severity"]
BATCHES = "session STRING, batch_no INT, succeeded INT, failed INT, rolled_back INT, skipped INT, reset BOOLEAN"


def test_breaker_against_a_replay(spark):
    for seed, reset in [(1, False), (2, True)]:
        data = _batches(seed, 120, reset)
        df = spark.createDataFrame(data, BATCHES)
        df = df if reset else df.drop("reset")
        found = outcomes.breaker_status(df)
        assert rows(found, *COLUMNS) == _breaker(data)


def test_breaker_thresholds(spark):
    data = [("s", i, 0, 1, 0, 0, False) for i in range(8)]
    found = outcomes.breaker_status(spark.createDataFrame(data, BATCHES)).orderBy("batch_no").collect()
    assert [r.severity for r in found] == ["ok"] * 3 + ["caution"] * 4 + ["halt"]


def test_breaker_stream_equals_table(spark, folder):
    data = _batches(4, 90, True)
    arrivals = folder + "/arrivals"
    for start in range(0, 90, 30):
        part = spark.createDataFrame(data[start : start + 30], BATCHES)
        part.coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(part.schema).parquet(arrivals)
        jobs.breaker_stream(stream, folder + "/out", folder + "/progress").awaitTermination()
    assert rows(spark.read.parquet(folder + "/out"), *COLUMNS) == _breaker(data)


def _calls(seed, n, spread):
    rng = random.Random(seed)
    at = sorted(rng.uniform(0, spread) for _ in range(n))
    return [(rng.choice(["t", "t", "u"]), i, START + datetime.timedelta(seconds=round(s, 3))) for i, s in enumerate(at)]


def _limit(data, limits, window):
    seen, out = {}, []
    for tool, i, ts in data:
        queue = [x for x in seen.get(tool, []) if x >= ts - datetime.timedelta(seconds=window)]
        accepted = len(queue) < limits[tool]
        seen[tool] = queue + [ts] if accepted else queue
        out.append((i, accepted))
    return sorted(out)


def test_rate_limit_against_a_replay(spark):
    for seed, n, spread in [(1, 150, 4000), (2, 300, 1200), (3, 80, 9000)]:
        data = _calls(seed, n, spread)
        df = spark.createDataFrame(data, "tool STRING, event_id INT, ts TIMESTAMP")
        found = outcomes.rate_limit(df, {"T": 3}, 2)
        assert rows(found, "event_id", "accepted") == _limit(data, {"t": 3, "u": 2}, 60)


def test_call_exactly_a_window_old_counts(spark):
    at = [0, 60, 61]
    data = [("t", i, START + datetime.timedelta(seconds=s)) for i, s in enumerate(at)]
    df = spark.createDataFrame(data, "tool STRING, event_id INT, ts TIMESTAMP")
    assert rows(outcomes.rate_limit(df, {}, 1), "event_id", "accepted") == [(0, True), (1, False), (2, True)]
    assert rows(outcomes.call_counts(df, {}, 1), "event_id", "calls_before") == [(0, 0), (1, 1), (2, 1)]


def test_crowded_windows_are_not_added_up_per_call(spark):
    """Frames that slide are added up anew for each row, those that grow are not."""
    crowded = spark.range(6_000).select(F.lit("t").alias("tool"), F.col("id").alias("event_id"), F.timestamp_millis(F.col("id") * 5).alias("ts"))
    counted = outcomes.call_counts(crowded, {}, 10, 3).select("event_id", "calls_before")
    assert rows(counted) == [(i, min(i, 600)) for i in range(6_000)]
    assert outcomes.rate_limit(crowded, {}, 10, 3).where("accepted").count() == 10 * 10
    frames = counted._jdf.queryExecution().analyzed().toString()
    assert "specifiedwindowframe" in frames and not re.search(r"specifiedwindowframe\((?!\w+, unboundedpreceding)", frames)


def test_routing(spark):
    failures = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id INT, reason STRING")
    tags = spark.createDataFrame([("A", "x"), ("B", "y")], "reason STRING, tag STRING")
    producers = spark.createDataFrame([("x", "beta", 2), ("x", "alpha", 2), ("x", "aaa", 1)], "tag STRING, tool STRING, weight INT")
    found = rows(outcomes.route_failures(failures, tags, producers), "id", "suggested_tool")
    assert found == [(1, "alpha"), (2, None), (3, None)]


def test_phases(spark):
    data = [("phase:flag below minScore", "Skipped"), ("phase:flag", "Succeeded"), ("phase:bridge event handler", "Failed"), (None, "Failed")]
    df = spark.createDataFrame(data, "reason STRING, outcome STRING")
    found = {r.phase: r for r in outcomes.phase_breakdown(df).collect()}
    assert set(found) == {"flag", "bridge"}
    assert found["flag"].Skipped == 1 and found["flag"].below_threshold == 1 and found["bridge"].event_handler == 1


def test_ledger(spark):
    data = [("f", "m", "flag", 0), ("f", "m", "bridge", 5), ("f", "n", "flag", 1)]
    df = spark.createDataFrame([(p, m, ph, START + datetime.timedelta(seconds=s)) for p, m, ph, s in data], "path STRING, member STRING, phase STRING, ts TIMESTAMP")
    assert rows(outcomes.ledger(df), "member", "hits") == [("m", 2), ("n", 1)]
    assert rows(outcomes.ledger(df, phase="bridge"), "member", "hits") == [("m", 2)]
    assert outcomes.ledger(df, repeated_only=True).count() == 1
    assert rows(outcomes.ledger_totals(df)) == [(2, 3, 1)]
    numbered = outcomes.ledger_operations(df)
    assert rows(numbered, "member", "phase", "operation_no") == [("m", "bridge", 2), ("m", "flag", 1), ("n", "flag", 1)]


def _stream(spark, folder, df):
    df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_debounce(spark, folder):
    at = [("a.cs", 0.0), ("b.cs", 0.4), ("a.cs", 0.8), ("c.cs", 1.5), ("obj/x.cs", 1.6), ("own.cs", 3.0), ("late.cs", 100.0)]
    at[4] = ("src/obj/x.cs", 1.6)
    data = [("p", p, START + datetime.timedelta(seconds=s)) for p, s in at]
    df = spark.createDataFrame(data, "project STRING, path STRING, ts TIMESTAMP")
    written = spark.createDataFrame([("own.cs", START + datetime.timedelta(seconds=1))], "path STRING, written_at TIMESTAMP")
    stream = jobs.debounce_changes(_stream(spark, folder + "/in", df), written=written)
    found = jobs.run_to_table(stream, "test")
    assert sorted(r.n_changes for r in found.collect()) == [1, 3]
    clean = df.where("path NOT LIKE '%obj%' AND path <> 'own.cs'")
    paths = jobs.changed_paths(clean, found)
    assert rows(paths, "path") == [("a.cs",), ("b.cs",), ("c.cs",)]


def test_ledger_stream_counts_an_event_once(spark, folder):
    data = [(1, "m", 0), (1, "m", 0), (2, "m", 10), (3, "n", 20), (4, "n", 3 * 86400)]
    df = spark.createDataFrame([(i, m, START + datetime.timedelta(seconds=s)) for i, m, s in data], "event_id INT, member STRING, ts TIMESTAMP")
    found = jobs.run_to_table(jobs.ledger_stream(_stream(spark, folder + "/in", df)), "test")
    assert rows(found, "member", "hits") == [("m", 2), ("n", 1)]


def test_rescan_of_arriving_files(spark, folder):
    schema = "project STRING, path STRING, content STRING"
    first = spark.createDataFrame([("p", "a.cs", "x\nlock(this)")], schema)
    out = folder + "/found"
    for df in (first, spark.createDataFrame([("p", "b.cs", "Thread.Sleep(1)")], schema)):
        findings = jobs.rescan_changed(_stream(spark, folder + "/in", df))
        jobs.append_to_parquet(findings, out, folder + "/progress").awaitTermination()
    found = spark.read.parquet(out)
    assert rows(found, "path", "line", "detector") == [("a.cs", 2, "lock_this"), ("b.cs", 1, "blocking_calls_in")]


def test_streamed_table_is_one_file_or_a_folder_of_parts(spark, folder):
    file = Source(spark, "/root/testdata/sf0.001")
    file.table("documents").repartition(3).write.parquet(f"{folder}/documents.parquet")
    counts = [jobs.run_to_table(t.stream("documents").select("doc_id"), "docs").count() for t in (file, Source(spark, folder))]
    assert counts == [200, 200]
    arrived = QUERIES["O11_rescan_changed_stream"](spark, folder)
    assert rows(arrived, "detector", "path", "line") == rows(QUERIES["T1_rule_scan"](spark, folder), "detector", "path", "line")
