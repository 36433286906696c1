import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codescope.operators import metrics, search
from codescope.plans import catalog_search  # noqa: F401  (registers its queries)
from codescope.plans.catalog import QUERIES

LINES = "project STRING, path STRING, line_no INT, text STRING"


def test_search_first_match_and_preview(spark):
    long = "  " + "x" * 119 + "Needle needle"
    lines = spark.createDataFrame([("p", "b", 1, "no"), ("p", "b", 2, "a NEEDLE, needle"), ("p", "a", 9, long)], LINES)
    found = search.text_search(lines, "needle").collect()
    assert [(r.path, r.line_no, r.column_no) for r in found] == [("a", 9, 122), ("b", 2, 3)]
    assert found[0].preview == "x" * 119 + "N…" and found[1].preview == "a NEEDLE, needle"
    assert search.text_search(lines, "needle", max_results=1).count() == 1
    assert search.text_search(lines, r"n\w+e,", is_regex=True, glob="b").count() == 1


def test_all_matching_lines_without_a_page(spark):
    lines = spark.range(1_200_000).selectExpr("'p' AS project", "'f' AS path", "CAST(id AS INT) AS line_no", "'a @ b' AS text")
    found = search.matching_lines(lines, "@")
    assert found.count() == 1_200_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan


def test_enclosing_member_query_has_no_page(spark, monkeypatch):
    """Its hits are all matching lines, not a page of a search."""
    monkeypatch.delattr(search, "text_search")
    assert QUERIES["Q1_enclosing_member"](spark, "/root/testdata/sf0.001").columns == ["path", "line_no", "member", "inner_member"]


def test_callers_need_a_known_name(spark):
    definitions = spark.createDataFrame(
        [("m1", "Run", "A"), ("m2", "Run", "B"), ("c", "Main", "P")], "symbol_id STRING, name STRING, container STRING"
    )
    references = spark.createDataFrame(
        [("m1", "c", "f", 1, " x "), ("m2", "c", "f", 1, "y"), ("m2", "q", "f", 2, "z")],
        "symbol_id STRING, caller_id STRING, path STRING, line INT, text STRING",
    )
    found = search.find_callers(references, definitions, "Run")
    assert rows(found, "path", "line", "symbol_id", "caller_name", "text") == [
        ("f", 1, "m1", "Main", "x"), ("f", 2, "m2", None, "z")
    ]
    assert search.find_callers(references, definitions, "Run", container="A").count() == 1
    with pytest.raises(LookupError):
        search.find_callers(references, definitions, "Walk")


def test_attribute_names(spark):
    df = spark.createDataFrame(
        [("1", "method", "M", "T", "f", 1, ["FooAttribute", "Bar"]), ("2", "type", "T", "", "f", 0, ["Foo"])],
        "symbol_id STRING, kind STRING, name STRING, container STRING, path STRING, line INT, attributes ARRAY<STRING>",
    )
    for spelled in ("[Foo]", "Foo", "FooAttribute"):
        assert search.attribute_usages(df, spelled).count() == 2
    assert search.attribute_usages(df, "Foo", kind="type").count() == 1


def test_parameter_rules_at_their_bounds(spark):
    definitions = spark.createDataFrame(
        [("a", "A", "method", "f", 1), ("b", "B", "constructor", "f", 2), ("c", "C", "constructor", "f", 3), ("d", "D", "method", "f", 4)],
        "symbol_id STRING, name STRING, kind STRING, path STRING, line INT",
    )
    data = [("a", i, f"p{i}", "int", "") for i in range(4)]
    data += [("b", i, f"p{i}", "IFooService", "") for i in range(5)]
    data += [("c", i, f"p{i}", "IFooService" if i else "int", "") for i in range(4)]
    data += [("d", i, f"p{i}", "int", "params" if i == 2 else "") for i in range(3)]
    parameters = spark.createDataFrame(data, "symbol_id STRING, ord INT, name STRING, type STRING, modifier STRING")
    assert rows(metrics.long_parameter_lists(parameters, definitions), "symbol_id") == [("a",), ("c",)]
    assert rows(metrics.repeated_parameter_types(parameters), "symbol_id", "n_parameters") == [("a", 4)]


def test_line_span_is_strict(spark):
    df = spark.createDataFrame(
        [("a", "A", "type", "", "f", 1, 501), ("b", "B", "type", "", "f", 1, 502), ("c", "C", "method", "", "f", 1, 900)],
        "symbol_id STRING, name STRING, kind STRING, container STRING, path STRING, line INT, end_line INT",
    )
    assert rows(metrics.large_units(df, ["type"], 500), "symbol_id", "n_lines") == [("b", 501)]


def _usage(spark, usage):
    data = [(t, m, f) for (t, m), fields in usage.items() for f in (fields or [None])]
    return spark.createDataFrame(data, "type_id STRING, method STRING, field STRING")


def test_cohesion_against_pairs(spark, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(metrics, "_CHUNK", 62 * 2)  # several chunks per type
    usage = {}
    for t, n_methods, n_fields in [("A", 1, 2), ("B", 9, 6), ("C", 300, 40), ("D", 5, 3)]:
        for m in range(n_methods):
            usage[t, f"m{m}"] = {f"f{random.randrange(n_fields)}" for _ in range(random.randint(0, 3))}
    usage["D", "m0"] = usage["D", "m1"] = set()
    found = {r.type_id: r for r in metrics.cohesion_lcom(_usage(spark, usage)).collect()}
    for t in "ABCD":
        sets = [fields for (owner, _), fields in usage.items() if owner == t]
        pairs = list(itertools.combinations(sets, 2))
        q = sum(bool(a & b) for a, b in pairs)
        assert (found[t].pairs_sharing, found[t].pairs_apart) == (q, len(pairs) - q)
        assert found[t].lcom == (round((len(pairs) - q) / len(pairs), 4) if pairs else 0.0)


def test_cohesion_ratings(spark):
    # One pair apart out of five pairs is not possible; 2 of 10 pairs apart gives exactly 0.2.
    usage = {("T", f"m{i}"): {"x"} for i in range(4)}
    usage["T", "m4"] = {"x", "y"}
    rating = {r.type_id: r.rating for r in metrics.cohesion_lcom(_usage(spark, usage)).collect()}
    assert rating == {"T": "Excellent"}
    apart = {("T", "m0"): {"x"}, ("T", "m1"): {"y"}, ("U", "m0"): {"x"}}
    rating = {r.type_id: r.rating for r in metrics.cohesion_lcom(_usage(spark, apart)).collect()}
    assert rating == {"T": "Very Poor", "U": "Excellent"}


def test_cohesion_components(spark):
    usage = {("T", "a"): {"x"}, ("T", "b"): {"x", "y"}, ("T", "c"): {"z"}, ("T", "d"): set(), ("U", "a"): {"x"}, ("U", "b"): {"x"}}
    found = metrics.cohesion_components(_usage(spark, usage))
    assert rows(found, "type_id", "component", "n_components", "member_kind", "member") == [
        ("T", "a", 3, "field", "x"), ("T", "a", 3, "field", "y"), ("T", "a", 3, "method", "a"), ("T", "a", 3, "method", "b"),
        ("T", "c", 3, "field", "z"), ("T", "c", 3, "method", "c"), ("T", "d", 3, "method", "d"),
    ]


def test_score_buckets_are_closed_above_and_all_present(spark):
    data = [("p", "C", "x", str(i), s) for i, s in enumerate([-1, 0, 25, 26, 50, 51])]
    df = spark.createDataFrame(data, "pattern STRING, class_name STRING, project STRING, member STRING, score INT")
    found = {r.key: r.n for r in metrics.score_summary(df).where("dimension = 'bucket'").collect()}
    assert found == {"<0": 1, "0-25": 2, "26-50": 2, "51-75": 1, "76plus": 0}
    summary = {r.key: r.n for r in metrics.score_summary(df, min_score=26).where("dimension = 'summary'").collect()}
    assert summary == {"total": 3, "min_score": 26, "max_score": 51, "classes_truncated": 0}
    assert metrics.top_candidates(df, top_n=6).count() == 6


def test_candidate_scores(spark):
    df = spark.createDataFrame(
        [("a", "x.Wait();", "OrderService"), ("b", "new SqlCommand()", "C"), ("c", "SqlCommand; t.Result", "C"), ("d", "t.Result; // later", "C")],
        "name STRING, body STRING, class_name STRING",
    )
    signals = metrics.method_signals(F.col("body"), F.col("class_name"))
    found = metrics.score_candidates(
        df, signals, requires_one_of={"sql-access": ["calls-CommonSearch", "blocking-calls"]}
    )
    assert rows(found, "name", "score", "flagged") == [("a", 55, True), ("c", 65, True), ("d", 0, False)]


def test_severity_report_keeps_errors_first(spark):
    data = [("p", "f", i, "CS0001", s) for i, s in enumerate(["Warning", "Hidden", "Error", "Info", "Error"])]
    data.append(("Blazor", "f", 9, "CS0103", "Error"))
    df = spark.createDataFrame(data, "project STRING, path STRING, line INT, id STRING, severity STRING")
    found = metrics.severity_report(df, 3, flagged_project=F.lower("project").contains("blazor")).collect()
    assert [r.severity for r in found] == ["Error", "Error", "Warning"]
    assert found[0].total_errors == 2 and found[0].total_warnings == 1
