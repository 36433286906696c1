import re
import time

import pytest
from conftest import rows

from codescope.operators import clones, metrics, rule_table, snapshots, text_rules
from codescope.operators.rulepack import RULES
from codescope.plans.catalog_detectors import COUNTS
from codescope.plans.detectors import all_detectors
from codescope.plans.registry import Detector, catalogue, run_detectors

LINES = "project STRING, path STRING, line_no INT, text STRING"


def _lines(spark, texts, path="f.cs"):
    return spark.createDataFrame([("p", path, i, t) for i, t in enumerate(texts)], LINES)


# One text that each rule must find, and one it must leave alone.
SAMPLES = {
    "task_void_usage": ("private async void Go()", "async Task Go()"),
    "blocking_calls_in": ("var x = t.Result;", "Task.WaitAll(); t.Results.Add(1);"),
    "task_yield_usage": ("await Task.Yield();", "yield return 1;"),
    "task_delay_usage": ("Task.Delay(10)", "Task.Delay(0)"),
    "task_delay_zero_usage": ("Task.Delay(0)", "Task.Delay(01)"),
    "task_run_in": ("await Task.Run(() => 1)", "Task.Run(() => 1)"),
    "empty_catch_blocks": ("try { } catch (Exception e)\n{\n}", "catch { Log(); }"),
    "reflection_usage": ("t.GetMethod(x)", "GetMethodology()"),
    "inefficient_string_comparisons": ("a.ToLower() == b", "a.ToLower().Trim()"),
    "weak_hash": ("MD5.Create()", "SHA256.Create()"),
    "generic_exception": ("throw new Exception(x)", "throw new ArgumentException(x)"),
    "lock_this": ("lock (this) {", "lock (gate) {"),
    "wall_clock": ("var n = DateTime.UtcNow;", "DateTime.Parse(x)"),
    "linq_redundant_where": ("x.Where(y => y.Ok).First()", "x.Where(y => y.Ok).ToList()"),
    "sql_injection": ('db.Execute($"delete {x}")', 'db.Execute("delete")'),
    "legacy_guard": ("if (x == null) throw new ArgumentNullException(nameof(x));", "throw new ArgumentNullException();"),
}


def test_every_rule_has_a_hit_and_a_miss(spark):
    assert set(SAMPLES) == {r.id for r in RULES}
    for rule in RULES:
        hit, miss = SAMPLES[rule.id]
        if rule.whole_file:
            files = spark.createDataFrame([("p", "hit.cs", hit), ("p", "miss.cs", miss), ("p", "aTests.cs", hit)], "project STRING, path STRING, content STRING")
            assert rows(text_rules.file_scan(files, [rule]), "path") == [("hit.cs",)]
        else:
            assert rows(text_rules.rule_scan(_lines(spark, [hit, miss]), [rule]), "line") == [(0,)], rule.id


def test_rules_in_one_pass(spark):
    found = text_rules.rule_scan(_lines(spark, ["Thread.Sleep(1); lock(this)", "nothing"]))
    assert rows(found, "detector", "line") == [("blocking_calls_in", 0), ("lock_this", 0)]


def test_todo_words(spark):
    texts = ["// todo later", "// DEBUGGING", "x // HACK and BUG", "BUG = 1;", "/* note */"]
    texts[0] += " \t\r"
    found = text_rules.todo_scan(_lines(spark, texts))
    assert rows(found, "kind", "line_no") == [("BUG", 2), ("NOTE", 4), ("TODO", 0)]
    assert found.where("kind = 'TODO'").first().comment == "// todo later"


def test_secrets(spark):
    texts = [
        'var dbPassword = "hunter2";', 'password = "abc"', 'conn = "Server=x;Pwd=secret1;"', 'conn = "Pwd=abc@host"',
        'k = "ghp_12345678"', 'x = "eyJ' + "a" * 30 + "." + "b" * 20 + '.c"', 'apiKey = "' + "aB3" * 11 + '"',
        "// the token is 12", 'name = "just text here"',
        'token = "eyJ' + "aB3" * 11 + '"',  # opens like a web token, but isn't one
    ]
    found = rows(text_rules.secret_scan(_lines(spark, texts)), "line_no", "class", "reason")
    assert found == [
        (0, "HardcodedSecret", "credential name"),
        (2, "HardcodedSecretValue", "connection string with embedded password"),
        (4, "HardcodedSecretValue", "API key"),
        (5, "HardcodedSecretValue", "JWT token"),
        (6, "HardcodedSecret", "credential name"),
        (6, "HardcodedSecretValue", "high-entropy secret value"),
        (7, "SecretInComment", "mark of a secret"),
        (9, "HardcodedSecret", "credential name"),
        (9, "HardcodedSecretValue", "high-entropy secret value"),
    ]


def test_literals(spark):
    values = ["C:\\x", "\\\\share", "a/b", "plain", "(a+)+", "(a|b)+", "x.*.+y", "(a*|b)*", "[ab]+"]
    df = spark.createDataFrame([(v,) for v in values], "value STRING")
    assert text_rules.path_literals(df).count() == 3
    found = dict(rows(text_rules.redos_scan(df), "value", "signal"))
    assert found == {
        "(a+)+": "nested_quantifier", "(a|b)+": "quantified_alternation", "x.*.+y": "adjacent_wildcards", "(a*|b)*": "quantifier_in_alternation"
    }


def test_names(spark):
    definitions = spark.createDataFrame(
        [
            ("1", "_ok", "field", "private", ["readonly"], ""), ("2", "bad", "field", "private", [], ""), ("3", "Max", "field", "private", ["const"], ""),
            ("4", "run", "method", "public", [], "void"), ("5", "run", "method", "private", [], "void"), ("6", "Load", "method", "public", [], "Task<int>"),
            ("7", "OnLoad", "method", "public", ["async"], "Task"), ("8", "NowAsync", "method", "public", [], "int"), ("9", "TaskList", "method", "public", [], "Tasks"),
        ],
        "symbol_id STRING, name STRING, kind STRING, accessibility STRING, modifiers ARRAY<STRING>, return_type STRING",
    )
    parameters = spark.createDataFrame([("6", "Upper", ""), ("6", "Self", "this"), ("6", "lower", "")], "symbol_id STRING, name STRING, modifier STRING")
    assert rows(text_rules.naming_violations(definitions, parameters), "name", "rule") == [
        ("Upper", "parameter"), ("bad", "private_field"), ("run", "method")
    ]
    assert rows(text_rules.async_suffix_violations(definitions), "symbol_id", "rule") == [("6", "missing_suffix"), ("8", "needless_suffix")]
    handlers = spark.createDataFrame([("6",)], "symbol_id STRING")
    assert text_rules.async_suffix_violations(definitions, handlers).count() == 1


def test_dedupe_by_risk(spark):
    df = spark.createDataFrame(
        [("k", 5, "m", "Low", "a"), ("k", 5, "m", "High", "b"), ("k", 2, "m", "Low", "c"), ("j", 9, "m", "High", "d")],
        "kind STRING, line INT, member STRING, risk STRING, note STRING",
    )
    found = text_rules.dedupe_rank(df, ["High", "Low"])
    assert rows(found, "note", "risk") == [("b", "High"), ("c", "Low"), ("d", "High")]
    assert rows(text_rules.risk_counts(df, ["High", "Low"])) == [("High", 2), ("Low", 1)]


def test_registry(spark):
    lines = _lines(spark, ["lock(this)"])
    known = [
        Detector("locks", "structure", "Warning", ("lines",), lambda d: text_rules.rule_scan(d)),
        Detector("branches", "size", "Info", ("lines",), lambda d: metrics.complexity(d).withColumnRenamed("complexity", "score")),
    ]
    both = run_detectors({"lines": lines}, known)
    assert rows(both, "detector", "severity", "path", "score") == [("branches", "Info", "f.cs", 1), ("locks", "Warning", "f.cs", None)]
    assert run_detectors({"lines": lines}, known, domain="size").count() == 1
    assert catalogue(spark, known).count() == 2
    with pytest.raises(LookupError):
        run_detectors({"lines": lines}, known, ids=["none"])


API = "kind STRING, container STRING, signature STRING"


def test_breaking_changes(spark):
    before = spark.createDataFrame(
        [("Type", "A", "class A"), ("Method", "A", "int F()"), ("Type", "B", "class B"), ("Method", "B", "void G()"), ("Type", "C", "class C"), ("Method", "C", "void H()")], API
    )
    after = spark.createDataFrame([("Type", "A", "class A"), ("Method", "A", "int F2()"), ("Type", "C", "class C : D"), ("Method", "C", "void H()")], API)
    assert rows(snapshots.breaking_changes(before, after)) == [
        ("MemberRemovedOrRenamed", "A", "int F()"), ("TypeRemoved", "B", "class B"), ("TypeSignatureChanged", "C", "class C")
    ]
    assert snapshots.breaking_changes(before, before).count() == 0


def _files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path STRING, content STRING")


def test_drift_and_line_diff(spark):
    before = _files(spark, a="1\n2\n3", b="x", c="same")
    after = _files(spark, a="1\nnew\n2\n3", c="same", d="y")
    assert rows(snapshots.content_drift(before, after)) == [("a", "changed"), ("b", "removed"), ("d", "added")]
    found = rows(snapshots.line_diff(before, after), "path", "line_no", "removed", "added")
    # Positional: everything after the inserted line differs.
    assert found == [("a", 2, "2", "new"), ("a", 3, "3", "2"), ("a", 4, None, "3"), ("b", 1, "x", None), ("d", 1, None, "y")]


def test_rewrite(spark, folder):
    files = _files(spark, a="foo(foo, food)", b="none", c="v1.0")
    found = snapshots.bulk_rewrite(files, [("rename", "foo", "$bar"), ("regex", r"v(\d)", "w$1")])
    assert rows(found, "path", "new_content", "replacements") == [("a", "$bar($bar, food)", 2), ("c", "w1.0", 1)]
    snapshots.write_snapshot(found, files, folder + "/next")
    assert rows(spark.read.parquet(folder + "/next"), "path", "content") == [("a", "$bar($bar, food)"), ("b", "none"), ("c", "w1.0")]
    same = snapshots.bulk_rewrite(files, [("rename", "none", "none")]).collect()
    assert same[0].outcome == "AlreadySatisfied"
    with pytest.raises(ValueError):
        snapshots.bulk_rewrite(files, [("regex", "(a+)+", "")], refuse_backtracking=True)
    plan = snapshots.bulk_rewrite(files, [("regex", "(foo|none)+", "x")], dry_run=True)
    assert rows(plan, "path", "replacements", "outcome") == [("a", 3, "Succeeded"), ("b", 1, "Succeeded")]


def test_every_detector_is_registered_once():
    ids = [d.id for d in all_detectors()]
    assert len(ids) == len(set(ids)) == 55 and set(ids) == set(COUNTS)


def test_null_content_on_both_sides_is_no_change(spark):
    before = _files(spark, a=None, b=None, c="x")
    after = _files(spark, a=None, b="x", d=None)
    assert rows(snapshots.content_drift(before, after)) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_complexity(spark):
    lines = _lines(spark, ["if (a && b || c) {", "x = y ? 1 : 2; iffy", "foreach (var z in q)"])
    assert rows(metrics.complexity(lines), "complexity") == [(6,)]
    units = spark.createDataFrame([("u", 1, "if"), ("u", 2, "call")], "unit_id STRING, ord INT, shape STRING")
    assert rows(metrics.complexity_of_units(units, ["if"])) == [("u", 2)]


def test_windows_of_shapes_with_commas_are_kept_apart(spark):
    shapes = {"u1": ["a,b", "c", "d", "return"], "u2": ["a", "b,c", "d", "return"], "u3": ["a,b", "c", "d", "return"]}
    units = spark.createDataFrame([(u, "t", i + 1, s) for u, all_ in shapes.items() for i, s in enumerate(all_)], "unit_id STRING, container STRING, ord INT, shape STRING")
    for most in (4, None):
        found = clones.duplicate_windows(units, 4, most)
        assert rows(found, "unit_id", "has_exit", "preview") == [("u1", True, "a,b c d return"), ("u3", True, "a,b c d return")]


def test_blank_literals_of_any_kind_are_left_out(spark):
    literals = spark.createDataFrame([("\t\t\t", "p", i) for i in range(4)] + [("abc", "p", i) for i in range(4)], "text STRING, path STRING, line_no INT")
    assert rows(clones.repeated_literals(literals), "text") == [("abc",)]


def test_api_history_and_as_of(spark):
    data = [("C", "a", s) for s in (1, 2, 4, 4, 9)] + [("C", None, 2), ("D", "b", None), ("D", "b", 6), ("D", "b", 9)]
    history = snapshots.api_history(spark.createDataFrame(data, "container STRING, signature STRING, snapshot INT"))
    assert rows(history, "container", "signature", "valid_from", "valid_to", "n_snapshots") == [
        ("C", None, 2, 4, 1), ("C", "a", 1, 6, 3), ("C", "a", 9, None, 1), ("D", "b", 6, None, 2)
    ]
    probes = spark.createDataFrame(
        [(1, "C", "a", 0), (2, "C", "a", 1), (3, "C", "a", 8), (3, "C", "a", 8), (4, "C", "a", 99), (5, "C", None, 5), (6, "X", "a", 5), (7, "C", "a", None)],
        "id INT, container STRING, signature STRING, at INT",
    )
    found = snapshots.as_of(probes, history).selectExpr("id", "found.valid_from AS a", "found.valid_to AS b")
    assert rows(found, "id", "a", "b") == [
        (1, None, None), (2, 1, 6), (3, 1, 6), (3, 1, 6), (4, 9, None), (5, None, None), (6, None, None), (7, None, None)
    ]


def test_as_of_inside_a_cut_key(spark):
    """One key with nearly all versions and probes, against a plain search."""
    versions = [("hot", 3 * i, f"v{i % 5}") for i in range(2000)] + [("hot", 30, "w"), ("b", 5, "x")]
    probes = [(i, "hot" if i % 9 else "b", (i * 37) % 6100 - 20) for i in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = snapshots.as_of(
            spark.createDataFrame(probes, "id INT, path STRING, at INT"),
            spark.createDataFrame(versions, "path STRING, since INT, digest STRING"), ["path"], "at", "since",
        )
        got = {r.id: r.found and tuple(r.found) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for i, key, at in probes:
        assert got[i] == max(((s, d) for k, s, d in versions if k == key and s <= at), default=None)


def test_rule_table(spark):
    texts = ["int ab = Foo.Bar(1);", "foo.bar", "x", None, "", "Foo.Bar Foo.Baz", "ä Foo.Bar("] * 2
    lines = _lines(spark, texts)
    rules = [("call", "Foo.Bar(", r"Foo\.Bar\("), ("short", "x", "^x$"), ("two", "Ba", r"Ba[rz].*Ba[rz]"), ("none", "qq", "qq"), ("null", "Foo", None), ("call", "Foo.Bar(", r"Foo\.Bar\(")]
    found = rule_table.rule_table_scan(lines, spark.createDataFrame(rules, "rule STRING, literal STRING, regex STRING"))
    expected = {(r, i) for r, lit, regex in rules if regex for i, t in enumerate(texts) if t and lit in t and re.search(regex, t)}
    assert rows(found, "rule", "line_no") == sorted(expected)
    with pytest.raises(ValueError):
        rule_table.rule_table_scan(lines, spark.createDataFrame([("r", "", "x")], "rule STRING, literal STRING, regex STRING"))
    assert rule_table.rule_table_scan(lines, spark.createDataFrame([], "rule STRING, literal STRING, regex STRING")).count() == 0


def test_rule_table_reads_long_lines_once(spark):
    """Time grows with a line's length, not with its square: this took minutes."""
    text = "".join(f"w{i} ä\U0001f600" for i in range(60_000)) + " Foo.Bar("
    rules = spark.createDataFrame([("call", "Foo.Bar(", r"Foo\.Bar\("), ("face", "1 ä\U0001f600w2", "w2")], "rule STRING, literal STRING, regex STRING")
    began = time.monotonic()
    found = rule_table.rule_table_scan(_lines(spark, [text, "short"]), rules)
    assert rows(found, "rule", "line_no") == [("call", 0), ("face", 0)]
    assert time.monotonic() - began < 60
