import random

from conftest import rows
from pyspark.sql import functions as F

from codescope import session
from codescope.operators import relational


def test_unused_definitions(spark):
    definitions = spark.createDataFrame(
        [
            ("m", "method", "T", "private"), ("n", "method", "T", "private"), ("p", "method", "T", "public"),
            ("c1", "constructor", "T", "public"), ("c2", "constructor", "T", "public"), ("only", "constructor", "U", "public"),
            ("written", "local", "T", ""), ("read", "local", "T", ""),
        ],
        "symbol_id STRING, kind STRING, container STRING, accessibility STRING",
    )
    references = spark.createDataFrame(
        [("n", "call"), ("c1", "create"), ("written", "write"), ("read", "read")], "symbol_id STRING, ref_kind STRING"
    )
    found = relational.unused_definitions(definitions, references)
    assert rows(found, "symbol_id") == [("c2",), ("m",), ("written",)]


def test_services(spark):
    parameters = spark.createDataFrame(
        [
            ("A", "Ns.IClock", "A.cs"), ("A", "IEnumerable<IFoo>", "A.cs"), ("A", "ILogger<A>", "A.cs"), ("A", "string", "A.cs"),
            ("A", "orderservice", "A.cs"), ("A", "Iris", "A.cs"), ("A", "IMissing", "src/Acme.Tests/A.cs"), ("A", "IGone", "src/Acme.Tests.Unit/A.cs"), ("A", "ILost", "ATests.cs"), ("A", "IRepo<int>", "A.cs"),
        ],
        "consumer STRING, type STRING, path STRING",
    )
    registrations = spark.createDataFrame(
        [("X.irepo", "Repo"), ("IOther", "OrderService<T>")], "service STRING, implementation STRING"
    )
    assert rows(relational.unregistered_services(parameters, registrations), "type") == [("ILost",), ("Ns.IClock",)]


def test_captive_dependencies_take_the_first_registration(spark):
    parameters = spark.createDataFrame([("S", "D"), ("S", "E"), ("D", "E")], "consumer STRING, dependency STRING")
    registrations = spark.createDataFrame(
        [("S", "Singleton", 1), ("S", "Scoped", 2), ("D", "Transient", 1), ("E", "Singleton", 1), ("E", "Scoped", 2)],
        "service STRING, lifetime STRING, ord INT",
    )
    found = relational.captive_dependencies(parameters, registrations)
    assert rows(found, "consumer", "dependency", "dependency_lifetime") == [("S", "D", "Transient")]


def test_layers(spark):
    imports = spark.createDataFrame(
        [
            ("App.controllers.X", "App.Data", "a", 1), ("App.Controllers", "App.Services.Data", "a", 2),
            ("App.Services", "App.Repositories", "b", 1), ("App.Services", "App.migrations.V1", "b", 2), ("App", "App.Data", "c", 1),
        ],
        "namespace STRING, imported STRING, path STRING, line INT",
    )
    # The import's first layer segment decides: Services.Data is the service layer.
    assert rows(relational.layer_violations(imports), "path", "line") == [("a", 1), ("b", 2)]


def test_dominant_values(spark):
    df = spark.createDataFrame([("a", "8"), ("b", "8"), ("c", "7"), ("d", None)], "p STRING, v STRING")
    found = relational.dominant_value_outliers(df, "p", "v")
    assert rows(found) == [("c", "7", "8", 2)]
    assert relational.dominant_value_outliers(df.where("v = '8'"), "p", "v").count() == 0
    assert relational.dominant_value_outliers(df.where("p = 'c'"), "p", "v").count() == 0


def test_prefix_threshold(spark):
    names = [f"Acme.P{i}" for i in range(2)] + ["Other.X", "Odd"]
    df = spark.createDataFrame([(n,) for n in names], "project STRING")
    assert rows(relational.naming_prefix_outliers(df), "project") == [("Odd",), ("Other.X",)]
    many = spark.createDataFrame([(n,) for n in names + [f"Solo{i}.A" for i in range(9)]], "project STRING")
    assert relational.naming_prefix_outliers(many).count() == 0


def test_missing_cases(spark):
    members = spark.createDataFrame([("E", m) for m in "abc"], "enum_type STRING, member STRING")
    switches = spark.createDataFrame(
        [("s1", "E", False), ("s2", "E", True), ("s3", "E", False), ("s4", "E", False)],
        "switch_id STRING, enum_type STRING, has_default BOOLEAN",
    )
    labels = spark.createDataFrame(
        [("s1", "a"), ("s2", "a"), ("s3", "a"), ("s3", "b"), ("s3", "c"), ("s4", "zzz")], "switch_id STRING, label STRING"
    )
    found = relational.missing_cases(switches, members, labels)
    assert rows(found, "switch_id", "missing") == [("s1", "b"), ("s1", "c"), ("s4", "a"), ("s4", "b"), ("s4", "c")]


def test_names_containing_is_never_broadcast_by_an_estimate(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    names = spark.createDataFrame([(f"test{n}urgent{n}returns",) for n in range(40)], "name STRING")
    parts = spark.createDataFrame([(f"urgent{n}",) for n in range(12)] + [("t",), ("39",)], "part STRING")
    found = relational.names_containing(names, parts)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    expected = [(p[0], n[0]) for p in parts.collect() for n in names.collect() if p[0] in n[0]]
    assert rows(found, "part", "name") == sorted(expected)


def test_names_containing_equals_the_plain_join(spark):
    rng = random.Random(9)
    word = lambda low, high: "".join(rng.choice("abcé") for _ in range(rng.randint(low, high)))
    names = sorted({word(0, 14) for _ in range(150)})
    parts = sorted({word(1, 5) for _ in range(60)})
    found = relational.names_containing(
        spark.createDataFrame([(n,) for n in names], "name STRING"), spark.createDataFrame([(p,) for p in parts], "part STRING")
    )
    assert rows(found, "part", "name") == sorted((p, n) for p in parts for n in names if p in n)


def test_coverage(spark):
    methods = spark.createDataFrame([(1, "Save"), (2, "Load"), (3, "Go"), (4, "Gone")], "symbol_id INT, name STRING")
    tests = spark.createDataFrame([(10, "save_Works"), (11, "Other"), (12, "SAVEGo")], "symbol_id INT, name STRING")
    calls = spark.createDataFrame([(11, "Load"), (11, "load"), (10, "Save"), (99, "Gone")], "src INT, dst STRING")
    found = rows(relational.test_coverage_map(methods, tests, calls))
    assert found == [("go", 12, "name"), ("load", 11, "call"), ("save", 10, "name"), ("save", 12, "name")]
    assert rows(relational.method_coverage(methods, tests, calls), "symbol_id", "n_tests", "has_tests") == [
        (1, 2, True), (2, 1, True), (3, 1, True), (4, 0, False)
    ]


def test_subscriptions(spark):
    df = spark.createDataFrame(
        [("f", "Click", "h", "subscribe"), ("f", "Click", "h", "unsubscribe"), ("g", "Click", "h", "subscribe"), ("f", "Click", "k", "subscribe")],
        "path STRING, event STRING, handler STRING, ref_kind STRING",
    )
    assert rows(relational.unpaired_subscriptions(df), "path", "handler") == [("f", "k"), ("g", "h")]


def test_namespace_reasons(spark):
    files = spark.createDataFrame(
        [
            ("ok.cs", "App.A", "app.a", 1), ("multi.cs", "App", "App", 2), ("global.cs", None, "App", 0), ("folder.cs", "App.X", "App.Y", 1),
            ("dup.cs", "App.X", "App.A", 1), ("p1.cs", "App.P", "App.P", 1), ("p2.cs", "App.Q", "App.Q", 1), ("skip.g.cs", "Z", "App", 1),
        ],
        "path STRING, declared_ns STRING, expected_ns STRING, n_namespaces INT",
    )
    types = spark.createDataFrame(
        [("ok.cs", "Order", False), ("dup.cs", "Order", False), ("folder.cs", "Lone", False), ("p1.cs", "Part", True), ("p2.cs", "part", True)],
        "path STRING, type_name STRING, is_partial BOOLEAN",
    )
    found = relational.namespace_path_mismatches(files, types)
    assert rows(found, "path", "reason", "severity") == [
        ("dup.cs", "DuplicateTypeAtMismatchedPath", "Error"),
        ("folder.cs", "NamespaceFolderMismatch", "Warning"),
        ("global.cs", "GlobalNamespace", "Warning"),
        ("multi.cs", "MultipleNamespacesInFile", "Warning"),
        ("p1.cs", "PartialClassAcrossNamespaces", "Warning"),
    ]
    # The stored files are compared ignoring case, names of types are not.
    exact = files.withColumn("expected_ns", F.when(F.col("path") == "dup.cs", "App.A").otherwise(F.col("expected_ns")))
    assert rows(relational.namespace_conflicts(exact, types)) == [("dup.cs", "Order", "ok.cs")]


def test_expected_namespace(spark):
    df = spark.createDataFrame([("/r/p/A.cs",), ("/r/p/x/y/A.cs",)], "path STRING")
    found = df.select(relational.expected_namespace(F.col("path"), "/r/p", F.lit("Root")))
    assert [r[0] for r in found.collect()] == ["Root", "Root.x.y"]


def test_file_smells(spark):
    df = spark.createDataFrame(
        [("P", "a/One.cs", "One", 1), ("P", "a/Two.cs", "One", 1), ("P", "a/Two.cs", "Two", 9), ("P", "a/X.g.cs", "Y", 1), ("P.AppHost", "h/A.cs", "B", 1)],
        "project STRING, path STRING, name STRING, line INT",
    )
    assert rows(relational.file_structure_smells(df), "path", "smell") == [("a/Two.cs", "MULTI_TYPE"), ("a/Two.cs", "NAME_MISMATCH")]


def test_static_collections(spark):
    definitions = spark.createDataFrame(
        [
            ("grow", "cache", "field", "T", ["static"], "Sys.List<int>"), ("bound", "b", "field", "T", ["static"], "List<int>"),
            ("limited", "c", "field", "U", ["static"], "Queue<int>"), ("limit", "MaxSize", "field", "U", ["const"], "int"),
            ("plain", "d", "field", "T", [], "List<int>"), ("idle", "e", "field", "T", ["static"], "List<int>"),
        ],
        "symbol_id STRING, name STRING, kind STRING, container STRING, modifiers ARRAY<STRING>, return_type STRING",
    )
    references = spark.createDataFrame(
        [("grow", "Add"), ("bound", "Add"), ("bound", "Count"), ("limited", "Enqueue"), ("plain", "Add")], "symbol_id STRING, member STRING"
    )
    assert rows(relational.unbounded_static_collections(definitions, references), "symbol_id") == [("grow",)]


def test_anti_joins_of_many_definitions_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    data = [(i, f"d{i}", ("field", "local", "type", "method")[i % 4], "private", i // 4, [""]) for i in range(400)]
    definitions = spark.createDataFrame(data, "symbol_id INT, name STRING, kind STRING, accessibility STRING, container INT, modifiers ARRAY<STRING>")
    references = spark.createDataFrame([(i, ("read", "write", "create")[i % 3], False) for i in range(300)], "symbol_id INT, ref_kind STRING, in_constructor BOOLEAN")
    unused = [(i,) for i in range(400) if (i % 4 in (0, 3) and i >= 300) or (i % 4 == 1 and (i % 3 or i >= 300))]
    assert rows(relational.unused_definitions(definitions, references), "symbol_id") == unused
    uncreated = [(i,) for i in range(2, 400, 4) if i % 3 != 2 or i >= 300]
    assert rows(relational.uninstantiated_types(definitions, references), "symbol_id") == uncreated
    never = [(i,) for i in range(0, 400, 4) if i % 3 != 1 or i >= 300]
    assert rows(relational.readonly_candidates(definitions, references), "symbol_id") == never
    for found in (relational.uninstantiated_types(definitions, references), relational.readonly_candidates(definitions, references)):
        assert "hashpartitioning(symbol_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan


def test_conflicting_pairs_are_not_shuffled(spark):
    """Nor repeated: not for repeated rows, nor for a type looked for under two names of one owner."""
    files = [("a", "X", "N", 1), ("b", "N", "N", 1), ("c", "N", "N", 1), ("d", "X", "N.M", 1), ("d", "X", "N", 1), ("e", "N.M", "N.M", 1), ("e", "N", "N", 1)]
    files = spark.createDataFrame(files * 2, "path STRING, declared_ns STRING, expected_ns STRING, n_namespaces INT")
    types = spark.createDataFrame([(p, t) for p in "abcde" for t in ("T",)] * 2, "path STRING, type_name STRING")
    found = relational.namespace_conflicts(files, types)
    assert rows(found) == [("a", "T", "b"), ("a", "T", "c"), ("a", "T", "e"), ("d", "T", "b"), ("d", "T", "c"), ("d", "T", "e")]
    usual = relational.namespace_conflicts(files.where("path <> 'd'"), types)
    sides = [line for line in usual._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert len(sides) == 1  # of the pairs under several names
