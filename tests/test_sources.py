import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codescope.functions.text import check_pattern, glob_match
from codescope.session import remove_scratch, scratch_path
from codescope.sources import files, findings_store


def test_read_files_skips_generated_and_build_output(spark, folder):
    wanted = {"Web/Home.cs": "a\nb", "Web/sub dir/O+r.cs": "x"}
    dropped = ["Web/Page.g.cs", "Web/A.Designer.cs", "Web/b.generated.cs", "Web/obj/T.cs", "Core/bin/U.cs"]
    for name, text in [*wanted.items(), *((d, "z") for d in dropped)]:
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as handle:
            handle.write(text)
    found = files.read_files(spark, folder, "*.cs")
    assert rows(found, "project", "path", "content") == [
        ("Web", "Web/Home.cs", "a\nb"),
        ("Web", "Web/sub dir/O+r.cs", "x"),
    ]


def test_lines_are_numbered_from_one(spark):
    df = spark.createDataFrame([("p", "f", "a\n\nb")], "project STRING, path STRING, content STRING")
    assert rows(files.explode_lines(df), "line_no", "text") == [(1, "a"), (2, ""), (3, "b")]


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("*.cs", "src/a/B.cs", True),
        ("*.cs", "src/a/B.csx", False),
        ("src/*.cs", "src/a/B.cs", False),
        ("src/**/*.cs", "src/a/b/B.cs", True),
        ("src/**/*.cs", "src/B.cs", True),
        ("SRC/**", "src/a/b", True),
        ("src/?.cs", "src/a.cs", True),
        ("src/?.cs", "src/ab.cs", False),
        ("a.b", "axb", False),
        ("src\\*.cs", "src\\x.cs", True),
    ],
)
def test_globs(spark, glob, path, hit):
    df = spark.createDataFrame([(path,)], "path STRING")
    assert df.where(glob_match(F.col("path"), glob)).count() == int(hit)


def test_scope_modes(spark):
    df = spark.createDataFrame([("Web", "x/A.cs"), ("Web.Tests", "x/b.cs")], "project STRING, path STRING")
    assert files.scope(df, project="web").count() == 1
    assert files.scope(df, project="web", mode="contains").count() == 2
    assert files.scope(df, path="X/a.CS").count() == 1
    with pytest.raises(ValueError):
        files.scope(df, mode="other")


def test_classify(spark):
    paths = ["a/FooTests.cs", "a/Tests/x.cs", "a/Foo.g.cs", "a/Latest.txt", "a/spec.cs", "a/Foo.cs"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    found = {r.path: (r.is_test, r.is_generated) for r in files.classify_files(df).collect()}
    assert [found[p] for p in paths] == [
        (True, False), (True, False), (False, True), (True, False), (True, False), (False, False)
    ]


def test_projects_of_tests(spark):
    df = spark.createDataFrame([("A",), ("A.Tests",), ("B.benchmarks",), ("Tests.A",)], "project STRING")
    assert rows(files.without_test_projects(df)) == [("A",), ("Tests.A",)]


def test_facts(spark):
    lines = spark.createDataFrame(
        [("p", "f", 1, "using System.Text;"), ("p", "f", 2, 'var x = "a" + "b";'), ("p", "f", 3, "nothing")],
        "project STRING, path STRING, line_no INT, text STRING",
    )
    found = files.extract_facts(lines, files.FACT_PATTERNS)
    assert rows(found, "line_no", "fact_kind", "value") == [
        (1, "import", "System.Text"), (2, "literal", "a"), (2, "literal", "b")
    ]


def test_findings_pages(spark, folder):
    data = [("d1", "dom", "p", "f", i, "m") for i in range(7)] + [("d2", "dom", "p", "f", 0, "m")]
    df = spark.createDataFrame(data, "detector STRING, domain STRING, project STRING, path STRING, line INT, member STRING")
    findings_store.write_findings(df, folder + "/found")
    first = findings_store.read_findings(spark, folder + "/found", "d1", limit=5).collect()
    last = findings_store.read_findings(spark, folder + "/found", "d1", limit=5, offset=5).collect()
    assert [r.line for r in first] == [0, 1, 2, 3, 4] and first[0].has_more and first[0].total_records == 7
    assert [r.line for r in last] == [5, 6] and not last[0].has_more
    exact = findings_store.read_findings(spark, folder + "/found", "d1", limit=5, offset=2).collect()
    assert not exact[0].has_more


def test_risky_patterns_are_refused():
    check_pattern(r"token\s*=")
    for bad in ["(a+)+", "(a|b|c)*", "x.*.*y", "(a+|b)+"]:
        with pytest.raises(ValueError):
            check_pattern(bad)


def test_scratch_tables_are_removed(spark):
    path = scratch_path(spark, "test")
    spark.range(3).write.parquet(path)
    remove_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_pages_of_any_depth(spark, folder):
    """All pages in order, ties and nulls included; a deep page reads as few files as the first."""
    data = [("hot", f"p{i % 7}" if i % 11 else None, "f", i % 50, f"m{i % 3}", i) for i in range(3000)]
    data += [("rare", "p", "f", 1, "m", i) for i in range(3)] + [(None, "p", "f", 1, "m", 0)]
    df = spark.createDataFrame(data, "detector STRING, project STRING, path STRING, line INT, member STRING, extra INT")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        findings_store.write_paged(df.repartition(6), folder + "/paged", rows_per_file=200)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    order = lambda r: [(v is not None, v) for v in (r[1], r[2], r[3], r[4], r[5])]
    hot = sorted((r for r in data if r[0] == "hot"), key=order)
    files = []
    for at in (0, 40, 1490, 2960, 2990):
        page = findings_store.read_page(spark, folder + "/paged", "hot", 50, at)
        found = page.collect()
        assert [tuple(r)[:6] for r in page.select("detector", "project", "path", "line", "member", "extra").collect()] == hot[at:at + 50]
        assert found[0].total_records == 3000 and found[0].has_more == (at + 50 < 3000)
        total, ranges = findings_store.page_ranges(spark, folder + "/paged", "hot", 50, at)
        files.append(len(ranges))
    assert max(files) <= 2
    assert findings_store.read_page(spark, folder + "/paged", "rare").count() == 3
    assert findings_store.read_page(spark, folder + "/paged", None).count() == 1
    assert findings_store.read_page(spark, folder + "/paged", "hot", 50, 3000).count() == 0
    assert findings_store.read_page(spark, folder + "/paged", "none").columns == found[0].__fields__


def test_empty_paged_store(spark, folder):
    none = spark.createDataFrame([], "detector STRING, project STRING, path STRING, line INT, member STRING")
    findings_store.write_paged(none, folder + "/paged")
    assert findings_store.read_page(spark, folder + "/paged", "d").count() == 0


def test_bundles_give_back_every_file(spark, folder):
    texts = ["a\nb\r\n", "", None, '"quoted" \\ \x01 \u00e9', "x" * 100_000]
    kept = [("p 1" if i % 2 else "q", f"src/{i}.cs", text) for i, text in enumerate(texts)]
    dropped = [("q", "obj/a.cs", "x"), ("q", "src/a.g.cs", "x")]
    files.write_bundles(spark.createDataFrame(kept + dropped, "project STRING, path STRING, content STRING"), f"{folder}/bundles")
    found = files.read_bundles(spark, f"{folder}/bundles").select("project", "path", "content").collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == kept
