import itertools
import random

from conftest import rows
from pyspark.sql import functions as F

from codescope import session
from codescope.operators import clones, graph
from codescope.plans.detectors import all_detectors
from codescope.plans.registry import run_detectors
from codescope.session import shuffled


def _edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "src INT, dst INT")


def _random_pairs(seed, n, m):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


def _distances(pairs, root, limit=None):
    seen, frontier, depth = {root: 0}, {root}, 0
    while frontier and (limit is None or depth < limit):
        depth += 1
        frontier = {b for a, b in pairs if a in frontier and b not in seen}
        seen.update(dict.fromkeys(frontier, depth))
    return seen


def test_reach_in_both_directions(spark):
    pairs = _random_pairs(1, 30, 45)
    roots = spark.createDataFrame([(0,), (7,)], "node INT")
    forward = rows(graph.reach_forward(_edges(spark, pairs), roots, 3))
    assert forward == sorted((r, n, d) for r in (0, 7) for n, d in _distances(pairs, r, 3).items())
    swapped = {(b, a) for a, b in pairs}
    reverse = rows(graph.reach_reverse(_edges(spark, pairs), roots, 4))
    assert reverse == sorted((r, n, d) for r in (0, 7) for n, d in _distances(swapped, r, 4).items())


def test_reverse_reach_through_an_interface(spark):
    edges = _edges(spark, [(1, 10), (2, 1)])
    implements = spark.createDataFrame([(20, 10)], "member INT, interface_member INT")
    roots = spark.createDataFrame([(20,)], "node INT")
    assert rows(graph.reach_reverse(edges, roots, 3, implements)) == [(20, 1, 1), (20, 2, 2), (20, 20, 0)]
    assert graph.reach_reverse(edges, roots, 3).count() == 1


def _components(pairs):
    nodes = {n for p in pairs for n in p}
    reach = {n: set(_distances(pairs, n)) for n in nodes}
    groups = {frozenset(m for m in reach[n] if n in reach[m]) for n in nodes}
    return {g for g in groups if len(g) > 1}


def _simple_cycles(pairs, longest):
    found = set()
    nodes = sorted({n for p in pairs for n in p})
    out = {n: sorted(b for a, b in pairs if a == n) for n in nodes}

    def walk(path):
        for n in out[path[-1]]:
            if n == path[0] and len(path) > 1:
                found.add(tuple(path))
            elif n > path[0] and n not in path and len(path) < longest:
                walk([*path, n])

    for n in nodes:
        walk([n])
    return found


def test_components_and_cycles_of_random_graphs(spark):
    for seed, n, m in [(2, 12, 16), (3, 25, 30), (4, 18, 40)]:
        pairs = _random_pairs(seed, n, m)
        edges = _edges(spark, pairs)
        found = {}
        for node, component in rows(graph.strong_components(edges)):
            found.setdefault(component, set()).add(node)
        groups = _components(pairs)
        assert {frozenset(g) for g in found.values()} == groups
        assert all(min(g) == c for c, g in found.items())

        cycles = _simple_cycles(pairs, 25 if m < 35 else 8)
        expected = []
        for g in groups:
            inside = [c for c in cycles if set(c) <= g]
            best = min(inside, key=lambda c: (len(c), c))
            expected.append((min(g), len(g), len(best), "->".join(map(str, [*best, best[0]]))))
        shown = rows(graph.cycles(edges), "component", "n_nodes", "cycle_length", "cycle")
        assert shown == sorted(expected)

        short = {}
        for c in cycles:
            if len(c) <= 5:
                short[frozenset(c)] = min(c, short.get(frozenset(c), c))
        text = sorted((len(c), "->".join(map(str, [*c, c[0]]))) for c in short.values())
        assert rows(graph.mutual_recursion(edges)) == text


def test_no_cycles(spark):
    edges = _edges(spark, [(1, 2), (2, 3), (1, 3), (4, 4)])
    assert graph.cycles(edges).count() == 0
    assert graph.mutual_recursion(edges).count() == 0


def test_direct_and_transitive(spark):
    edges = _edges(spark, [(1, 2), (2, 1), (5, 6), (6, 7), (7, 5)])
    assert rows(graph.cycles(edges), "kind", "cycle") == [("Direct", "1->2->1"), ("Transitive", "5->6->7->5")]


def test_connected_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(9, 3)]
    found = dict(rows(graph.connected_components(_edges(spark, links))))
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_self_recursion(spark):
    edges = _edges(spark, [(1, 1), (2, 2), (3, 3), (4, 5)])
    parameters = spark.createDataFrame([(2, "MaxDepth"), (1, "x")], "symbol_id INT, name STRING")
    guards = spark.createDataFrame([(3,)], "symbol_id INT")
    assert rows(graph.self_recursion(edges, parameters, guards)) == [(1,)]


def test_chain_depth(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 4), (4, 4), (5, 6), (6, 5), (6, 1)]
    found = dict(rows(graph.chain_depth(_edges(spark, pairs), 1)))
    # 5 and 6 call each other: that call adds nothing, and 5 has no other callee.
    assert found == {4: 1, 3: 2, 2: 3, 1: 4, 6: 5, 5: 1}
    assert rows(graph.chain_depth(_edges(spark, pairs), 4)) == [(1, 4), (6, 5)]


def test_hierarchy_with_cycle(spark):
    edges = _edges(spark, [(1, 2), (2, 3), (8, 9), (9, 8)])
    assert (1, 3, 2) in rows(graph.hierarchy(edges))
    found = {r.type: r for r in graph.hierarchy_summary(edges).collect()}
    assert found[3].is_root and found[3].n_descendants == 2 and not found[3].is_leaf
    assert found[1].is_leaf and found[1].n_ancestors == 2 and found[1].n_bases == 1
    assert found[8].in_cycle and not found[1].in_cycle


def test_implementation_coverage(spark):
    owed = spark.createDataFrame([("I", "a"), ("I", "b")], "interface STRING, signature STRING")
    types = spark.createDataFrame([("T", "I"), ("U", "I")], "type STRING, interface STRING")
    have = spark.createDataFrame([("T", "a"), ("T", "b"), ("U", "a")], "type STRING, signature STRING")
    found = rows(graph.implementation_coverage(owed, types, have), "type", "signature", "implemented", "is_fully_complete")
    assert found == [("T", "a", True, True), ("T", "b", True, True), ("U", "a", True, False), ("U", "b", False, False)]


def _units(spark, sequences):
    data = [(u, c, i + 1, s) for u, (c, shapes) in sequences.items() for i, s in enumerate(shapes)]
    return spark.createDataFrame(data, "unit_id STRING, container STRING, ord INT, shape STRING")


def _window_groups(sequences, low, high):
    places = {}
    for u, (_, shapes) in sequences.items():
        for size in range(low, (high or len(shapes)) + 1):
            for start in range(len(shapes) - size + 1):
                places.setdefault(tuple(shapes[start : start + size]), []).append((u, start + 1))
    return sorted((len(w), len(p), u, s) for w, p in places.items() if len(p) > 1 for u, s in p)


def test_duplicate_units_at_the_bound(spark):
    sequences = {"a": ("T", "vwxyz"), "b": ("T", "vwxyz"), "c": ("T", "vwxzy"), "d": ("T", "vwxy"), "e": ("T", "vwxy")}
    units = _units(spark, sequences)
    assert rows(clones.duplicate_units(units), "group_id", "unit_id", "n_units") == [("a", "a", 2), ("a", "b", 2)]
    assert clones.duplicate_units(units, 4).count() == 4
    assert clones.duplicate_units(units, 6).count() == 0


def test_windows_are_counted_without_sorting_them(spark, monkeypatch):
    """An aggregate that carries the lists would sort all windows of a task."""
    plans = []
    for name in ("cut_lineage", "cut_and_count"):
        cut = getattr(clones, name)
        monkeypatch.setattr(clones, name, lambda df, cut=cut: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    units = spark.range(40).selectExpr("id % 2 AS unit_id", "CAST(id div 2 + 1 AS INT) AS ord", "concat('s', id % 4) AS shape")
    assert clones.duplicate_windows(units, 3, 5).count() == 2 * (18 + 17 + 16)
    assert plans and not any("SortAggregate" in p for p in plans)


def test_duplicate_windows_against_enumeration(spark, monkeypatch):
    rng = random.Random(8)
    sequences = {f"u{i}": ("T", [rng.choice("abc") for _ in range(rng.randint(3, 25))]) for i in range(12)}
    units = _units(spark, sequences)
    columns = ("size", "n_occurrences", "unit_id", "start_ord")
    monkeypatch.setattr(clones, "_BLOCK", 8)  # several blocks per unit
    assert rows(clones.duplicate_windows(units, 3, 5), *columns) == _window_groups(sequences, 3, 5)
    assert rows(clones.duplicate_windows(units, 3, None), *columns) == _window_groups(sequences, 3, None)


def test_window_exit_flag(spark):
    units = _units(spark, {"a": ("T", ["x", "return", "y"]), "b": ("T", ["x", "return", "y"])})
    found = {(r.size, r.start_ord): r.has_exit for r in clones.duplicate_windows(units, 1, 2).collect()}
    assert found == {(1, 1): False, (1, 2): True, (1, 3): False, (2, 1): True, (2, 2): True}


def test_windows_in_a_hierarchy(spark):
    body = list("abcd")
    units = _units(spark, {"base": ("B", body), "child": ("C", body), "other": ("X", body)})
    edges = spark.createDataFrame([("C", "B"), ("X", "Y")], "src STRING, dst STRING")
    found = clones.duplicate_windows_in_hierarchy(units, edges, "B", 4, 4)
    assert rows(found, "unit_id", "n_occurrences") == [("base", 2), ("child", 2)]
    assert clones.duplicate_windows_in_hierarchy(units, edges, "X", 4, 4).count() == 0


def test_hierarchy_detector_has_all_sizes_of_one_family(spark):
    body = list("abcdefgh")
    units = _units(spark, {"base": ("B", body), "child": ("C", body), "other": ("X", body), "more": ("Y", body)})
    edges = spark.createDataFrame([("C", "B"), ("X", "Y")], "src STRING, dst STRING")
    context = {"family_units": units, "hierarchy_edges": edges, "family_root": spark.createDataFrame([("B",)], "root STRING")}
    found = rows(run_detectors(context, all_detectors(), ids=["duplicate_blocks_in_hierarchy"]), "member", "line", "score")
    assert found == [(u, start, size) for u in ("base", "child") for start in range(1, 6) for size in range(4, 10 - start)]


def test_repeated_literals(spark):
    data = [("src/A.cs", i, t) for t in ["hello big-World", "ab", "@user", "   ", "twice"] for i in range(3)]
    data = [d for d in data if not (d[2] == "twice" and d[1] == 0)]
    data += [("src/ATest.cs", 1, "twice")]
    df = spark.createDataFrame(data, "path STRING, line_no INT, text STRING")
    assert rows(clones.repeated_literals(df), "text", "n_occurrences", "constant_name") == [
        ("hello big-World", 3, "HelloBigWorld")
    ]
    assert clones.literal_sites(df).count() == 3
    names = spark.createDataFrame([("???",), ("aBC d1",)], "v STRING").select(clones.constant_name(F.col("v")))
    assert [r[0] for r in names.collect()] == ["MagicString", "AbcD1"]


def test_rare_literals_are_not_sorted(spark):
    """Only literals whose digest is frequent enough reach the aggregate that sorts their paths."""
    data = [(f"src/{i}.cs", i, t) for i in range(9) for t in ("three times"[: 5 + i // 3], f"once {i}")]
    found = clones.repeated_literals(spark.createDataFrame(data, "path STRING, line_no INT, text STRING"))
    assert rows(found, "text", "n_occurrences", "first_path") == [("three", 3, "src/0.cs"), ("three ", 3, "src/3.cs"), ("three t", 3, "src/6.cs")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate") :]


def test_pairs_helper_is_exhaustive():
    assert len(_simple_cycles({(0, 1), (1, 0), (1, 2), (2, 0)}, 5)) == 2
    assert list(itertools.islice(iter(_components({(0, 1), (1, 0)})), 1)) == [frozenset({0, 1})]


def test_large_sides_are_never_broadcast_by_an_estimate(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    edges = _edges(spark, _random_pairs(5, 12, 20))
    for found in (graph._edges_inside(edges, graph.strong_components(edges)), session.lookup_side(edges, 1).join(edges, "src")):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_windows_of_all_sizes_broadcast_no_level(spark, monkeypatch):
    """A level is as large as the units: its join is marked for a shuffle, whatever its estimate."""
    marked = []
    monkeypatch.setattr(clones, "shuffled", lambda df: marked.append(df.columns) or shuffled(df))
    units = spark.createDataFrame([(u, i + 1, c) for u, text in enumerate(["abcdef", "zabcde", "abcd"]) for i, c in enumerate(text)], "unit_id int, ord int, shape string")
    found = clones.duplicate_windows(units, 3, None).select("size", "preview", "unit_id", "start_ord")
    assert rows(found) == sorted(
        [(3, "a b c", 0, 1), (3, "a b c", 1, 2), (3, "a b c", 2, 1), (3, "b c d", 0, 2), (3, "b c d", 1, 3), (3, "b c d", 2, 2), (3, "c d e", 0, 3), (3, "c d e", 1, 4)]
        + [(4, "a b c d", 0, 1), (4, "a b c d", 1, 2), (4, "a b c d", 2, 1), (4, "b c d e", 0, 2), (4, "b c d e", 1, 3), (5, "a b c d e", 0, 1), (5, "a b c d e", 1, 2)]
    )
    assert len(marked) == 3 and all("_next" in columns for columns in marked)
