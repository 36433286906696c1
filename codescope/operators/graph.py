"""Graph operators over an edge table.

Loops join a frontier or a label column with the edges, cut the lineage after every
round, and stop when a round changes nothing: every round settles or adds something, so
each loop ends by itself. A side that grows with the graph is counted before it may be
broadcast: Spark's estimate of a written table is that of the plan behind it, often too low.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.session import cut_and_count, cut_lineage, lookup_side, shuffled


def _plain_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops and gaps."""
    return edges.select("src", "dst").where("src <> dst").distinct()


# --- reachability -------------------------------------------------------------------


def _closure(edges: DataFrame, start: DataFrame, max_depth: int | None) -> DataFrame:
    """(root, node, depth) with the least depth, breadth first; ``start`` holds (root, node).

    Every node is expanded once per root. A frontier of counted, small size is broadcast to
    the edges, which then stay where they are.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    frontier, n = cut_and_count(start.select("root", "node", F.lit(0).alias("depth")).distinct())
    visited = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        reached = step.join(lookup_side(frontier, n), "node").select(
            "root", F.col("next").alias("node"), F.lit(0).alias("known")
        )
        # One aggregation drops repeats and nodes met before: a round shuffles once.
        fresh = (
            visited.select("root", "node", F.lit(1).alias("known"))
            .unionAll(reached)
            .groupBy("root", "node")
            .agg(F.max("known").alias("known"))
            .where("known = 0")
            .select("root", "node", F.lit(depth).alias("depth"))
        )
        frontier, n = cut_and_count(fresh)
        if n == 0:
            return visited
        visited = visited.unionByName(frontier)
        if depth % 8 == 0:
            visited = cut_lineage(visited)
    return visited


def reach_forward(edges: DataFrame, roots: DataFrame, max_depth: int | None = 3) -> DataFrame:
    """Everything the roots call, to a depth (None: to the end), with the least depth.

    Each caller's repeated calls are merged, and a node met again is a leaf. Breadth-first
    order makes the depth the least one, so nothing within ``max_depth`` is left out.
    """
    start = roots.select(F.col("node").alias("root"), "node")
    return _closure(_plain_edges(edges), start, max_depth)


def reach_reverse(
    edges: DataFrame, roots: DataFrame, max_depth: int = 3, implements: DataFrame | None = None
) -> DataFrame:
    """Everything that calls the roots, to a depth.

    ``implements`` (member, interface_member) adds the callers of an interface member to the
    callers of the members implementing it.
    """
    pairs = edges.select("src", "dst")
    if implements is not None:
        through = pairs.join(implements, F.col("dst") == F.col("interface_member")).select(
            "src", F.col("member").alias("dst")
        )
        pairs = pairs.unionByName(through)
    swapped = _plain_edges(pairs).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _closure(swapped, roots.select(F.col("node").alias("root"), "node"), max_depth)


def blast_radius(references: DataFrame, is_test_path) -> DataFrame:
    """References, files and projects touched per symbol, and whether a test is among them."""
    return references.groupBy("symbol_id").agg(
        F.count("*").alias("n_references"),
        F.count_distinct("path").alias("n_files"),
        F.count_distinct("project").alias("n_projects"),
        F.bool_or(is_test_path).alias("touches_test"),
    )


def touched_files(references: DataFrame) -> DataFrame:
    """The files behind ``blast_radius``, a row each."""
    return references.groupBy("symbol_id", "project", "path").agg(F.count("*").alias("n_references"))


# --- components ---------------------------------------------------------------------


def _fingerprint(pairs: DataFrame):
    """One row that tells two sets of distinct pairs apart."""
    return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph; a component is named by its least node.

    Alternates linking every node's larger neighbours, and then its smaller ones, to the
    least node around it. The number of rounds grows with the logarithm of the size.
    """
    pairs = links.select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).where("u <> v").distinct()
    pairs = cut_lineage(pairs)
    state = _fingerprint(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before the joins, so that a node with many neighbours can be split there.
        least, n = cut_and_count(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        larger = both.where("v > u").join(lookup_side(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.where("u <> v")
        small, n = cut_and_count(larger.groupBy("u").agg(F.min("v").alias("m")))
        nexts = (
            larger.join(lookup_side(small, n), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, pairs = state, cut_lineage(nexts)
        state = _fingerprint(pairs)
        if state == before:
            named = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            own = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return named.unionByName(own)


def _trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """Drop edges that cannot lie on a cycle: their source has no in-edge or their target
    no out-edge. Goes on while it pays; what is left over does not change the result."""
    edges, n = cut_and_count(edges)
    while True:
        ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
            edges.select("dst", F.lit(0), F.lit(1))
        )
        through = ends.groupBy("node").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o = 1 AND i = 1")
        through = lookup_side(through.select("node"), 2 * n)
        left = edges.join(through, F.col("src") == F.col("node"), "left_semi")
        left = left.join(through, F.col("dst") == F.col("node"), "left_semi")
        before = n
        edges, n = cut_and_count(left)
        if n == 0 or n > 0.95 * before:
            break
    return edges, n


def _spread_least(edges: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Move the least label along the edges until nothing changes; ``labels``: (node, label).

    Only the ``n`` nodes whose label fell in the last round send it on. Sent labels meet the
    old ones in one aggregation, so a round shuffles once.
    """
    active = labels
    while True:
        sent = edges.join(lookup_side(active, n), F.col("src") == F.col("node")).select(
            F.col("dst").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old")
        )
        moved = (
            labels.select("node", "label", F.col("label").alias("old"))
            .unionAll(sent)
            .groupBy("node")
            .agg(F.min("label").alias("label"), F.max("old").alias("old"))
        )
        moved, n = cut_and_count(moved, "label < old")
        active = moved.where("label < old").select("node", "label")
        labels = moved.select("node", "label")
        if n == 0:
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes on cycles; a component is named by its least node.

    Each node takes the least label that reaches it. Inside one label, the nodes that reach
    the labelled node form its component; they leave, and the rest goes on.
    """
    left, n_edges = _trim(_plain_edges(edges))
    found = None
    while True:
        if n_edges == 0:
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        labels, n = cut_and_count(nodes.select("node", F.col("node").alias("label")))
        labels = _spread_least(left, labels, n)
        side = lookup_side(labels, n)
        inside = (
            left.join(side.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src")
            .join(side.select(F.col("node").alias("dst"), F.col("label").alias("lt")), "dst")
            .where("ls = lt")
            .select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        roots = labels.where("node = label").select(F.col("label").alias("root"), "node")
        members, n_members = cut_and_count(_closure(cut_lineage(inside), roots, None).select("node", F.col("root").alias("component")))
        sizes, n = cut_and_count(members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"))
        cyclic = members.join(lookup_side(sizes, n), "component", "left_semi").select("node", "component")
        found = cyclic if found is None else found.unionByName(cyclic)
        gone = lookup_side(members.select("node"), n_members)
        left = left.join(gone, F.col("src") == F.col("node"), "left_anti")
        left = left.join(gone, F.col("dst") == F.col("node"), "left_anti")
        left, n_edges = _trim(left)
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return cut_lineage(found)


def _edges_inside(edges: DataFrame, components: DataFrame) -> DataFrame:
    source = components.toDF("src", "component")
    target = components.toDF("dst", "_other")
    return (
        _plain_edges(edges)
        .join(shuffled(source), "src")
        .join(shuffled(target), "dst")
        .where("component = _other")
        .select("component", "src", "dst")
    )


def cycles(edges: DataFrame) -> DataFrame:
    """The cyclic components with their size and a shortest cycle, its least node first.

    Among the shortest cycles of a component the least path wins. The search extends
    paths whose first node is their least one, keeps one path per (first, last) pair, and
    ends for a component as soon as one of its paths closes.
    """
    components = strong_components(edges)
    sizes, open_components = cut_and_count(
        components.groupBy("component").agg(F.count("*").alias("n_nodes"))
    )
    inside = cut_lineage(_edges_inside(edges, components))
    step = inside.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = inside.where("src < dst").select(
        "component", F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")
    )
    paths, n = cut_and_count(paths)
    visited, n_visited = paths.select("first", "last"), n
    done = sizes.select("component", F.array("component").alias("path")).limit(0)
    while True:
        if open_components == 0:
            break
        ends = step.join(lookup_side(paths, n), "last")
        closed = ends.where("next = first").groupBy("component").agg(F.min("path").alias("path"))
        closed, n_closed = cut_and_count(closed)
        done = done.unionByName(closed)
        open_components -= n_closed
        longer = (
            ends.where("next > first")
            .join(lookup_side(closed.select("component"), n_closed), "component", "left_anti")
            .groupBy("component", "first", F.col("next").alias("last"))
            .agg(F.min(F.concat("path", F.array("next"))).alias("path"))
            .join(lookup_side(visited, n_visited), ["first", "last"], "left_anti")
        )
        paths, n = cut_and_count(longer)
        visited, n_visited = cut_and_count(visited.unionByName(paths.select("first", "last")))
    kind = F.when(F.size("path") == 2, "Direct").otherwise("Transitive")
    return (
        sizes.join(done, "component")
        .select("component", "n_nodes", F.size("path").alias("cycle_length"), kind.alias("kind"), _closed_path().alias("cycle"))
    )


def _closed_path():
    """``a->b->a`` from the path [a, b]."""
    nodes = F.transform(F.concat("path", F.slice("path", 1, 1)), lambda n: n.cast("string"))
    return F.array_join(nodes, "->")


def mutual_recursion(edges: DataFrame, max_len: int = 5) -> DataFrame:
    """Simple cycles of 2 to ``max_len`` nodes, one per set of nodes.

    Edges that cannot lie on a cycle are trimmed first. A cycle is grown from its node of
    highest degree, so no path runs through a node busier than its start: a hub is only
    ever a start, and its in- and out-edges are never multiplied with each other. Of the
    orders in which one node set forms a cycle the least path is shown.
    """
    inside, _ = _trim(_plain_edges(edges))
    degree = (
        inside.select(F.col("src").alias("node"))
        .unionAll(inside.select(F.col("dst").alias("node")))
        .groupBy("node")
        .agg(F.count("*").alias("d"))
    )
    rank = degree.select("node", F.struct("d", "node").alias("rank"))
    ranked = inside.join(shuffled(rank.toDF("src", "rs")), "src").join(shuffled(rank.toDF("dst", "rd")), "dst")
    ranked = cut_lineage(ranked.select("src", "dst", "rs", "rd"))
    step = ranked.select(F.col("src").alias("last"), F.col("dst").alias("next"), F.col("rd").alias("rn"))
    paths = ranked.where("rd < rs").select(
        F.col("src").alias("first"), F.col("rs").alias("top"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")
    )
    back = ranked.where("rs < rd").select(F.col("src").alias("last"), F.col("dst").alias("first"))
    found = None
    for length in range(2, max_len + 1):
        closed = paths.join(shuffled(back), ["last", "first"], "left_semi").select("path")
        found = closed if found is None else found.unionByName(closed)
        if length < max_len:
            paths = (
                paths.join(shuffled(step), "last")
                .where("rn < top")
                .where(~F.array_contains("path", F.col("next")))
                .select("first", "top", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"))
            )
    # Rotate to the least node, then keep one order per node set.
    least = F.array_position("path", F.array_min("path")).cast("int")
    size = F.size("path")
    rotated = F.concat(
        F.slice("path", least, size - least + 1), F.slice("path", F.lit(1), least - 1)
    )
    return (
        found.withColumn("path", rotated)
        .groupBy(F.array_sort("path").alias("_set"))
        .agg(F.min("path").alias("path"))
        .select(F.size("path").alias("cycle_length"), _closed_path().alias("cycle"))
    )


# Parameter names that bound a recursion.
DEPTH_PARAMETERS = ["depth", "level", "maxdepth", "currentdepth", "recursionlevel", "limit"]


def self_recursion(edges: DataFrame, parameters: DataFrame, guards: DataFrame) -> DataFrame:
    """Members calling themselves with neither a depth parameter nor a guarded base case."""
    own = edges.where("src = dst").select(F.col("src").alias("symbol_id")).distinct()
    bounded = parameters.where(F.lower("name").isin(DEPTH_PARAMETERS)).select("symbol_id").distinct()
    return own.join(bounded, "symbol_id", "left_anti").join(
        guards.select("symbol_id").distinct(), "symbol_id", "left_anti"
    )


def chain_depth(edges: DataFrame, threshold: int = 40) -> DataFrame:
    """Members at least ``threshold`` calls deep: a leaf has depth 1, a caller one more than
    its deepest callee.

    A call that closes a cycle adds nothing, so calls inside a cyclic component are left
    out. On the rest, a node whose depth grew sends it to its callers until none grows;
    a round shuffles once.
    """
    pairs = cut_lineage(_plain_edges(edges))
    components = strong_components(pairs)
    source, target = components.toDF("src", "_cs"), components.toDF("dst", "_ct")
    left = (
        pairs.join(shuffled(source), "src", "left")
        .join(shuffled(target), "dst", "left")
        .where("_cs IS NULL OR _ct IS NULL OR _cs <> _ct")
        .select("src", "dst")
    )
    left = cut_lineage(left)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    depths, n = cut_and_count(nodes.select("node", F.lit(1).cast("long").alias("depth")))
    active = depths
    while True:
        sent = left.join(lookup_side(active, n), F.col("dst") == F.col("node")).select(
            F.col("src").alias("node"), F.col("depth") + 1, F.lit(None).cast("long")
        )
        moved = (
            depths.select("node", "depth", F.col("depth").alias("old"))
            .unionAll(sent)
            .groupBy("node")
            .agg(F.max("depth").alias("depth"), F.max("old").alias("old"))
        )
        moved, n = cut_and_count(moved, "depth > old")
        active = moved.where("depth > old").select("node", "depth")
        depths = moved.select("node", "depth")
        if n == 0:
            return depths.where(F.col("depth") >= threshold)


# --- hierarchies --------------------------------------------------------------------


def hierarchy(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(type, ancestor, depth) for every type and each of its ancestors, the direct base at
    depth 1. ``edges`` runs from child to parent. Read by ancestor, it lists descendants.

    With ``roots`` (node), only theirs, breadth first. Without, paths double in length each
    round: a least path longer than n starts with one of exactly n, so only those are joined
    on, and the number of rounds is the logarithm of the depth.
    """
    pairs = edges.select("src", "dst").distinct()
    if roots is not None:
        start = pairs.join(roots.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
        above = _closure(pairs, start.select(F.col("src").alias("root"), F.col("dst").alias("node")), None)
        return above.select(
            F.col("root").alias("type"), F.col("node").alias("ancestor"), (F.col("depth") + 1).alias("depth")
        )
    known = cut_lineage(pairs.select(F.col("src").alias("type"), F.col("dst").alias("ancestor"), F.lit(1).alias("depth")))
    length = 1
    while True:
        far = known.where(F.col("depth") == length).select("type", F.col("ancestor").alias("_via"))
        rest = known.select(F.col("type").alias("_via"), "ancestor", (F.col("depth") + length).alias("depth"))
        longer = far.join(shuffled(rest), "_via").select("type", "ancestor", "depth")
        merged = known.unionByName(longer).groupBy("type", "ancestor").agg(F.min("depth").alias("depth"))
        length *= 2
        known, n = cut_and_count(merged, f"depth = {length}")
        if n == 0:
            return known


def hierarchy_summary(edges: DataFrame) -> DataFrame:
    """Per type: direct bases, ancestors, descendants, and whether it is a root, a leaf or
    its own ancestor."""
    closure = cut_lineage(hierarchy(edges))
    types = edges.select(F.col("src").alias("type")).union(edges.select("dst")).distinct()
    up = closure.groupBy("type").agg(
        F.count("*").alias("n_ancestors"),
        F.count_if(F.col("depth") == 1).alias("n_bases"),
        F.bool_or(F.col("type") == F.col("ancestor")).alias("in_cycle"),
    )
    down = closure.groupBy(F.col("ancestor").alias("type")).agg(F.count("*").alias("n_descendants"))
    return (
        types.join(up, "type", "left")
        .join(down, "type", "left")
        .na.fill(0, ["n_ancestors", "n_bases", "n_descendants"])
        .na.fill(False, ["in_cycle"])
        .withColumns({"is_root": F.col("n_bases") == 0, "is_leaf": F.col("n_descendants") == 0})
    )


def implementation_coverage(
    interface_members: DataFrame, implementations: DataFrame, members: DataFrame
) -> DataFrame:
    """Every member each implementing type owes, whether it has it, and whether the type
    has all. ``interface_members``: (interface, signature); ``implementations``: (type,
    interface); ``members``: (type, signature)."""
    owed = implementations.join(interface_members, "interface").select("type", "interface", "signature").distinct()
    have = members.select("type", "signature").distinct().withColumn("_have", F.lit(True))
    checked = owed.join(have, ["type", "signature"], "left").withColumn(
        "implemented", F.col("_have").isNotNull()
    ).drop("_have")
    complete = checked.groupBy("type").agg(F.bool_and("implemented").alias("is_fully_complete"))
    return checked.join(complete, "type")


def project_dependencies(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Direct project references and packages of each project, a row each."""
    references = edges.select(F.col("src").alias("project"), F.lit("project").alias("kind"), F.col("dst").alias("target"), F.lit(None).cast("string").alias("version"))
    declared = packages.select("project", F.lit("package").alias("kind"), F.col("package").alias("target"), F.col("version").cast("string").alias("version"))
    return references.unionByName(declared).distinct()
