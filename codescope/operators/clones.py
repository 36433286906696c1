"""Repeated units, windows and literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescope.functions.text import is_blank
from codescope.operators.graph import reach_forward
from codescope.session import cut_and_count, cut_lineage, in_bounded_tasks, lookup_side, shuffled, written
from codescope.sources.files import is_test

# Element shapes that leave a block.
EXIT_SHAPES = ["return", "break", "continue", "throw", "goto"]
_BLOCK = 1024


def duplicate_units(units: DataFrame, min_elements: int = 5) -> DataFrame:
    """Units whose element sequences are identical: a row per unit of each group of two or
    more. The group is named by its least unit.

    ``ord`` numbers a unit's elements from 1, so the set of (ord, shape) pairs *is* the
    sequence. Its key is the count and two independent 64-bit XOR hashes, which combine in
    any order: units are never gathered into arrays, however long they are.
    """
    keys = units.groupBy("unit_id").agg(
        F.count("*").alias("n_elements"),
        F.bit_xor(F.xxhash64("ord", "shape")).alias("_h1"),
        F.bit_xor(F.xxhash64(F.lit("unit"), "shape", "ord")).alias("_h2"),
    ).where(F.col("n_elements") >= min_elements)
    same = ["n_elements", "_h1", "_h2"]
    groups = (
        keys.groupBy(*same)
        .agg(F.count("*").alias("n_units"), F.min("unit_id").alias("group_id"))
        .where("n_units > 1")
    )
    # Written, so that the join can split a sequence that many units share.
    groups = cut_lineage(groups)
    return (
        keys.join(groups, same)
        .select("group_id", "unit_id", "n_elements", "n_units")
    )


def _with_next(units: DataFrame, n_next: int) -> DataFrame:
    """Add the ``n_next`` following shapes of each element.

    Units are cut into blocks of 1,024 elements; the first elements of a block are copied
    to the block before, which is all a window crossing the border needs. So a task holds
    one block, not one unit, and a task a bounded number of blocks.
    """
    units = written(units.select("unit_id", "ord", "shape"), "units")
    length = max(_BLOCK, n_next)
    block = F.floor((F.col("ord") - 1) / length)
    within = (F.col("ord") - 1) % length
    homes = F.when((within < n_next) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    rows = units.select("unit_id", "ord", "shape", block.alias("_own"), F.explode(homes).alias("_block"))
    rows = in_bounded_tasks(rows, units.count(), "unit_id", "_block")
    window = Window.partitionBy("unit_id", "_block").orderBy("ord")
    following = {f"_n{i}": F.lead("shape", i).over(window) for i in range(1, n_next + 1)}
    return rows.withColumns(following).where("_own = _block").drop("_own", "_block")


def _windows(units: DataFrame, min_elements: int, max_elements: int) -> DataFrame:
    # Read twice, once for the digests that repeat and once for the windows that have them.
    rows = written(_with_next(units, max_elements - 1), "following")
    shapes = [F.col("shape"), *(F.col(f"_n{i}") for i in range(1, max_elements))]
    sizes = [
        F.when(shapes[size - 1].isNotNull(), F.struct(F.lit(size).alias("size"), F.array(*shapes[:size]).alias("shapes")))
        for size in range(min_elements, max_elements + 1)
    ]
    present = F.filter(F.array(*sizes), lambda w: w.isNotNull())
    return rows.select(
        "unit_id", F.col("ord").alias("start_ord"), F.explode(present).alias("_w")
    ).select("unit_id", "start_ord", "_w.size", "_w.shapes")


def window_key(shapes: Column) -> Column:
    """A digest of a list of shapes, whatever characters they hold."""
    return F.md5(F.to_json(shapes))


def _repeated(windows: DataFrame, leaves: Column) -> DataFrame:
    """The lists are keys, not values, of the count: an aggregate that carries lists sorts all its
    rows. What else is told of a group is made once, from its key."""
    groups = windows.groupBy("size", "shapes").agg(F.count("*").alias("n_occurrences")).where("n_occurrences > 1")
    told = {"window_key": window_key(F.col("shapes")), "has_exit": leaves, "preview": window_preview()}
    groups, n = cut_and_count(groups.withColumns(told))
    return windows.join(lookup_side(groups, n), ["size", "shapes"]).drop("shapes")


def window_preview(limit: int = 120) -> Column:
    return F.substring(F.array_join("shapes", " "), 1, limit)


def _exit_test() -> Column:
    return F.exists("shapes", lambda s: s.isin(EXIT_SHAPES))


def duplicate_windows(
    units: DataFrame, min_elements: int = 4, max_elements: int | None = None
) -> DataFrame:
    """Repeated windows of consecutive elements: a row per occurrence, with its end and
    whether the window leaves its block. Overlapping windows are reported.

    With ``max_elements`` all sizes up to it are built in one pass. With None every size is
    covered: each level extends only the windows that were repeated at the level before,
    because a window can repeat only if both its parts one shorter do.
    """
    if max_elements is not None:
        found = _repeated(_windows(units, min_elements, max_elements), _exit_test())
    else:
        found = _all_sizes(units, min_elements)
    return found.withColumn("end_ord", (F.col("start_ord") + F.col("size") - 1)).select(
        "size", "window_key", "n_occurrences", "has_exit", "preview", "unit_id", "start_ord", "end_ord"
    )


def _all_sizes(units: DataFrame, min_elements: int) -> DataFrame:
    """A window one longer is a window and the one that starts an element later, whose last shape
    is the new one: the elements themselves are read for the first level only."""
    windows = _windows(units, min_elements, min_elements).withColumn("_last", F.element_at("shapes", -1))
    # Tables, not checkpoints: the same few keys and previews in all rows, of which a table keeps one each.
    level = written(_repeated(windows, _exit_test()), "level")
    found, size = level, min_elements
    while True:
        size += 1
        rest = level.select(
            "unit_id", (F.col("start_ord") - 1).alias("start_ord"), F.col("window_key").alias("_tail"), F.col("_last").alias("_next")
        )
        # The sides are as large as the units: never broadcast by an estimate, and written once.
        longer = written(
            level.select("unit_id", "start_ord", "window_key", "has_exit", "preview")
            .join(shuffled(rest), ["unit_id", "start_ord"])
            .select(
                "unit_id",
                "start_ord",
                F.lit(size).alias("size"),
                F.md5(F.concat_ws("|", "window_key", "_tail", "_next")).alias("window_key"),
                (F.col("has_exit") | F.col("_next").isin(EXIT_SHAPES)).alias("has_exit"),
                F.substring(F.concat_ws(" ", "preview", "_next"), 1, 120).alias("preview"),
                F.col("_next").alias("_last"),
            ),
            "longer",
        )
        groups = (
            longer.groupBy("size", "window_key")
            .agg(F.count("*").alias("n_occurrences"))
            .where("n_occurrences > 1")
        )
        groups, n_groups = cut_and_count(groups)
        if not n_groups:
            return found
        level = written(longer.join(lookup_side(groups, n_groups), ["size", "window_key"]).select(*level.columns), "level")
        found = found.unionByName(level)


def constant_name(value: Column) -> Column:
    """A PascalCase name built from the letters and digits of a literal."""
    words = F.filter(F.split(value, "[^a-zA-Z0-9]+", -1), lambda w: w != "")
    pascal = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    )
    name = F.array_join(pascal, "")
    return F.when(name == "", "MagicString").otherwise(name)


def _literals(literals: DataFrame) -> DataFrame:
    text = F.col("text")
    path = F.col("path")
    in_tests = path.rlike("(?i)test|spec") | is_test(path)
    parameter = text.rlike(r"^@[\p{L}\p{N}_]+$")
    blank = is_blank(text)
    return literals.where((F.char_length(text) >= 3) & ~blank & ~parameter & ~in_tests)


def repeated_literals(literals: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """Literals seen several times outside tests, with a name for the constant that could
    replace them.

    The least path of a group is text, for which an aggregate sorts all its rows. So digests are
    counted first, which takes a few bytes a literal, and only literals whose digest is frequent
    enough are grouped by their text.
    """
    rows = _literals(literals)
    digest = F.xxhash64("text").alias("_digest")
    often = rows.groupBy(digest).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_occurrences)
    often, n = cut_and_count(often.select("_digest"))
    return (
        rows.select("text", "path", digest)
        .join(lookup_side(often, n), "_digest", "left_semi")
        .groupBy("text")
        .agg(F.count("*").alias("n_occurrences"), F.min("path").alias("first_path"))
        .where(F.col("n_occurrences") >= min_occurrences)
        .withColumn("constant_name", constant_name(F.col("text")))
    )


def literal_sites(literals: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """The places of the repeated literals, a row each."""
    repeated = repeated_literals(literals, min_occurrences).select("text", "n_occurrences")
    return _literals(literals).join(cut_lineage(repeated), "text")


def duplicate_windows_in_hierarchy(
    units: DataFrame,
    hierarchy_edges: DataFrame,
    root: object,
    min_elements: int = 4,
    max_elements: int | None = None,
) -> DataFrame:
    """Repeated windows within a root type, its ancestors and its descendants.

    ``root`` is a type id; ``container`` of a unit is its type.
    """
    up = hierarchy_edges.select("src", "dst")
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = units.sparkSession.createDataFrame([(root,)], "node " + up.schema["src"].dataType.simpleString())
    above = reach_forward(up, start, None).select(F.col("node").alias("container"))
    below = reach_forward(down, start, None).select(F.col("node").alias("container"))
    family = above.union(below).distinct()
    return duplicate_windows(units.join(family, "container", "left_semi"), min_elements, max_elements)

