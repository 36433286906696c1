"""Search and lookup over lines, definitions and references (Q1-Q8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.functions.ordered import ordered_rows
from codescope.functions.text import check_pattern, contains_ci, glob_match, preview, trimmed
from codescope.operators.intervals import innermost
from codescope.session import cut_and_count, cut_lineage

READ_KINDS = ["read", "capture", "return"]
WRITE_KINDS = ["write", "out", "ref"]


def matching_lines(
    lines: DataFrame,
    pattern: str,
    is_regex: bool = False,
    glob: str | None = None,
    refuse_backtracking: bool = False,
) -> DataFrame:
    """The first match of every matching line, ignoring case: all of them, in no order."""
    text = F.col("text")
    if is_regex:
        pattern = check_pattern(pattern) if refuse_backtracking else pattern
        column_no = F.regexp_instr(text, F.lit("(?i)" + pattern))
    else:
        column_no = F.instr(F.lower(text), F.lit(pattern.lower()))
    if glob is not None:
        lines = lines.where(glob_match(F.col("path"), glob))
    found = lines.select("path", "line_no", column_no.alias("column_no"), preview(text).alias("preview"))
    return found.where(F.col("column_no") > 0)


def text_search(
    lines: DataFrame,
    pattern: str,
    is_regex: bool = False,
    glob: str | None = None,
    max_results: int = 200,
    refuse_backtracking: bool = False,
) -> DataFrame:
    """A page of the first match of each line, ignoring case, ordered by path and line, with the
    number of all matching lines (``total``) and whether there are more (``has_more``)."""
    # Written once: the count and the page come from the same pass over the text.
    hits, total = cut_and_count(matching_lines(lines, pattern, is_regex, glob, refuse_backtracking))
    page = hits.orderBy("path", "line_no").limit(max_results)
    return page.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(total > max_results)})


def enclosing_members(hits: DataFrame, definitions: DataFrame) -> DataFrame:
    """``hits`` with the innermost definition whose lines (``line`` to ``end_line``) hold the hit:
    ``member`` and ``container``, null outside of any. Hits and definitions are swept in order of
    path and line (``intervals.innermost``); the hits may be a page or all matching lines."""
    found = innermost(hits, definitions)
    inner = F.col("found")[0]
    return found.withColumns({"member": inner["name"], "container": inner["container"]}).drop("found")


def enclosing_levels(hits: DataFrame, definitions: DataFrame, kinds: Sequence[str] = ("type", "method", "local")) -> DataFrame:
    """``hits`` with a column per kind of definition: the name of the innermost one of that kind
    whose lines hold the hit, null outside of any. One sweep finds all kinds."""
    found = innermost(hits, definitions, kinds)
    return found.withColumns({kind: F.col("found")[i]["name"] for i, kind in enumerate(kinds)}).drop("found")


def locate_symbols(
    definitions: DataFrame,
    name: str,
    kind: str = "any",
    container: str | None = None,
    namespace: str | None = None,
    project: str | None = None,
    exact: bool = True,
) -> DataFrame:
    """Definitions by simple or dotted name, one per (path, line, full name)."""
    head, _, simple = name.rpartition(".")
    found = F.col("name") == simple if exact else contains_ci(F.col("name"), simple)
    rows = definitions.where(found)
    if head:
        owner = F.concat_ws(".", "namespace", "container")
        rows = rows.where((owner == head) | F.endswith(owner, F.lit("." + head)))
    if kind != "any":
        rows = rows.where(F.col("kind") == kind)
    for column, wanted in (("container", container), ("namespace", namespace), ("project", project)):
        if wanted is not None:
            rows = rows.where(F.lower(column) == wanted.lower())
    full_name = F.concat_ws(".", "namespace", "container", "name")
    kept = ["symbol_id", "name", "kind", "container", "namespace", "project"]
    return (
        rows.select(*kept, "path", "line", full_name.alias("full_name"))
        .groupBy("path", "line", "full_name")
        .agg(F.min(F.struct(*kept)).alias("_d"))
        .select("_d.*", "path", "line", "full_name")
    )


def find_callers(
    references: DataFrame,
    definitions: DataFrame,
    name: str,
    container: str | None = None,
) -> DataFrame:
    """Every reference to a symbol with its enclosing member; all candidates of an
    ambiguous name count. An unknown name is an error rather than an empty result."""
    wanted = definitions.where(F.col("name") == name)
    if container is not None:
        wanted = wanted.where(F.col("container") == container)
    targets = wanted.select("symbol_id").distinct()
    if targets.isEmpty():
        raise LookupError(f"no symbol named {name}")
    callers = definitions.select(
        F.col("symbol_id").alias("caller_id"),
        F.col("name").alias("caller_name"),
        F.col("container").alias("caller_container"),
    )
    sites = references.join(targets, "symbol_id", "left_semi")
    site = F.struct("symbol_id", "caller_id", trimmed(F.col("text")).alias("text"))
    return (
        sites.groupBy("path", "line")
        .agg(F.min(site).alias("_s"))
        .select("path", "line", "_s.*")
        .join(callers, "caller_id", "left")
    )


def methods_by_return_type(definitions: DataFrame, type_name: str) -> DataFrame:
    """Methods whose return type contains the text, one per (path, line)."""
    method = F.struct("name", "container", "return_type", "symbol_id")
    return (
        definitions.where(F.col("kind") == "method")
        .where(contains_ci(F.col("return_type"), type_name))
        .groupBy("path", "line")
        .agg(F.min(method).alias("_m"))
        .select("path", "line", "_m.name", "_m.container", "_m.return_type")
    )


def bare_attribute(column):
    """``[Foo]``, ``Foo`` and ``FooAttribute`` name the same attribute."""
    return F.regexp_replace(F.regexp_replace(column, r"^\[|\]$", ""), r"Attribute$", "")


def attribute_usages(definitions: DataFrame, attribute: str, kind: str | None = None) -> DataFrame:
    wanted = bare_attribute(F.lit(attribute))
    rows = definitions if kind is None else definitions.where(F.col("kind") == kind)
    uses = F.filter("attributes", lambda a: bare_attribute(a) == wanted)
    return (
        rows.select("symbol_id", "kind", "name", "container", "path", "line", F.explode(uses).alias("attribute"))
    )


def site_frequency(
    references: DataFrame, ref_kind: str, type_filter: str | None = None, type_col: str = "type"
) -> DataFrame:
    """Sites of one kind with the number of sites of their type.

    Frequencies are counted with partial aggregation, written, and joined back: the join
    does not inherit the aggregate's partitioning, so adaptive execution can split a type
    with a large share of the sites.
    """
    sites = references.where(F.col("ref_kind") == ref_kind)
    if type_filter is not None:
        sites = sites.where(contains_ci(F.col(type_col), type_filter))
    key = F.lower(type_col)
    frequency = cut_lineage(sites.groupBy(key.alias("_key")).agg(F.count("*").alias("frequency")))
    return (
        sites.join(frequency, key == F.col("_key"))
        .drop("_key")
    )


def api_surface(definitions: DataFrame, project: str | None = None) -> DataFrame:
    """Public types, and their public or protected members."""
    rows = definitions if project is None else definitions.where(F.lower("project") == project.lower())
    types = rows.where((F.col("kind") == "type") & (F.col("accessibility") == "public"))
    members = rows.where(F.col("kind") != "type").where(
        F.col("accessibility").isin("public", "protected", "protected internal")
    )
    public_types = types.select(F.col("name").alias("container")).distinct()
    columns = ["kind", "container", "signature", "path", "line"]
    shown = members.join(public_types, "container", "left_semi").select(*columns)
    own = types.select("kind", F.col("name").alias("container"), "signature", "path", "line")
    return own.unionByName(shown)


def access_timeline(references: DataFrame) -> DataFrame:
    """The ordered accesses of every symbol with what came before each of them."""
    kind = F.col("ref_kind")
    is_read = kind.isin(READ_KINDS)
    is_write = kind.isin(WRITE_KINDS)
    order = ["path", "line", "col", "caller_id", "ref_kind"]
    place = F.struct(*order)
    rows = references.select("symbol_id", *order)
    timeline = ordered_rows(rows, ["symbol_id"], order).running(
        nth_access=("sum", F.lit(1).cast("long")),
        prev_kind=("lag", kind),
        reads_so_far=("sum", is_read.cast("long")),
        writes_so_far=("sum", is_write.cast("long")),
        _first_write=("total_min", F.when(is_write, place)),
        _last_read=("total_max", F.when(is_read, place)),
    )
    return timeline.result().select(
        "symbol_id",
        *order,
        "nth_access",
        "prev_kind",
        "reads_so_far",
        "writes_so_far",
        F.col("_first_write.line").alias("first_write_line"),
        F.col("_last_read.line").alias("last_read_line"),
    )
