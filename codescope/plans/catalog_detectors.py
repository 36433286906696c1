"""Queries over the detector registry (T8) and the two operators only it uses."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.operators import relational
from codescope.plans import catalog_graph, catalog_search, catalog_text  # noqa: F401  (their SQL is used here)
from codescope.plans.catalog import WRITTEN_SQL, query
from codescope.plans.detectors import all_detectors
from codescope.plans.registry import catalogue, count_findings, run_detectors
from codescope.session import written

# A line of source code per event; each fires one rule of the pack, the last but two none.
SNIPPETS = [
    ("task_void_usage", "private async void Go() { }"),
    ("blocking_calls_in", "var x = task.Result;"),
    ("task_yield_usage", "await Task.Yield();"),
    ("task_delay_usage", "await Task.Delay(50);"),
    ("task_run_in", "await Task.Run(Work);"),
    ("reflection_usage", "type.GetMethod(name);"),
    ("inefficient_string_comparisons", "if (a.ToLower() == b) { }"),
    ("security", "var h = MD5.Create();"),
    ("structural_smells", "lock (this) { }"),
    ("linq_redundant_where", "rows.Where(r => r.Ok).First();"),
    ("sql_injection", 'db.ExecuteSqlRaw($"select {x}");'),
    ("todo_fixme_comments", "y = 1; // TODO later"),
    ("empty_catch_blocks", "try { Run(); } catch { }"),
    (None, "int z = 2;"),
]
_N = len(SNIPPETS)
_LISTED = ", ".join("'" + text.replace("'", "''") + "'" for _, text in SNIPPETS)


def _code(t):
    text = F.element_at(F.array(*[F.lit(s) for _, s in SNIPPETS]), (F.col("event_id") % _N + 1).cast("int"))
    return t.table("events").select(
        F.lit("p").alias("project"),
        F.concat(F.lit("src/e"), F.col("event_id").cast("string"), F.lit(".cs")).alias("path"),
        F.lit(1).alias("line_no"),
        text.alias("text"),
    )


_TOKENS = """SELECT e.src AS caller_id, e.dst AS symbol_id, concat('f', CAST(e.src AS VARCHAR)) AS path, CAST(1 AS BIGINT) AS line
        FROM (SELECT DISTINCT src, dst FROM p_oedges) e JOIN p_odefs d ON d.symbol_id = e.src
        WHERE d.kind = 'method' AND (list_contains(d.modifiers, 'async') OR starts_with(d.return_type, 'Task'))
        AND e.src IN (SELECT symbol_id FROM p_params WHERE type = 'CancellationToken')
        AND e.dst IN (SELECT symbol_id FROM p_params WHERE type = 'CancellationToken')
        AND NOT (e.src % 2 = 0 AND e.src IN (SELECT symbol_id FROM p_params WHERE type = 'CancellationToken' AND name = 'p1'))"""


def _call_sites(t):
    argument = F.when(F.col("src") % 2 == 0, "p1").otherwise("x")
    return t.view("p_oedges").select(
        F.col("src").alias("caller_id"),
        F.col("dst").alias("symbol_id"),
        F.concat(F.lit("f"), F.col("src").cast("string")).alias("path"),
        F.lit(1).alias("line"),
        F.concat(F.lit("call("), argument, F.lit(")")).alias("text"),
    )


@query("R16_tokens_not_forwarded", _TOKENS)
def _(t):
    return relational.tokens_not_forwarded(t.view("p_odefs"), t.view("p_params"), t.view("p_oedges"), _call_sites(t))


_COLLECTIONS = """SELECT symbol_id, name, return_type FROM p_symbols WHERE kind = 'property' AND accessibility = 'public' AND has_public_setter
        AND return_type = 'System.Dictionary<int>'"""


@query("R20_mutable_public_collections", _COLLECTIONS)
def _(t):
    return relational.mutable_public_collections(t.view("p_symbols")).select("symbol_id", "name", "return_type")


def _contexts(t) -> Iterator[tuple[list[str], dict[str, DataFrame]]]:
    """The tables for each group of detectors, as the operators' own queries read them. What takes
    a shuffle of whole tables and is read by several groups is written once, before the first."""
    code = _code(t)
    files = code.select("project", "path", F.col("text").alias("content"))
    ns_path = F.concat(F.lit("src/n"), F.expr("line div 100").cast("string"), F.lit("/T1.cs"))
    types = t.view("p_ns_types").select("project", ns_path.alias("path"), F.col("type_name").alias("name"), "line")
    rules = ["task_void_usage", "blocking_calls_in", "task_yield_usage", "task_delay_usage", "task_delay_zero_usage", "task_run_in"]
    rules += ["reflection_usage", "inefficient_string_comparisons", "linq_redundant_where", "sql_injection"]
    yield [*rules, "todo_fixme_comments", "security", "empty_catch_blocks", "structural_smells"], {"lines": code, "files": files, "types": types}

    # The largest shuffles come first: checkpoints of later groups stay until the driver collects its garbage.
    yield ["type_cohesion"], {"usages": t.view("p_usage")}
    units = written(t.view("p_units"), "units")
    yield ["duplicate_methods"], {"units": units}

    params = written(t.view("p_params"), "params")
    orders = {"definitions": t.view("p_odefs"), "references": t.view("p_orefs"), "parameters": params, "call_edges": t.view("p_oedges")}
    yield ["missing_cancellation_tokens"], orders
    yield ["cancellation_token_not_forwarded"], orders | {"references": _call_sites(t)}
    yield ["multiple_out_parameter_methods", "long_parameter_list", "primitive_obsession"], orders
    yield ["readonly_field_candidates", "uninstantiated_types", "unused_constructors", "unused_local_variables", "unused_private_fields"], orders
    yield ["internal_classes_that_could_be_private"], orders
    parts = {"definitions": t.view("p_symbols"), "references": t.view("p_refs"), "parameters": params}
    yield ["inconsistent_async_suffix", "mutable_public_properties", "mutable_public_collection_properties", "naming_violations"], parts
    yield ["unbounded_static_collections", "obsolete_callers", "interface_extraction_candidates", "large_methods", "large_types"], parts
    guards = t.table("supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("symbol_id"))
    yield ["stack_overflow_risks", "unbounded_recursion"], {"call_edges": t.view("p_edges"), "parameters": params, "guards": guards}

    internal_type = (F.col("kind") == "type") & (F.col("accessibility") == "internal")
    interfaces = t.view("p_odefs").withColumn("kind", F.when(internal_type, "interface").otherwise(F.col("kind")))
    implemented = t.view("p_oedges").select("src", F.concat(F.lit("m"), F.col("dst").cast("string")).alias("dst"))
    yield ["unused_interfaces"], {"definitions": interfaces, "implementations": implemented}
    yield ["package_inconsistency", "unused_references"], {"packages": t.view("p_packages"), "package_uses": t.view("p_package_uses")}
    nations = t.table("nation").select(F.col("n_name").alias("project"), F.concat(F.lit("net"), F.col("n_regionkey").cast("string")).alias("framework"))
    yield ["project_consistency"], {"projects": nations}
    yield ["string_magic_values"], {"text_literals": t.view("p_lines")}
    yield ["all_throw_sites"], {"references": t.view("p_typed_refs")}
    labels = written(t.view("p_switch_labels"), "switch-labels")
    yield ["large_switch_statements"], {"case_labels": labels}
    yield ["non_exhaustive_enum_switches"], {"switches": t.view("p_switches"), "enum_members": t.view("p_enum"), "case_labels": labels}
    yield ["services_not_registered"], {"injected": t.view("p_injected"), "registrations": t.view("p_service_names")}
    kind = F.when(F.col("l_returnflag") == "A", "subscribe").when(F.col("l_returnflag") == "R", "unsubscribe")
    subscriptions = t.table("lineitem").select(
        F.col("l_suppkey").cast("string").alias("path"), F.col("l_partkey").alias("event"), F.col("l_linestatus").alias("handler"), F.col("l_orderkey").alias("line"), kind.alias("ref_kind")
    )
    yield ["unused_event_subscriptions"], {"subscriptions": subscriptions}
    strings = F.explode(F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))).alias("value")
    yield ["hardcoded_paths"], {"literals": t.view("p_page_links").select(strings)}
    patterns = t.table("pages").select(F.concat(F.lit("("), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("+)*")).alias("value"))
    yield ["re_do_s_patterns"], {"literals": patterns}
    yield ["circular_dependencies", "circular_type_references"], {"project_edges": t.view("p_tree"), "type_edges": t.view("p_edges")}
    yield ["duplicate_blocks_in_hierarchy"], {"family_units": catalog_graph._shaped(units), "hierarchy_edges": t.view("p_tree"), "family_root": t.spark.range(3, 4)}
    yield ["layer_violations"], {"imports": t.view("p_layers")}
    yield ["namespace_path_mismatches"], {"namespaces": t.view("p_namespaces"), "ns_types": t.view("p_ns_types")}


def _rows(key: str) -> str:
    sql = WRITTEN_SQL[key].strip()
    return f"SELECT count(*) FROM ({'WITH RECURSIVE' + sql[4:] if sql.startswith('WITH') else sql})"


_OWN_CALLS = """SELECT count(DISTINCT src) FROM p_edges WHERE src = dst AND src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)"""
# How many findings each detector has, in SQL.
COUNTS = {
    **{name: f"SELECT count(*) FROM events WHERE event_id % {_N} = {i}" for i, (name, _) in enumerate(SNIPPETS) if name},
    "task_delay_zero_usage": "SELECT 0",
    "structural_smells": f"SELECT (SELECT count(*) FROM events WHERE event_id % {_N} = 8) + ({_rows('R18_file_structure_smells')})",
    "missing_cancellation_tokens": _rows("R16_missing_token_forwarding"),
    "cancellation_token_not_forwarded": f"SELECT count(*) FROM ({_TOKENS})",
    "readonly_field_candidates": _rows("R14_readonly_candidates"),
    "multiple_out_parameter_methods": _rows("M15_multiple_out_parameters"),
    "uninstantiated_types": _rows("R2_uninstantiated_types"),
    "unused_constructors": f"SELECT count(*) FROM ({WRITTEN_SQL['R1_unused_definitions']}) WHERE kind = 'constructor'",
    "unused_local_variables": f"SELECT count(*) FROM ({WRITTEN_SQL['R1_unused_definitions']}) WHERE kind = 'local'",
    "unused_private_fields": f"SELECT count(*) FROM ({WRITTEN_SQL['R1_unused_definitions']}) WHERE kind = 'field'",
    "internal_classes_that_could_be_private": _rows("R19_single_file_internals"),
    "long_parameter_list": _rows("M4_long_parameter_lists"),
    "primitive_obsession": _rows("M5_repeated_parameter_types"),
    "inconsistent_async_suffix": _rows("T7_async_suffix_violations"),
    "mutable_public_properties": _rows("R20_mutable_public_properties"),
    "mutable_public_collection_properties": f"SELECT count(*) FROM ({_COLLECTIONS})",
    "naming_violations": _rows("T6_naming_violations"),
    "unbounded_static_collections": _rows("R21_unbounded_static_collections"),
    "obsolete_callers": "SELECT count(*) FROM p_refs r JOIN p_symbols d ON d.symbol_id = r.symbol_id WHERE obsolete_message IS NOT NULL",
    "interface_extraction_candidates": _rows("M9_extraction_candidates"),
    "large_methods": _rows("M3_large_methods"),
    "large_types": _rows("M3_large_types"),
    "unused_interfaces": _rows("R3_unimplemented_interfaces"),
    "package_inconsistency": _rows("R9_version_conflicts"),
    "unused_references": _rows("R4_unused_dependencies"),
    "project_consistency": "SELECT count(*) FROM nation WHERE n_regionkey <> (SELECT n_regionkey FROM nation GROUP BY 1 ORDER BY count(*) DESC, n_regionkey LIMIT 1)",
    "string_magic_values": _rows("C3_repeated_literals"),
    "all_throw_sites": _rows("Q6_throw_sites"),
    "non_exhaustive_enum_switches": _rows("R12_missing_cases"),
    "large_switch_statements": "SELECT count(*) FROM (SELECT switch_id FROM p_switch_labels GROUP BY 1 HAVING count(DISTINCT label) > 10)",
    "services_not_registered": _rows("R5_unregistered_services"),
    "stack_overflow_risks": f"SELECT ({_OWN_CALLS}) + ({_rows('G5_mutual_recursion')})",
    "unbounded_recursion": _OWN_CALLS,
    "unused_event_subscriptions": _rows("R15_unpaired_subscriptions"),
    "hardcoded_paths": _rows("T4_path_literals"),
    "re_do_s_patterns": "SELECT count(*) FROM pages",
    "circular_dependencies": "SELECT 0",  # a tree has none
    "circular_type_references": _rows("G4_cycles"),
    "duplicate_methods": _rows("C1_duplicate_units"),
    "duplicate_blocks_in_hierarchy": _rows("C4_duplicate_windows_in_hierarchy_all_sizes"),
    "layer_violations": _rows("R8_layer_violations"),
    "namespace_path_mismatches": _rows("R17_namespace_path_mismatches"),
    "type_cohesion": _rows("M7_cohesion_lcom"),
}
_DOMAINS = {d.id: (d.domain, d.severity) for d in all_detectors()}


@query(
    "T8_detector_counts",
    "SELECT detector, domain, severity, CAST(n AS BIGINT) AS n_findings FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS detector, '{_DOMAINS[name][0]}' AS domain, '{_DOMAINS[name][1]}' AS severity, ({sql}) AS n" for name, sql in COUNTS.items()
    )
    + ")",
)
def _(t):
    counts = count_findings(t.spark, _contexts(t), all_detectors())
    listed = catalogue(t.spark, all_detectors()).select("detector", "domain", "severity")
    return listed.join(counts, "detector", "left").na.fill(0, ["n_findings"])


@query(
    "T8_run_detectors",
    f"""SELECT 'readonly_field_candidates' AS detector, 'convention' AS domain, 'Info' AS severity, CAST(NULL AS VARCHAR) AS project, path, line, name AS member,
          CAST(NULL AS VARCHAR) AS message, CAST(NULL AS BIGINT) AS score FROM p_odefs
          WHERE kind = 'field' AND accessibility = 'private' AND NOT list_contains(modifiers, 'readonly')
          AND symbol_id NOT IN (SELECT symbol_id FROM p_orefs WHERE ref_kind = 'write' AND NOT in_constructor)
        UNION ALL SELECT 'string_magic_values', 'convention', 'Info', NULL, first_path, NULL, NULL, text, n_occurrences FROM ({WRITTEN_SQL['C3_repeated_literals']})
        UNION ALL SELECT 'uninstantiated_types', 'dead-code', 'Info', NULL, path, line, name, NULL, NULL FROM p_odefs WHERE kind = 'type'
          AND symbol_id NOT IN (SELECT symbol_id FROM p_orefs WHERE ref_kind = 'create')
        UNION ALL SELECT 'blocking_calls_in', 'async', 'Warning', 'p', concat('src/e', CAST(event_id AS VARCHAR), '.cs'), 1, NULL, 'blocking call', NULL
          FROM events WHERE event_id % {_N} = 1""",
)
def _(t):
    context = {"definitions": t.view("p_odefs"), "references": t.view("p_orefs"), "text_literals": t.view("p_lines"), "lines": _code(t)}
    ids = ["string_magic_values", "readonly_field_candidates", "uninstantiated_types", "blocking_calls_in"]
    return run_detectors(context, all_detectors(), ids=ids)
