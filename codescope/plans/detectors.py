"""All named detectors (T8): ids and domains as users know them, over the fact tables.

``needs`` names the tables of a context: those of ``codescope.schemas``, and literals (value,
path), text_literals (text, path), imports (namespace, imported, path, line), namespaces (path,
declared_ns, expected_ns, n_namespaces), types (project, path, name, line), ns_types (path, type_name,
is_partial), usages (type_id, method, field), switches (switch_id, enum_type, has_default),
enum_members (enum_type, member), case_labels (switch_id, label), injected (consumer, type, path),
registrations (service, implementation), implementations (src, dst), package_uses (project,
package), projects (project, framework), project_edges, type_edges, call_edges (src, dst),
guards (symbol_id), subscriptions (path, event, handler, line, ref_kind), family_units (unit_id,
container, ord, shape), hierarchy_edges (src, dst) and family_root (root; one row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.operators import clones, graph, metrics, relational, search, text_rules
from codescope.operators.rulepack import RULES
from codescope.plans.registry import Detector

# Rules of the pack that belong to a broader detector; the others are detectors themselves.
PARTS_OF = {
    "weak_hash": "security",
    "generic_exception": "structural_smells",
    "lock_this": "structural_smells",
    "wall_clock": "structural_smells",
    "legacy_guard": "structural_smells",
}


def _shown(find: Callable[..., DataFrame], **columns: str) -> Callable[..., DataFrame]:
    """``find`` with result columns named as in the findings table: finding=result."""

    def run(*tables: DataFrame) -> DataFrame:
        rows = find(*tables)
        named = {new: F.col(old) for new, old in columns.items()}
        kept = [c for c in ("project", "path", "line", "member", "message", "score") if c in rows.columns and c not in named]
        return rows.select(*kept, *[c.cast("string").alias(n) if n in ("member", "message") else c.alias(n) for n, c in named.items()])

    return run


def _rules(ids: set[str]) -> Callable[..., DataFrame]:
    chosen = [r for r in RULES if r.id in ids]
    return lambda lines: text_rules.rule_scan(lines, chosen).drop("detector", "domain", "severity")


def _part(name: str) -> set[str]:
    return {rule for rule, whole in PARTS_OF.items() if whole == name}


def _unused(kind: str) -> Callable[..., DataFrame]:
    return lambda d, r: relational.unused_definitions(d, r).where(F.col("kind") == kind)


def _new_tables(packages: DataFrame) -> DataFrame:
    outliers = relational.dominant_value_outliers(packages, "project", "framework")
    names = relational.naming_prefix_outliers(packages)
    return outliers.select(F.col("entity").alias("member"), F.concat(F.lit("not on "), F.col("dominant_value")).alias("message")).unionByName(
        names.select(F.col("project").alias("member"), F.concat(F.lit("not named "), F.col("dominant_prefix")).alias("message"))
    )


def _recursion(edges: DataFrame, parameters: DataFrame, guards: DataFrame) -> DataFrame:
    own = graph.self_recursion(edges, parameters, guards).select(F.col("symbol_id").cast("string").alias("member"), F.lit("calls itself").alias("message"))
    mutual = graph.mutual_recursion(edges).select(F.col("cycle").alias("member"), F.lit("calls itself through others").alias("message"))
    return own.unionByName(mutual)


def _family_duplicates(units: DataFrame, edges: DataFrame, root: DataFrame) -> DataFrame:
    return clones.duplicate_windows_in_hierarchy(units, edges, root.first()[0], 4, None)


def _security(lines: DataFrame) -> DataFrame:
    secrets = text_rules.secret_scan(lines).select("project", "path", F.col("line_no").alias("line"), F.col("name").alias("member"), F.col("reason").alias("message"))
    return secrets.unionByName(_rules(_part("security"))(lines).withColumn("member", F.lit(None).cast("string")))


def _smells(types: DataFrame, lines: DataFrame) -> DataFrame:
    files = relational.file_structure_smells(types).select("project", "path", F.col("smell").alias("message"))
    return files.withColumn("line", F.lit(None).cast("int")).unionByName(_rules(_part("structural_smells"))(lines))


def _file_rule(name: str) -> Callable[..., DataFrame]:
    chosen = [r for r in RULES if r.id == name]
    return lambda files: text_rules.file_scan(files, chosen).drop("detector", "domain", "severity")


def _rule_detectors() -> list[Detector]:
    out = []
    for rule in RULES:
        if rule.id not in PARTS_OF:
            find = _file_rule(rule.id) if rule.whole_file else _rules({rule.id})
            out.append(Detector(rule.id, rule.domain, rule.severity, ("files",) if rule.whole_file else ("lines",), find))
    return out


def all_detectors() -> list[Detector]:
    d, r = "definitions", "references"
    return [
        *_rule_detectors(),
        Detector("inconsistent_async_suffix", "async", "Info", (d, "parameters"), _shown(lambda x, p: text_rules.async_suffix_violations(x, text_rules.event_handlers(p)), member="name", message="rule")),
        Detector("missing_cancellation_tokens", "async", "Info", (d, "parameters", "call_edges"), _shown(relational.missing_token_forwarding, member="symbol_id")),
        Detector("cancellation_token_not_forwarded", "async", "Warning", (d, "parameters", "call_edges", r), _shown(relational.tokens_not_forwarded, member="caller_id")),
        Detector("package_inconsistency", "config", "Warning", ("packages",), _shown(relational.version_conflicts, member="package", message="version")),
        Detector("project_consistency", "config", "Info", ("projects",), _new_tables),
        Detector("mutable_public_properties", "convention", "Info", (d,), _shown(relational.mutable_public_properties, member="name")),
        Detector("mutable_public_collection_properties", "convention", "Warning", (d,), _shown(relational.mutable_public_collections, member="name", message="return_type")),
        Detector("naming_violations", "convention", "Info", (d, "parameters"), _shown(text_rules.naming_violations, member="name", message="rule")),
        Detector("readonly_field_candidates", "convention", "Info", (d, r), _shown(relational.readonly_candidates, member="name")),
        Detector("string_magic_values", "convention", "Info", ("text_literals",), _shown(clones.repeated_literals, path="first_path", message="text", score="n_occurrences")),
        Detector("todo_fixme_comments", "convention", "Info", ("lines",), _shown(text_rules.todo_scan, line="line_no", member="kind", message="comment")),
        Detector("all_throw_sites", "correctness", "Info", (r,), _shown(lambda x: search.site_frequency(x, "throw"), message="type", score="frequency")),
        Detector("multiple_out_parameter_methods", "correctness", "Info", ("parameters", d), _shown(metrics.multiple_out_parameters, member="method", message="tuple_element", score="n_out")),
        Detector("non_exhaustive_enum_switches", "correctness", "Warning", ("switches", "enum_members", "case_labels"), _shown(relational.missing_cases, member="switch_id", message="missing")),
        Detector("services_not_registered", "correctness", "Warning", ("injected", "registrations"), _shown(relational.unregistered_services, member="consumer", message="type")),
        Detector("stack_overflow_risks", "correctness", "Warning", ("call_edges", "parameters", "guards"), _recursion),
        Detector("unbounded_recursion", "correctness", "Warning", ("call_edges", "parameters", "guards"), _shown(graph.self_recursion, member="symbol_id")),
        Detector("unbounded_static_collections", "correctness", "Warning", (d, r), _shown(relational.unbounded_static_collections, member="name")),
        Detector("obsolete_callers", "dead-code", "Warning", (d, r), _shown(relational.obsolete_callers, member="obsolete_name", message="obsolete_message")),
        Detector("uninstantiated_types", "dead-code", "Info", (d, r), _shown(relational.uninstantiated_types, member="name")),
        Detector("unused_constructors", "dead-code", "Info", (d, r), _shown(_unused("constructor"), member="name")),
        Detector("unused_event_subscriptions", "dead-code", "Warning", ("subscriptions",), _shown(relational.unpaired_subscriptions, member="event", message="handler")),
        Detector("unused_interfaces", "dead-code", "Info", (d, "implementations"), _shown(relational.unimplemented_interfaces, member="name")),
        Detector("unused_local_variables", "dead-code", "Info", (d, r), _shown(_unused("local"), member="name")),
        Detector("unused_private_fields", "dead-code", "Info", (d, r), _shown(_unused("field"), member="name")),
        Detector("unused_references", "dead-code", "Info", ("packages", "package_uses"), _shown(relational.unused_dependencies, member="package", message="version")),
        Detector("re_do_s_patterns", "performance", "Warning", ("literals",), _shown(text_rules.redos_scan, member="signal", message="value")),
        Detector("hardcoded_paths", "security", "Info", ("literals",), _shown(text_rules.path_literals, message="value")),
        Detector("security", "security", "Error", ("lines",), _security),
        Detector("circular_dependencies", "structure", "Error", ("project_edges",), _shown(graph.cycles, member="component", message="cycle", score="cycle_length")),
        Detector("circular_type_references", "structure", "Error", ("type_edges",), _shown(graph.cycles, member="component", message="cycle", score="cycle_length")),
        Detector("duplicate_blocks_in_hierarchy", "structure", "Info", ("family_units", "hierarchy_edges", "family_root"), _shown(_family_duplicates, member="unit_id", line="start_ord", message="preview", score="size")),
        Detector("duplicate_methods", "structure", "Info", ("units",), _shown(clones.duplicate_units, member="unit_id", message="group_id", score="n_elements")),
        Detector("interface_extraction_candidates", "structure", "Info", (d,), _shown(metrics.extraction_candidates, member="container", message="name")),
        Detector("internal_classes_that_could_be_private", "structure", "Info", (d, r), _shown(relational.single_file_internals, member="name")),
        Detector("large_methods", "structure", "Info", (d,), _shown(lambda x: metrics.large_units(x, ["method"], 50), member="name", score="n_lines")),
        Detector("large_switch_statements", "structure", "Info", ("case_labels",), _shown(metrics.large_switches, member="switch_id", score="n_sections")),
        Detector("large_types", "structure", "Info", (d,), _shown(lambda x: metrics.large_units(x, ["type"], 500), member="name", score="n_lines")),
        Detector("layer_violations", "structure", "Warning", ("imports",), _shown(relational.layer_violations, member="namespace", message="imported")),
        Detector("long_parameter_list", "structure", "Warning", ("parameters", d), _shown(metrics.long_parameter_lists, member="name", score="n_parameters")),
        Detector("namespace_path_mismatches", "structure", "Info", ("namespaces", "ns_types"), _shown(relational.namespace_path_mismatches, member="declared_ns", message="reason")),
        Detector("primitive_obsession", "structure", "Info", ("parameters",), _shown(metrics.repeated_parameter_types, member="symbol_id", message="type", score="n_parameters")),
        Detector("structural_smells", "structure", "Info", ("types", "lines"), _smells),
        Detector("type_cohesion", "structure", "Info", ("usages",), _shown(metrics.cohesion_lcom, member="type_id", message="rating", score="n_methods")),
    ]
