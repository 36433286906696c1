"""Queries over repetition, graphs and relations (C, G, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescope.operators import clones, graph, relational
from codescope.plans.catalog import query

# --- clones -------------------------------------------------------------------------


@query(
    "C1_duplicate_units",
    """WITH u AS (SELECT unit_id, count(*) AS n_elements, string_agg(shape, ',' ORDER BY ord) AS seq FROM p_units GROUP BY 1 HAVING count(*) >= 5)
        SELECT min(unit_id) OVER w AS group_id, unit_id, n_elements, count(*) OVER w AS n_units FROM u
        WINDOW w AS (PARTITION BY seq) QUALIFY count(*) OVER w > 1""",
)
def _(t):
    return clones.duplicate_units(t.view("p_units"), 5)


_WINDOWS = """SELECT size, md5(CAST(to_json(shapes) AS VARCHAR)) AS window_key, count(*) OVER w AS n_occurrences, list_has_any(shapes, ['return', 'throw']) AS has_exit,
        substr(array_to_string(shapes, ' '), 1, 120) AS preview, unit_id, start_ord, start_ord + size - 1 AS end_ord FROM (
          SELECT a.unit_id, a.ord AS start_ord, s.size, list(b.shape ORDER BY b.ord) AS shapes
          FROM {units} a CROSS JOIN (SELECT unnest([4, 5, 6]) AS size) s
          JOIN {units} b ON a.unit_id = b.unit_id AND b.ord BETWEEN a.ord AND a.ord + s.size - 1
          GROUP BY 1, 2, 3 HAVING count(*) = s.size) WINDOW w AS (PARTITION BY size, shapes) QUALIFY count(*) OVER w > 1"""
# Shapes that leave a block, and shapes with the characters that lists are joined with.
_SHAPED = "(SELECT * REPLACE (CASE shape WHEN 'NO' THEN 'return' WHEN 'AF' THEN 'a,\"f' ELSE shape END AS shape) FROM {units})"


def _shaped(units):
    shape = F.when(F.col("shape") == "NO", "return").when(F.col("shape") == "AF", 'a,"f').otherwise(F.col("shape"))
    return units.withColumn("shape", shape)


@query("C2_duplicate_windows", _WINDOWS.format(units=_SHAPED.format(units="p_units")))
def _(t):
    return clones.duplicate_windows(_shaped(t.view("p_units")), 4, 6)


@query(
    "C2_duplicate_windows_all_sizes",
    """WITH w AS (SELECT a.unit_id, a.ord AS start_ord, b.ord AS end_ord, b.ord - a.ord + 1 AS size,
          (SELECT string_agg(c.shape, ' ' ORDER BY c.ord) FROM p_units c WHERE c.unit_id = a.unit_id AND c.ord BETWEEN a.ord AND b.ord) AS preview
          FROM p_units a JOIN p_units b ON a.unit_id = b.unit_id AND b.ord - a.ord >= 3)
        SELECT size, count(*) OVER v AS n_occurrences, false AS has_exit, preview, unit_id, start_ord, end_ord FROM w
        WINDOW v AS (PARTITION BY size, preview) QUALIFY count(*) OVER v > 1""",
)
def _(t):
    return clones.duplicate_windows(t.view("p_units"), 4, None).drop("window_key")


_LITERAL_GROUPS = r"""SELECT text, count(*) AS n_occurrences, min(path) AS first_path FROM p_lines
        WHERE length(text) >= 3 AND regexp_matches(text, '\S') AND NOT regexp_matches(text, '^@[\p{L}\p{N}_]+$')
        AND NOT regexp_matches(path, '(?i)test|spec') GROUP BY 1 HAVING count(*) >= 3"""


@query(
    "C3_repeated_literals",
    f"""SELECT text, n_occurrences, first_path, CASE WHEN name = '' THEN 'MagicString' ELSE name END AS constant_name FROM (
        SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda w: w <> ''),
          lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), '') AS name FROM ({_LITERAL_GROUPS}))""",
)
def _(t):
    return clones.repeated_literals(t.view("p_lines"))


@query(
    "C3_literal_sites",
    f"""SELECT path, line_no, text, n_occurrences FROM p_lines JOIN ({_LITERAL_GROUPS}) g USING (text)
        WHERE NOT regexp_matches(path, '(?i)test|spec')""",
)
def _(t):
    return clones.literal_sites(t.view("p_lines")).select("path", "line_no", "text", "n_occurrences")


@query(
    "C4_duplicate_windows_in_hierarchy",
    """WITH up AS (SELECT CAST(3 AS BIGINT) AS c UNION SELECT t.dst FROM up JOIN p_tree t ON t.src = up.c),
        down AS (SELECT CAST(3 AS BIGINT) AS c UNION SELECT t.src FROM down JOIN p_tree t ON t.dst = down.c),
        fam AS (SELECT * FROM p_units WHERE container IN (SELECT c FROM up UNION SELECT c FROM down)) """
    + _WINDOWS.format(units=_SHAPED.format(units="fam")),
)
def _(t):
    return clones.duplicate_windows_in_hierarchy(_shaped(t.view("p_units")), t.view("p_tree"), 3, 4, 6)


_FAMILY = """up AS (SELECT CAST(3 AS BIGINT) AS c UNION SELECT t.dst FROM up JOIN p_tree t ON t.src = up.c),
        down AS (SELECT CAST(3 AS BIGINT) AS c UNION SELECT t.src FROM down JOIN p_tree t ON t.dst = down.c),
        fam AS (SELECT * FROM p_units WHERE container IN (SELECT c FROM up UNION SELECT c FROM down)),
        shaped AS """ + _SHAPED.format(units="fam")
# Windows of all sizes from four elements on, with their shapes in order.
_ALL_WINDOWS = """w AS (SELECT a.unit_id, a.ord AS start_ord, b.ord AS end_ord, b.ord - a.ord + 1 AS size,
          (SELECT list(c.shape ORDER BY c.ord) FROM {units} c WHERE c.unit_id = a.unit_id AND c.ord BETWEEN a.ord AND b.ord) AS shapes
          FROM {units} a JOIN {units} b ON a.unit_id = b.unit_id AND b.ord - a.ord >= 3)"""


@query(
    "C4_duplicate_windows_in_hierarchy_all_sizes",
    "WITH " + _FAMILY + ", " + _ALL_WINDOWS.format(units="shaped") + """
        SELECT size, count(*) OVER v AS n_occurrences, list_has_any(shapes, ['return', 'throw']) AS has_exit,
          substr(array_to_string(shapes, ' '), 1, 120) AS preview, unit_id, start_ord, end_ord
        FROM w WINDOW v AS (PARTITION BY size, shapes) QUALIFY count(*) OVER v > 1""",
)
def _(t):
    return clones.duplicate_windows_in_hierarchy(_shaped(t.view("p_units")), t.view("p_tree"), 3).drop("window_key")


# --- graphs -------------------------------------------------------------------------

_ROOTS = "SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND p_size > 40"


def _roots(t):
    part = t.table("part").where("p_brand = 'Brand#1' AND p_size > 40")
    return part.select(F.col("p_partkey").alias("node"))


@query(
    "G1_reach_forward",
    f"""WITH r AS (SELECT p_partkey AS root, p_partkey AS node, CAST(0 AS BIGINT) AS depth FROM ({_ROOTS})
          UNION SELECT root, dst, depth + 1 FROM r JOIN p_edges ON src = node WHERE depth < 3)
        SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2""",
)
def _(t):
    return graph.reach_forward(t.view("p_edges"), _roots(t), 3)


@query(
    "G2_reach_reverse",
    f"""WITH imp AS (SELECT src AS member, dst AS interface_member FROM p_tree),
        e AS (SELECT src, dst FROM p_edges UNION SELECT src, member FROM p_edges JOIN imp ON dst = interface_member),
        r AS (SELECT p_partkey AS root, p_partkey AS node, CAST(0 AS BIGINT) AS depth FROM ({_ROOTS})
          UNION SELECT root, src, depth + 1 FROM r JOIN e ON dst = node WHERE depth < 3)
        SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2""",
)
def _(t):
    implements = t.view("p_tree").select(F.col("src").alias("member"), F.col("dst").alias("interface_member"))
    return graph.reach_reverse(t.view("p_edges"), _roots(t), 3, implements)


@query(
    "G3_blast_radius",
    """SELECT symbol_id, count(*) AS n_references, count(DISTINCT path) AS n_files, count(DISTINCT project) AS n_projects,
        bool_or(regexp_matches(path, '99[.]cs$')) AS touches_test FROM p_refs GROUP BY 1""",
)
def _(t):
    return graph.blast_radius(t.view("p_refs"), F.col("path").rlike("99[.]cs$"))


@query(
    "G3_touched_files",
    "SELECT symbol_id, project, path, count(*) AS n_references FROM p_refs GROUP BY ALL",
)
def _(t):
    return graph.touched_files(t.view("p_refs"))


_SCC = """closure AS (SELECT src AS a, dst AS b FROM p_edges UNION SELECT a, dst FROM closure JOIN p_edges ON src = b),
        scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a AND x.a <> x.b GROUP BY x.a)"""


@query(
    "G4_cycles",
    f"""WITH {_SCC},
        inside AS (SELECT DISTINCT s.component, src, dst FROM p_edges JOIN scc s ON s.node = src JOIN scc d ON d.node = dst
          WHERE s.component = d.component AND src <> dst),
        paths AS (SELECT component, src AS f, dst AS l, [src, dst] AS path FROM inside WHERE src < dst
          UNION ALL SELECT p.component, f, dst, list_append(path, dst) FROM paths p JOIN inside i ON i.src = p.l
          WHERE dst > f AND NOT list_contains(path, dst) AND len(path) < 8),
        closed AS (SELECT p.component, path FROM paths p JOIN inside i ON i.src = p.l AND i.dst = p.f),
        best AS (SELECT component, min(struct_pack(n := len(path), p := path)) AS b FROM closed GROUP BY 1)
        SELECT best.component, (SELECT count(*) FROM scc WHERE scc.component = best.component) AS n_nodes, b.n AS cycle_length,
          CASE WHEN b.n = 2 THEN 'Direct' ELSE 'Transitive' END AS kind,
          concat(array_to_string(b.p, '->'), '->', b.p[1]) AS cycle FROM best""",
)
def _(t):
    return graph.cycles(t.view("p_edges"))


@query(
    "G5_mutual_recursion",
    """WITH e AS (SELECT DISTINCT src, dst FROM p_edges WHERE src <> dst),
        paths AS (SELECT src AS f, dst AS l, [src, dst] AS path FROM e WHERE src < dst
          UNION ALL SELECT f, dst, list_append(path, dst) FROM paths JOIN e ON src = l WHERE dst > f AND NOT list_contains(path, dst) AND len(path) < 5),
        closed AS (SELECT path FROM paths JOIN e ON src = l AND dst = f),
        best AS (SELECT min(path) AS p FROM closed GROUP BY list_sort(path))
        SELECT len(p) AS cycle_length, concat(array_to_string(p, '->'), '->', p[1]) AS cycle FROM best""",
)
def _(t):
    return graph.mutual_recursion(t.view("p_edges"))


@query(
    "G6_self_recursion",
    """SELECT DISTINCT src AS symbol_id FROM p_call_edges WHERE src = dst
        AND src NOT IN (SELECT symbol_id FROM p_params WHERE name = 'P1')
        AND src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)""",
)
def _(t):
    names = t.view("p_params").withColumn("name", F.when(F.col("name") == "P1", "maxDepth").otherwise(F.col("name")))
    guards = t.table("supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("symbol_id"))
    return graph.self_recursion(t.view("p_call_edges"), names, guards)


@query(
    "G7_chain_depth_tree",
    """WITH e AS (SELECT dst AS src, src AS dst FROM p_tree), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
        d AS (SELECT node, CAST(1 AS BIGINT) AS depth FROM n UNION SELECT src, depth + 1 FROM d JOIN e ON dst = node)
        SELECT node, max(depth) AS depth FROM d GROUP BY 1 HAVING max(depth) >= 4""",
)
def _(t):
    downward = t.view("p_tree").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.chain_depth(downward, 4)


@query(
    "G7_chain_depth",
    f"""WITH {_SCC}, n AS (SELECT src AS node FROM p_edges UNION SELECT dst FROM p_edges),
        e AS (SELECT src, dst FROM p_edges LEFT JOIN scc s ON s.node = src LEFT JOIN scc t ON t.node = dst
          WHERE src <> dst AND (s.component IS NULL OR t.component IS NULL OR s.component <> t.component)),
        d AS (SELECT node, CAST(1 AS BIGINT) AS depth FROM n UNION SELECT src, depth + 1 FROM d JOIN e ON dst = node)
        SELECT node, max(depth) AS depth FROM d GROUP BY 1 HAVING max(depth) >= 5""",
)
def _(t):
    return graph.chain_depth(t.view("p_edges"), 5)


_HIERARCHY = """h AS (SELECT src AS type, dst AS ancestor, CAST(1 AS BIGINT) AS depth FROM p_tree
        UNION SELECT type, dst, depth + 1 FROM h JOIN p_tree ON src = ancestor)"""


@query("G8_hierarchy", f"WITH {_HIERARCHY} SELECT type, ancestor, depth FROM h")
def _(t):
    return graph.hierarchy(t.view("p_tree"))


@query(
    "G8_hierarchy_summary",
    f"""WITH {_HIERARCHY}, types AS (SELECT src AS type FROM p_tree UNION SELECT dst FROM p_tree)
        SELECT type, (SELECT count(*) FROM h WHERE h.type = t.type) AS n_ancestors,
          (SELECT count(*) FROM p_tree WHERE src = t.type) AS n_bases, false AS in_cycle,
          (SELECT count(*) FROM h WHERE h.ancestor = t.type) AS n_descendants,
          (SELECT count(*) FROM p_tree WHERE src = t.type) = 0 AS is_root,
          (SELECT count(*) FROM p_tree WHERE dst = t.type) = 0 AS is_leaf FROM types t""",
)
def _(t):
    return graph.hierarchy_summary(t.view("p_tree"))


@query(
    "G9_implementation_coverage",
    """WITH owed AS (SELECT DISTINCT type, interface, signature FROM p_implementations JOIN p_interface USING (interface)),
        c AS (SELECT o.*, m.signature IS NOT NULL AS implemented FROM owed o LEFT JOIN p_members m ON m.type = o.type AND m.signature = o.signature)
        SELECT *, bool_and(implemented) OVER (PARTITION BY type) AS is_fully_complete FROM c""",
)
def _(t):
    return graph.implementation_coverage(t.view("p_interface"), t.view("p_implementations"), t.view("p_members"))


@query(
    "G10_project_dependencies",
    """SELECT DISTINCT project, 'package' AS kind, package AS target, CAST(version AS VARCHAR) AS version FROM p_packages
        UNION SELECT DISTINCT CAST(src AS VARCHAR), 'project', CAST(dst AS VARCHAR), NULL FROM p_edges""",
)
def _(t):
    edges = t.view("p_edges").select(F.col("src").cast("string"), F.col("dst").cast("string"))
    return graph.project_dependencies(edges, t.view("p_packages"))


# --- relational ---------------------------------------------------------------------


@query(
    "R1_unused_definitions",
    """SELECT symbol_id, name, kind, container FROM p_odefs d WHERE
        (((kind IN ('method', 'property', 'field') AND accessibility = 'private')
          OR (kind = 'constructor' AND container IN (SELECT container FROM p_odefs WHERE kind = 'constructor' GROUP BY 1 HAVING count(*) > 1)))
         AND symbol_id NOT IN (SELECT symbol_id FROM p_orefs))
        OR (kind = 'local' AND symbol_id NOT IN (SELECT symbol_id FROM p_orefs WHERE ref_kind = 'read'))""",
)
def _(t):
    found = relational.unused_definitions(t.view("p_odefs"), t.view("p_orefs"))
    return found.select("symbol_id", "name", "kind", "container")


@query(
    "R2_uninstantiated_types",
    """SELECT symbol_id, name FROM p_odefs WHERE kind = 'type'
        AND symbol_id NOT IN (SELECT symbol_id FROM p_orefs WHERE ref_kind = 'create')""",
)
def _(t):
    return relational.uninstantiated_types(t.view("p_odefs"), t.view("p_orefs")).select("symbol_id", "name")


@query(
    "R3_unimplemented_interfaces",
    """SELECT symbol_id, name FROM p_odefs WHERE kind = 'type' AND accessibility = 'internal' AND name NOT IN (
        SELECT concat('m', CAST(dst AS VARCHAR)) FROM p_oedges)""",
)
def _(t):
    definitions = t.view("p_odefs")
    edges = t.view("p_oedges").select("src", F.concat(F.lit("m"), F.col("dst").cast("string")).alias("dst"))
    internal_type = (F.col("kind") == "type") & (F.col("accessibility") == "internal")
    interfaces = definitions.withColumn("kind", F.when(internal_type, "interface").otherwise(F.col("kind")))
    return relational.unimplemented_interfaces(interfaces, edges).select("symbol_id", "name")


@query(
    "R4_unused_dependencies",
    """SELECT p.project, p.package, p.version FROM p_packages p LEFT JOIN p_package_uses u
        ON u.project = p.project AND u.package = p.package WHERE u.project IS NULL""",
)
def _(t):
    return relational.unused_dependencies(t.view("p_packages"), t.view("p_package_uses"))


@query(
    "R5_unregistered_services",
    r"""WITH names AS (SELECT lower(service) AS k FROM p_service_names UNION SELECT lower(replace(implementation, 'Acme.', '')) FROM p_service_names),
        i AS (SELECT *, regexp_extract(split_part(type, '<', 1), '[^.]*$') AS simple FROM p_injected)
        SELECT consumer, type, path FROM i WHERE lower(simple) <> 'ienumerable' AND NOT starts_with(lower(simple), 'ilogger')
        AND (regexp_matches(simple, '^I[A-Z]') OR regexp_matches(lower(simple), '(service|repository|manager|factory|provider|handler|validator|dispatcher)$'))
        AND NOT regexp_matches(path, '\.Tests\.|Tests/') AND lower(simple) NOT IN (SELECT k FROM names)""",
)
def _(t):
    return relational.unregistered_services(t.view("p_injected"), t.view("p_service_names"))


@query(
    "R6_captive_dependencies",
    """SELECT consumer, dependency, d.lifetime AS dependency_lifetime FROM p_ctor
        JOIN p_registrations c ON c.service = consumer AND c.lifetime = 'Singleton'
        JOIN p_registrations d ON d.service = dependency AND d.lifetime IN ('Scoped', 'Transient')""",
)
def _(t):
    registrations = t.view("p_registrations")
    # A second, later registration of every service, which must lose.
    later = registrations.select("service", F.lit("Singleton").alias("lifetime"), (F.col("ord") + 100).alias("ord"))
    return relational.captive_dependencies(t.view("p_ctor"), registrations.union(later))


@query(
    "R7_obsolete_callers",
    """SELECT r.symbol_id, r.caller_id, r.path, r.line, d.name AS obsolete_name, d.obsolete_message FROM p_refs r
        JOIN p_symbols d ON d.symbol_id = r.symbol_id WHERE contains(lower(obsolete_message), 'bridge')""",
)
def _(t):
    calls = relational.obsolete_callers(t.view("p_symbols"), t.view("p_refs"), "Bridge")
    return calls.select("symbol_id", "caller_id", "path", "line", "obsolete_name", "obsolete_message")


@query(
    "R8_layer_violations",
    """SELECT namespace, imported, path, line, lower(split_part(namespace, '.', 2)) AS source_layer, lower(split_part(imported, '.', 2)) AS target_layer
        FROM p_layers WHERE (split_part(namespace, '.', 2) IN ('Controllers', 'Domain') AND split_part(imported, '.', 2) IN ('Data', 'Repositories', 'Migrations'))
        OR (split_part(namespace, '.', 2) = 'Services' AND split_part(imported, '.', 2) = 'Migrations')""",
)
def _(t):
    return relational.layer_violations(t.view("p_layers"))


@query(
    "R9_version_conflicts",
    """SELECT DISTINCT package, project, version, n AS n_versions FROM p_packages JOIN
        (SELECT package, count(DISTINCT version) AS n FROM p_packages GROUP BY 1 HAVING count(DISTINCT version) > 1) USING (package)""",
)
def _(t):
    return relational.version_conflicts(t.view("p_packages"))


@query(
    "R10_dominant_value_outliers",
    """WITH top AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 1)
        SELECT p_partkey AS entity, p_type AS value, v AS dominant_value, n AS dominant_count FROM part, top WHERE p_type <> v""",
)
def _(t):
    return relational.dominant_value_outliers(t.table("part"), "p_partkey", "p_type")


_PREFIX_NAMES = "SELECT n_name AS project FROM nation UNION SELECT r_name FROM region"


@query(
    "R11_naming_prefix_outliers",
    f"""WITH names AS ({_PREFIX_NAMES}), top AS (SELECT split_part(project, '_', 1) AS p, count(*) AS n FROM names GROUP BY 1 ORDER BY n DESC, p LIMIT 1)
        SELECT project, p AS dominant_prefix, n AS prefix_count FROM names, top
        WHERE n >= greatest(2, (SELECT count(*) FROM names) // 4) AND NOT starts_with(project, p)""",
)
def _(t):
    names = t.table("nation").select("n_name").union(t.table("region").select("r_name")).toDF("project")
    return relational.naming_prefix_outliers(names, "_")


@query(
    "R12_missing_cases",
    """WITH s AS (SELECT switch_id, enum_type FROM p_switches WHERE NOT has_default),
        h AS (SELECT switch_id, count(*) AS n_handled FROM p_switch_labels GROUP BY 1)
        SELECT s.switch_id, s.enum_type, (SELECT count(*) FROM p_enum) AS n_members, coalesce(h.n_handled, 0) AS n_handled, member AS missing
        FROM s JOIN p_enum USING (enum_type) LEFT JOIN h ON h.switch_id = s.switch_id
        LEFT JOIN p_switch_labels l ON l.switch_id = s.switch_id AND l.label = member WHERE l.label IS NULL""",
)
def _(t):
    return relational.missing_cases(t.view("p_switches"), t.view("p_enum"), t.view("p_switch_labels"))


_COVERS = """names AS (SELECT DISTINCT lower(name) AS method FROM p_test_targets),
        by_name AS (SELECT method, symbol_id AS test_id, 'name' AS via FROM names JOIN p_tests ON contains(lower(name), method)),
        by_call AS (SELECT DISTINCT method, src AS test_id, 'call' AS via FROM p_test_calls JOIN names ON method = lower(dst)
          JOIN p_tests ON symbol_id = src WHERE NOT contains(lower(name), method)),
        covers AS (SELECT * FROM by_name UNION ALL SELECT * FROM by_call)"""


@query("R13_test_coverage_map", f"WITH {_COVERS} SELECT method, test_id, via FROM covers")
def _(t):
    return relational.test_coverage_map(t.view("p_test_targets"), t.view("p_tests"), t.view("p_test_calls"))


@query(
    "R13_method_coverage",
    f"""WITH {_COVERS}, n AS (SELECT method, count(*) AS n FROM covers GROUP BY 1)
        SELECT symbol_id, name, coalesce(n, 0) AS n_tests, coalesce(n, 0) > 0 AS has_tests
        FROM p_test_targets LEFT JOIN n ON method = lower(name)""",
)
def _(t):
    return relational.method_coverage(t.view("p_test_targets"), t.view("p_tests"), t.view("p_test_calls"))


@query(
    "R14_readonly_candidates",
    """SELECT symbol_id, name, container FROM p_odefs WHERE kind = 'field' AND accessibility = 'private'
        AND NOT list_contains(modifiers, 'readonly')
        AND symbol_id NOT IN (SELECT symbol_id FROM p_orefs WHERE ref_kind = 'write' AND NOT in_constructor)""",
)
def _(t):
    found = relational.readonly_candidates(t.view("p_odefs"), t.view("p_orefs"))
    return found.select("symbol_id", "name", "container")


@query(
    "R15_unpaired_subscriptions",
    """SELECT l_suppkey AS path, l_partkey AS event, l_linestatus AS handler, l_orderkey AS line FROM lineitem a WHERE l_returnflag = 'A'
        AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey AND b.l_linestatus = a.l_linestatus)""",
)
def _(t):
    kind = F.when(F.col("l_returnflag") == "A", "subscribe").when(F.col("l_returnflag") == "R", "unsubscribe")
    references = t.table("lineitem").select(
        F.col("l_suppkey").alias("path"),
        F.col("l_partkey").alias("event"),
        F.col("l_linestatus").alias("handler"),
        F.col("l_orderkey").alias("line"),
        kind.alias("ref_kind"),
    )
    return relational.unpaired_subscriptions(references).drop("ref_kind")


@query(
    "R16_missing_token_forwarding",
    """WITH tok AS (SELECT DISTINCT symbol_id FROM p_params WHERE type = 'CancellationToken')
        SELECT DISTINCT d.symbol_id, d.name, d.container, e.dst AS callee FROM p_odefs d JOIN p_oedges e ON e.src = d.symbol_id
        WHERE kind = 'method' AND (list_contains(modifiers, 'async') OR starts_with(return_type, 'Task')) AND NOT list_contains(modifiers, 'abstract')
        AND d.symbol_id NOT IN (SELECT symbol_id FROM tok) AND e.dst IN (SELECT symbol_id FROM tok)
        AND d.symbol_id NOT IN (SELECT symbol_id FROM p_params WHERE ord = 2 AND contains(type, 'EventArgs'))""",
)
def _(t):
    return relational.missing_token_forwarding(t.view("p_odefs"), t.view("p_params"), t.view("p_oedges"))


@query(
    "R17_namespace_path_mismatches",
    """WITH f AS (SELECT * FROM p_namespaces), s AS (SELECT * FROM f WHERE n_namespaces <= 1),
        owners AS (SELECT concat(coalesce(declared_ns, ''), '.', type_name) AS fqn, count(DISTINCT s.path) AS n FROM s JOIN p_ns_types t ON t.path = s.path GROUP BY 1),
        confl AS (SELECT s.path, CAST(sum(n) AS BIGINT) AS n FROM s JOIN p_ns_types t ON t.path = s.path JOIN owners ON fqn = concat(expected_ns, '.', type_name)
          WHERE lower(declared_ns) <> lower(expected_ns) GROUP BY 1),
        direct AS (SELECT f.path, declared_ns, expected_ns, coalesce(confl.n, 0) AS n_conflicts,
            CASE WHEN n_namespaces > 1 THEN 'MultipleNamespacesInFile' WHEN declared_ns IS NULL THEN 'GlobalNamespace'
              WHEN confl.n IS NOT NULL THEN 'DuplicateTypeAtMismatchedPath' ELSE 'NamespaceFolderMismatch' END AS reason
          FROM f LEFT JOIN confl ON confl.path = f.path
          WHERE n_namespaces > 1 OR declared_ns IS NULL OR lower(declared_ns) <> lower(expected_ns)),
        spread AS (SELECT min(s.path) AS path, count(DISTINCT s.path) - 1 AS n_conflicts FROM s JOIN p_ns_types t ON t.path = s.path
          WHERE is_partial AND declared_ns IS NOT NULL GROUP BY type_name HAVING count(DISTINCT lower(declared_ns)) > 1),
        partial AS (SELECT x.path, declared_ns, '' AS expected_ns, max(x.n_conflicts) AS n_conflicts, 'PartialClassAcrossNamespaces' AS reason
          FROM spread x JOIN s ON s.path = x.path WHERE x.path NOT IN (SELECT path FROM direct) GROUP BY 1, 2)
        SELECT path, declared_ns, expected_ns, reason, n_conflicts, CASE WHEN reason = 'DuplicateTypeAtMismatchedPath' THEN 'Error' ELSE 'Warning' END AS severity
        FROM (SELECT * FROM direct UNION ALL SELECT * FROM partial)""",
)
def _(t):
    return relational.namespace_path_mismatches(_namespaces(t), t.view("p_ns_types"))


@query(
    "R17_namespace_conflicts",
    """WITH s AS (SELECT * FROM p_namespaces WHERE n_namespaces <= 1)
        SELECT DISTINCT a.path, ta.type_name, b.path AS conflicting_path FROM s a JOIN p_ns_types ta ON ta.path = a.path
        JOIN p_ns_types tb ON tb.type_name = ta.type_name JOIN s b ON b.path = tb.path AND b.declared_ns = a.expected_ns
        WHERE lower(a.declared_ns) <> lower(a.expected_ns) AND a.path <> b.path""",
)
def _(t):
    return relational.namespace_conflicts(_namespaces(t), t.view("p_ns_types"))


def _namespaces(t):
    return t.view("p_namespaces")


@query(
    "R18_file_structure_smells",
    """WITH f AS (SELECT project, concat('src/n', CAST(line // 100 AS VARCHAR), '/T1.cs') AS path, count(*) AS n_types,
          min(struct_pack(l := line, n := type_name)).n AS first_type FROM p_ns_types GROUP BY 1, 2)
        SELECT *, 'MULTI_TYPE' AS smell FROM f WHERE n_types > 1 UNION ALL SELECT *, 'NAME_MISMATCH' FROM f WHERE first_type <> 'T1'""",
)
def _(t):
    path = F.concat(F.lit("src/n"), F.expr("line div 100").cast("string"), F.lit("/T1.cs"))
    types = t.view("p_ns_types").select("project", path.alias("path"), F.col("type_name").alias("name"), "line")
    return relational.file_structure_smells(types)


@query(
    "R19_single_file_internals",
    """SELECT d.symbol_id, name, count(DISTINCT r.path) AS n_files FROM p_odefs d LEFT JOIN p_orefs r ON r.symbol_id = d.symbol_id
        WHERE d.kind = 'type' AND accessibility = 'internal' GROUP BY 1, 2 HAVING count(DISTINCT r.path) <= 1""",
)
def _(t):
    found = relational.single_file_internals(t.view("p_odefs"), t.view("p_orefs"))
    return found.select("symbol_id", "name", "n_files")


@query(
    "R20_mutable_public_properties",
    """SELECT symbol_id, name, container FROM p_symbols WHERE kind = 'property' AND accessibility = 'public' AND has_public_setter
        AND NOT list_contains(modifiers, 'static') AND NOT contains(container, 'Request')
        AND container IN (SELECT name FROM p_symbols WHERE kind = 'type' AND accessibility = 'public')""",
)
def _(t):
    return relational.mutable_public_properties(t.view("p_symbols")).select("symbol_id", "name", "container")


@query(
    "R21_unbounded_static_collections",
    """SELECT symbol_id, name, container FROM p_symbols WHERE kind = 'field' AND list_contains(modifiers, 'static')
        AND contains(return_type, 'Dictionary') AND symbol_id IN (SELECT symbol_id FROM p_refs WHERE member = 'Add')
        AND symbol_id NOT IN (SELECT symbol_id FROM p_refs WHERE member = 'Clear')""",
)
def _(t):
    found = relational.unbounded_static_collections(t.view("p_symbols"), t.view("p_refs"))
    return found.select("symbol_id", "name", "container")
