"""Views of the driver's tables in the shape of the fact tables.

The SQL runs unchanged in Spark and DuckDB. Every view covers its whole tables. ``p_lines``
is the one view with a dialect of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codescope.sources.files import explode_lines

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

_CONTAINER = "concat('T', replace(p_brand, 'Brand#', ''), CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'Request' ELSE '' END)"
_BRAND_NO = "CAST(replace(p_brand, 'Brand#', '') AS BIGINT)"

VIEWS = {
    "p_files": """
        SELECT source AS project, concat('src/', source, '/', lang, '/doc_', CAST(doc_id AS STRING),
               CASE WHEN lang = 'de' THEN 'Tests' ELSE '' END, '.txt') AS path,
               doc_id, text AS content
        FROM documents""",
    "p_symbols": f"""
        SELECT p_partkey AS symbol_id,
               concat(CASE p_size % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'On' WHEN 2 THEN '_x' ELSE 'Do' END,
                      CAST(p_partkey AS STRING), CASE WHEN p_size % 6 = 0 THEN 'Async' ELSE '' END) AS name,
               CASE p_type WHEN 'PROMO' THEN 'property' WHEN 'STANDARD' THEN 'field' WHEN 'SMALL' THEN 'constructor'
                    WHEN 'MEDIUM' THEN 'event' ELSE 'method' END AS kind,
               {_CONTAINER} AS container,
               concat('Acme.', p_type) AS namespace,
               concat('src', CAST(p_partkey % 20 AS STRING)) AS project,
               concat('src/', p_brand, '/', p_name, '.cs') AS path,
               p_size AS line, p_size * 12 AS end_line,
               CASE p_partkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'internal' END AS accessibility,
               CASE WHEN p_size % 5 = 0 THEN split('static', ' ') WHEN p_size % 7 = 0 THEN split('async virtual', ' ')
                    WHEN p_size % 11 = 0 THEN split('abstract', ' ') ELSE split('partial', ' ') END AS modifiers,
               concat(p_type, ' ', p_name) AS signature,
               CASE p_size % 3 WHEN 0 THEN concat('Task<', p_type, '>') WHEN 1 THEN 'void'
                    ELSE 'System.Dictionary<int>' END AS return_type,
               split('Base', ' ') AS base_types,
               split(p_name, ' ') AS attributes,
               p_size % 2 = 0 AS has_public_setter,
               CASE WHEN p_size > 45 THEN concat('Async-bridge: ', p_name) WHEN p_size > 40 THEN 'old' END AS obsolete_message
        FROM part
        UNION ALL
        SELECT -{_BRAND_NO}, {_CONTAINER}, 'type', {_CONTAINER}, 'Acme', 'src0',
               concat('src/', p_brand, '.cs'), 1, 900,
               CASE {_BRAND_NO} % 3 WHEN 0 THEN 'internal' ELSE 'public' END,
               split('partial', ' '), concat('class ', p_brand), '',
               CASE WHEN {_BRAND_NO} % 4 = 0 THEN split('Base', ' ') END, split('', ' '), false, NULL
        FROM (SELECT DISTINCT p_brand FROM part) AS brands""",
    "p_refs": """
        SELECT l_partkey AS symbol_id, l_suppkey AS caller_id, concat('src/o', CAST(l_orderkey AS STRING), '.cs') AS path,
               concat('src', CAST(l_suppkey % 20 AS STRING)) AS project, l_linenumber AS line,
               CAST(l_quantity AS BIGINT) AS col,
               CASE l_returnflag WHEN 'A' THEN 'create' WHEN 'N' THEN 'read' ELSE 'write' END AS ref_kind,
               l_linestatus = 'F' AS in_constructor, concat('  ', l_returnflag, l_linestatus, ' ') AS text,
               CASE WHEN l_quantity = 50 AND l_discount > 0.085 THEN 'Clear' WHEN l_returnflag = 'A' THEN 'Add'
                    ELSE 'Get' END AS member
        FROM lineitem""",
    "p_typed_refs": """
        SELECT p_type AS type, l_orderkey AS path, l_linenumber AS line, l_partkey AS symbol_id,
               CASE l_returnflag WHEN 'A' THEN 'create' WHEN 'N' THEN 'throw' ELSE 'write' END AS ref_kind
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "p_odefs": """
        SELECT o_orderkey AS symbol_id, concat('m', CAST(o_orderkey AS STRING)) AS name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'method' WHEN '2-HIGH' THEN 'property' WHEN '3-MEDIUM' THEN 'field'
                    WHEN '4-NOT SPECIFIED' THEN 'constructor'
                    ELSE CASE o_orderstatus WHEN 'O' THEN 'type' ELSE 'local' END END AS kind,
               o_custkey AS container, concat('src/c', CAST(o_custkey AS STRING), '.cs') AS path,
               o_orderkey AS line,
               CASE o_orderstatus WHEN 'O' THEN 'internal' WHEN 'F' THEN 'private' ELSE 'public' END AS accessibility,
               CASE o_custkey % 5 WHEN 0 THEN split('async', ' ') WHEN 1 THEN split('readonly', ' ')
                    WHEN 2 THEN split('abstract', ' ') ELSE split('partial', ' ') END AS modifiers,
               CASE WHEN o_totalprice > 250000 THEN 'Task<int>' ELSE 'void' END AS return_type
        FROM orders""",
    "p_orefs": """
        SELECT l_orderkey AS symbol_id, l_suppkey AS path, l_linenumber AS line,
               CASE l_returnflag WHEN 'A' THEN 'create' WHEN 'N' THEN 'read' ELSE 'write' END AS ref_kind,
               l_linestatus = 'F' AS in_constructor
        FROM lineitem""",
    "p_oedges": """
        SELECT o_orderkey AS src, (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM orders) AS dst FROM orders""",
    "p_edges": """
        SELECT p_partkey AS src, (p_partkey * 7 + p_size * 13 + 3) % (SELECT count(*) FROM part) AS dst FROM part
        UNION
        SELECT p_partkey, (p_partkey * 11 + p_size * p_size * 17 + 5) % (SELECT count(*) FROM part) FROM part""",
    "p_call_edges": """
        SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) AS dst FROM lineitem""",
    "p_tree": """
        SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part WHERE p_partkey > 0""",
    "p_units": """
        SELECT l_orderkey AS unit_id, l_orderkey % 50 AS container,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS ord,
               concat(l_returnflag, l_linestatus) AS shape
        FROM lineitem""",
    "p_usage": """
        SELECT DISTINCT o_custkey AS type_id, o_orderkey AS method, l_suppkey AS field
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    "p_params": """
        SELECT symbol_id, ord, concat(CASE WHEN quantity > 45 THEN 'P' ELSE 'p' END, CAST(ord AS STRING)) AS name,
               type, CASE WHEN quantity > 40 THEN 'out' ELSE '' END AS modifier
        FROM (SELECT l_orderkey AS symbol_id, l_quantity AS quantity,
                     CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS ord,
                     CASE l_returnflag WHEN 'A' THEN 'OrderService'
                          WHEN 'N' THEN CASE WHEN l_discount > 0.05 THEN 'CancellationToken' ELSE 'string' END
                          ELSE CASE WHEN l_discount > 0.085 THEN 'MouseEventArgs' ELSE 'int' END END AS type
              FROM lineitem) AS numbered""",
    "p_findings": """
        SELECT event_id, concat('src', CAST(user_id % 20 AS STRING)) AS project, event_type AS detector,
               CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Warning' WHEN 'view' THEN 'Warning'
                    WHEN 'signup' THEN 'Hidden' ELSE 'Info' END AS severity,
               user_id AS member, CAST(floor(value) AS BIGINT) - 10 AS score
        FROM events""",
    "p_outcomes": """
        SELECT event_id, CAST(CAST(ts AS DATE) AS STRING) AS change_id, user_id AS member,
               concat('src/', CAST(user_id % 7 AS STRING), '.cs') AS path, ts, event_type AS tool,
               CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'signup' THEN 'AlreadySatisfied'
                    WHEN 'view' THEN 'Skipped' WHEN 'error' THEN 'Failed' ELSE 'Blocked' END AS outcome,
               concat('phase:', CASE WHEN value > 20 THEN 'bridge' WHEN value > 10 THEN 'uplift' ELSE 'flag' END,
                      CASE event_type WHEN 'view' THEN ' below minScore' WHEN 'error' THEN ' Validation produced' ELSE ' event handler' END) AS reason
        FROM events""",
    "p_batches": """
        SELECT CAST(user_id AS STRING) AS session, CAST(CAST(ts AS DATE) AS STRING) AS batch_no,
               count(CASE WHEN event_type = 'purchase' THEN 1 END) AS succeeded,
               count(CASE WHEN event_type = 'error' THEN 1 END) AS failed,
               count(CASE WHEN event_type = 'click' THEN 1 END) AS rolled_back,
               count(CASE WHEN event_type IN ('view', 'signup') THEN 1 END) AS skipped
        FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "p_api_base": """
        SELECT DISTINCT 'Method' AS kind, p_brand AS container, concat(p_type, ' ', p_name) AS signature FROM part
        UNION SELECT 'Type', p_brand, concat('class ', p_brand) FROM part""",
    "p_api_cur": """
        SELECT DISTINCT 'Method' AS kind, p_brand AS container, concat(p_type, CASE WHEN p_size < 45 THEN ' ' ELSE '2 ' END, p_name) AS signature
        FROM part
        UNION SELECT 'Type', CASE WHEN p_brand = 'Brand#3' THEN 'Brand#33' ELSE p_brand END,
               CASE WHEN p_brand = 'Brand#5' THEN concat('class ', p_brand, ' : Base') ELSE concat('class ', p_brand) END FROM part""",
    "p_api_snapshots": """
        SELECT concat('C', CAST(o_custkey % 50 AS STRING)) AS container, concat(o_orderpriority, ' ', o_orderstatus) AS signature,
               CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS snapshot
        FROM orders""",
    "p_api_probes": """
        SELECT l_orderkey, l_linenumber, l_partkey, concat('C', CAST(o_custkey % 50 AS STRING)) AS container,
               concat(o_orderpriority, ' ', o_orderstatus) AS signature,
               CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS at
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "p_snap_a": """
        SELECT concat(CASE WHEN source = 'src3' THEN 'old/' ELSE '' END, CAST(doc_id AS STRING)) AS path,
               CASE WHEN source = 'src7' THEN NULL ELSE text END AS content FROM documents""",
    "p_snap_b": """
        SELECT concat(CASE WHEN source = 'src5' THEN 'new/' ELSE '' END, CAST(doc_id AS STRING)) AS path,
               CASE WHEN source = 'src7' AND lang <> 'fr' THEN NULL WHEN lang = 'en' THEN replace(text, 'the', 'THE') ELSE text END AS content FROM documents""",
    "p_packages": """
        SELECT p_brand AS project, p_name AS package, p_size AS version FROM part""",
    "p_package_uses": """
        SELECT DISTINCT p_brand AS project, CASE WHEN p_size % 7 = 0 THEN concat('other ', p_name) ELSE p_name END AS package
        FROM part JOIN lineitem ON l_partkey = p_partkey""",
    "p_layers": """
        SELECT concat('Acme.', CASE c_mktsegment WHEN 'BUILDING' THEN 'Controllers' WHEN 'MACHINERY' THEN 'Services'
                      WHEN 'HOUSEHOLD' THEN 'Domain' ELSE c_mktsegment END, '.', o_orderpriority) AS namespace,
               concat('Acme.', CASE s_nationkey % 5 WHEN 0 THEN 'Data' WHEN 1 THEN 'Repositories' WHEN 2 THEN 'Migrations'
                      ELSE 'Text' END, '.N', CAST(s_nationkey AS STRING)) AS imported,
               concat('src/o', CAST(o_orderkey AS STRING), '.cs') AS path, l_linenumber AS line
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON s_suppkey = l_suppkey""",
    "p_registrations": """
        SELECT CASE WHEN p_type = 'PROMO' THEN -p_partkey ELSE p_partkey END AS service,
               CASE p_size % 3 WHEN 0 THEN 'Singleton' WHEN 1 THEN 'Scoped' ELSE 'Transient' END AS lifetime, p_size AS ord
        FROM part""",
    "p_ctor": """
        SELECT DISTINCT a.l_partkey AS consumer, b.l_partkey AS dependency
        FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "p_injected": """
        SELECT l_orderkey AS consumer, concat('src/', CASE p_size WHEN 7 THEN 'Tests/' WHEN 8 THEN 'Acme.Tests.Unit/' WHEN 9 THEN 'Acme.Testsuite/' ELSE '' END, p_brand, '.cs') AS path,
               CASE p_size % 5 WHEN 0 THEN concat('Acme.IPart', CAST(p_partkey AS STRING), '<int>')
                    WHEN 1 THEN concat('part', CAST(p_partkey AS STRING), 'SERVICE')
                    WHEN 2 THEN concat('System.IEnumerable<IPart', CAST(p_partkey AS STRING), '>')
                    WHEN 3 THEN concat('ILogger<', CAST(p_partkey AS STRING), '>')
                    ELSE concat('Part', CAST(p_partkey AS STRING)) END AS type
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "p_service_names": """
        SELECT concat(CASE WHEN p_type = 'PROMO' THEN 'other' ELSE 'ipart' END, CAST(p_partkey AS STRING)) AS service,
               concat(CASE WHEN p_type = 'PROMO' THEN 'Acme.Other' ELSE 'Acme.Part' END, CAST(p_partkey AS STRING), 'Service') AS implementation
        FROM part""",
    "p_switches": """
        SELECT o_orderkey AS switch_id, 'part' AS enum_type, o_orderstatus = 'P' AS has_default FROM orders""",
    "p_enum": """
        SELECT DISTINCT 'part' AS enum_type, p_type AS member FROM part""",
    "p_switch_labels": """
        SELECT DISTINCT l_orderkey AS switch_id, p_type AS label FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "p_members": """
        SELECT DISTINCT p_brand AS type, p_name AS signature FROM part""",
    "p_interface": """
        SELECT DISTINCT p_type AS interface, p_name AS signature FROM part""",
    "p_implementations": """
        SELECT DISTINCT p_brand AS type, p_type AS interface FROM part""",
    "p_tests": """
        SELECT o_orderkey AS symbol_id, concat('Test', o_orderpriority, CAST(o_custkey AS STRING), 'Returns', o_orderstatus) AS name FROM orders""",
    "p_test_targets": """
        SELECT c_custkey AS symbol_id, concat(CASE WHEN c_custkey < 10 THEN '' ELSE 'urgent' END, CAST(c_custkey AS STRING)) AS name FROM customer""",
    "p_test_calls": """
        SELECT l_orderkey AS src, concat('URGENT', CAST(l_partkey AS STRING)) AS dst FROM lineitem""",
    "p_namespaces": """
        SELECT concat('src/doc_', CAST(doc_id AS STRING), '.cs') AS path,
               CASE WHEN n_chars < 200 THEN NULL ELSE concat(source, '.', lang) END AS declared_ns,
               concat(CASE WHEN n_chars % 2 = 0 THEN 'SRC' ELSE 'src' END, CAST((doc_id + n_chars % 2) % 20 AS STRING), '.', lang) AS expected_ns,
               CASE WHEN n_chars > 20000 THEN 2 ELSE 1 END AS n_namespaces
        FROM documents""",
    "p_ns_types": """
        SELECT concat('src/doc_', CAST(doc_id AS STRING), '.cs') AS path, concat('T', CAST(n_chars % 40 AS STRING)) AS type_name,
               n_chars % 40 < 20 AS is_partial, source AS project, CAST(n_chars AS BIGINT) AS line
        FROM documents""",
    "p_page_links": """
        SELECT page_id, url, html FROM pages""",
    "p_calls": """
        SELECT event_type AS tool, ts, event_id FROM events""",
    "p_candidates": """
        SELECT event_type AS pattern, concat('C', CAST(user_id AS STRING)) AS class_name, concat('src', CAST(user_id % 20 AS STRING)) AS project,
               event_id AS member, CAST(floor(value) AS BIGINT) - 10 AS score
        FROM events""",
}

_LINES_SQL = """
        SELECT project, path, doc_id, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no,
               unnest(string_split(content, chr(10))) AS text
        FROM p_files"""
_DEPENDS = {"p_lines": ["p_files"]}


class Source:
    """The driver's tables in one folder, and their views."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table as a stream, be it one file or a folder of parts: the pattern matches either,
        while a plain path must be a folder, and a filter on names never sees the parts."""
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.sf_dir}/{name}.parque[t]")

    def view(self, name: str) -> DataFrame:
        if name == "p_lines":
            return explode_lines(self.view("p_files"))
        sql = VIEWS[name]
        for table in TABLES:
            if re.search(rf"\b(?:FROM|JOIN) {table}\b", sql):
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(sql)


def oracle(sql: str) -> str:
    """DuckDB text of ``sql`` with the views it names defined in front."""
    names = []
    for name in re.findall(r"\bp_[a-z_]+\b", sql):
        for needed in [*_DEPENDS.get(name, []), name]:
            if needed not in names and (needed in VIEWS or needed == "p_lines"):
                names.append(needed)
    views = [f"{n} AS ({_LINES_SQL if n == 'p_lines' else VIEWS[n]})" for n in names]
    body = sql.strip()
    more = body[len("WITH "):] if body.startswith("WITH ") else None
    if more is not None:
        return "WITH RECURSIVE " + ",\n".join([*views, more])
    return ("WITH RECURSIVE " + ",\n".join(views) + "\n" + body) if views else body
