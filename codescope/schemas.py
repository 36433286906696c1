"""Fact tables the operators read. Readers pass these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    # StructType.fromDDL needs a running session; the schemas must load without one.
    columns = (column.split() for column in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[type_name]) for name, type_name in columns])


FILES = _struct("project STRING, path STRING, content STRING")

LINES = _struct("project STRING, path STRING, line_no INT, text STRING")

DEFINITIONS = _struct(
    "symbol_id STRING, name STRING, kind STRING, container STRING, namespace STRING, "
    "project STRING, path STRING, line INT, end_line INT, accessibility STRING, "
    "modifiers ARRAY<STRING>, signature STRING, return_type STRING, "
    "base_types ARRAY<STRING>, attributes ARRAY<STRING>"
)

PARAMETERS = _struct("symbol_id STRING, ord INT, name STRING, type STRING, modifier STRING")

REFERENCES = _struct(
    "symbol_id STRING, ref_kind STRING, caller_id STRING, in_constructor BOOLEAN, "
    "project STRING, path STRING, line INT, col INT, text STRING"
)

EDGES = _struct("src STRING, dst STRING, kind STRING")

UNITS = _struct("unit_id STRING, container STRING, ord INT, shape STRING")

FINDINGS = _struct(
    "detector STRING, domain STRING, severity STRING, project STRING, path STRING, "
    "line INT, member STRING, message STRING, score INT"
)

OUTCOMES = _struct(
    "change_id STRING, batch_no BIGINT, tool STRING, path STRING, member STRING, "
    "outcome STRING, reason STRING, ts TIMESTAMP"
)

PACKAGES = _struct("project STRING, package STRING, version STRING")

TABLES = {
    "files": FILES,
    "lines": LINES,
    "definitions": DEFINITIONS,
    "parameters": PARAMETERS,
    "references": REFERENCES,
    "edges": EDGES,
    "units": UNITS,
    "findings": FINDINGS,
    "outcomes": OUTCOMES,
    "packages": PACKAGES,
}
