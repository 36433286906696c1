"""Lexical rules as data for the rule scan.

A lexical rule reads one line (or one file) of text. It approximates a check on the syntax
tree: it sees neither scopes nor overloads nor comments.
"""

from __future__ import annotations

from dataclasses import dataclass

from codescope.sources.files import TEST_FOLDERS, TEST_SUFFIXES

_TEST_PATHS = r"(?i)(?:" + "|".join(TEST_SUFFIXES) + r")\.[^./\\]*$|[/\\](?:" + "|".join(TEST_FOLDERS) + r")[/\\]"


@dataclass(frozen=True)
class Rule:
    """One finding per text that matches ``regex`` and not ``unless``, in paths matching
    ``paths`` and not ``skip_paths``. ``whole_file`` rules read the file, not its lines.

    ``needs`` lists plain texts of which every match contains one. They are tested first:
    a substring test costs a fraction of a regex, and most lines fail it."""

    id: str
    domain: str
    severity: str
    regex: str
    message: str
    unless: str | None = None
    paths: str | None = None
    skip_paths: str | None = None
    whole_file: bool = False
    needs: tuple[str, ...] = ()


# Methods whose text argument reaches a database.
SQL_METHODS = [
    "ExecuteNonQuery", "ExecuteNonQueryAsync", "ExecuteReader", "ExecuteReaderAsync", "ExecuteScalar",
    "ExecuteScalarAsync", "ExecuteAsync", "Execute", "FromSqlRaw", "SqlQuery", "ExecuteSql", "ExecuteSqlRaw",
    "Query", "QueryAsync", "QuerySingle", "QuerySingleAsync", "QueryFirst", "QueryFirstAsync", "QueryMultiple",
    "QueryMultipleAsync", "ExecuteQuery",
]
# Calls that can take the predicate of a preceding Where.
WHERE_TERMINALS = ["First", "FirstOrDefault", "Last", "LastOrDefault", "Single", "SingleOrDefault", "Any", "Count"]

RULES = [
    Rule("task_void_usage", "async", "Warning", r"\basync\s+void\s+\w+", "async method returns void", needs=("async",)),
    Rule("blocking_calls_in", "async", "Warning", r"\bThread\.Sleep\(|\.Wait\(\)|\.GetAwaiter\(\)\.GetResult\(\)|\.Result\b(?!\s*\()", "blocking call", needs=("Thread.Sleep(", ".Wait()", ".GetAwaiter()", ".Result")),
    Rule("task_yield_usage", "async", "Info", r"\bTask\.Yield\(\)", "explicit yield", needs=("Task.Yield()",)),
    Rule("task_delay_usage", "async", "Info", r"\bTask\.Delay\(", "explicit delay", unless=r"\bTask\.Delay\(0\)", needs=("Task.Delay(",)),
    Rule("task_delay_zero_usage", "async", "Warning", r"\bTask\.Delay\(0\)", "delay of zero", needs=("Task.Delay(0)",)),
    Rule("task_run_in", "async", "Info", r"\bawait\s+Task\.Run\(", "awaited Task.Run", needs=("Task.Run(",)),
    Rule("empty_catch_blocks", "correctness", "Warning", r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}", "empty catch block", skip_paths=_TEST_PATHS, whole_file=True, needs=("catch",)),
    Rule("reflection_usage", "security", "Info", r"\.(?:GetProperty|GetMethod|GetField|GetCustomAttribute|Invoke)\b", "reflection", needs=(".GetProperty", ".GetMethod", ".GetField", ".GetCustomAttribute", ".Invoke")),
    Rule("inefficient_string_comparisons", "performance", "Info", r"\.To(?:Lower|Upper)\w*\(\)\s*[!=]=", "comparison by changing case", needs=(".ToLower", ".ToUpper")),
    Rule("weak_hash", "security", "Warning", r"\b(?:MD5|SHA1)\.", "weak hash", needs=("MD5.", "SHA1.")),
    Rule("generic_exception", "structure", "Info", r"\bthrow\s+new\s+Exception\(", "generic exception thrown", needs=("Exception(",)),
    Rule("lock_this", "structure", "Warning", r"\block\s*\(\s*this\s*\)", "lock on this", needs=("lock",)),
    Rule("wall_clock", "structure", "Info", r"\bDateTime\.(?:Now|UtcNow|Today)\b", "direct use of the clock", needs=("DateTime.",)),
    Rule("linq_redundant_where", "performance", "Info", r"\.Where\([^()]*\)\.(?:" + "|".join(WHERE_TERMINALS) + r")\(\)", "filter can move into the next call", needs=(".Where(",)),
    Rule("sql_injection", "security", "Error", r"\b(?:" + "|".join(SQL_METHODS) + r')\(\s*\$"', "interpolated text in a query", needs=('$"',)),
    Rule("legacy_guard", "structure", "Info", r"\bif\b.*\bthrow\s+new\s+Argument(?:Null|OutOfRange)Exception\b", "guard clause with an older form", needs=("Exception",)),
]
