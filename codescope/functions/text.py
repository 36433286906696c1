"""Column helpers shared by the operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of a regular expression that can backtrack without bound.
BACKTRACKING_SHAPES = {
    "nested_quantifier": r"\([^)]*[+*]\)[+*]",
    "quantifier_in_alternation": r"\([^)]*[+*][^)]*\|[^)]*\)[+*]",
    "quantified_alternation": r"\((\w+\|)+\w+\)[+*]",
    "adjacent_wildcards": r"\.[+*]\.[+*]",
}

_GLOB_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
_GLOB_REGEX = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(glob: str) -> str:
    """Case-insensitive regex for a path glob; ``*`` and ``?`` stay within a segment."""
    tokens = _GLOB_TOKEN.findall(glob.replace("\\", "/"))
    return "(?i)^" + "".join(_GLOB_REGEX.get(t) or re.escape(t) for t in tokens) + "$"


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def glob_match(path: Column, glob: str) -> Column:
    """A glob without a slash tests the bare file name."""
    subject = F.replace(path, F.lit("\\"), F.lit("/")) if re.search(r"[\\/]", glob) else file_name(path)
    return subject.rlike(glob_regex(glob))


def contains_ci(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def ends_with_any(column: Column, suffixes: list[str]) -> Column:
    """Case-insensitive suffix test against a fixed list."""
    return column.rlike("(?i)(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def simple_type_name(column: Column) -> Column:
    """``Ns.Name<T>`` to ``Name``."""
    return F.substring_index(F.substring_index(column, "<", 1), ".", -1)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def preview(text: Column, limit: int = 120) -> Column:
    text = trimmed(text)
    cut = F.concat(F.substring(text, 1, limit), F.lit("…"))
    return F.when(F.char_length(text) > limit, cut).otherwise(text)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def check_pattern(pattern: str) -> str:
    """Refuse regexes of a shape that can backtrack without bound, for callers who take patterns
    from strangers: Spark has no regex timeout. Some harmless patterns have such a shape too."""
    for shape, signal in BACKTRACKING_SHAPES.items():
        if re.search(signal, pattern):
            raise ValueError(f"pattern refused ({shape}): {pattern}")
    return pattern
