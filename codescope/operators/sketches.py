"""Distinct counts from stored sketches that merge upward.

A snapshot's sketches are written once; counts of any coarser group, or over several snapshots,
come from them without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_SIZE = 14  # 2**14 registers: a standard error of 0.8 %


def distinct_sketches(rows: DataFrame, keys: Sequence[str], counted: Sequence[str], lg_size: int = LG_SIZE) -> DataFrame:
    """The keys with one sketch (binary, bounded by ``lg_size``) for each of ``counted``. Nulls
    are not counted; a group with nulls only has a sketch of nothing."""
    sketches = [F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(lg_size)).alias(c) for c in counted]
    return rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*sketches)


def merged_counts(sketches: DataFrame, keys: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """The keys with the estimated distinct values of all their sketches. Sketches are merged
    before they are shuffled; without keys there is one row."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(F.col(f"`{c}`"))).alias(f"n_{c}") for c in counted]
    return sketches.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*merged)
