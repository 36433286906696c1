"""The innermost interval around a position, by one sweep in order (Q1, Q3).

Interval starts and positions are range-partitioned together, so a key with many of both is cut
into pieces. Each piece is swept alone with a stack of open intervals; what a piece needs of
earlier ones are the intervals still open at its first position, and only keys that cross a
border between pieces have any. Nothing is met pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codescope.session import cut_lineage, written

_FOUND = "key string, at long, names array<string>, holders array<string>, starts array<long>"


def _swept(kinds: list[str]):
    """Per position and kind the interval on top of the stack. An interval that ends no later
    than one that starts after it is never the innermost again, so stacks get shorter upwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stacks = None, []
        number = {kind: i for i, kind in enumerate(kinds)}
        for batch in batches:
            out = []
            for piece, key, at, what, upto, kind, name, holder in zip(*[batch.column(c).to_pylist() for c in _EVENT]):
                if (piece, key) != current:
                    current, stacks = (piece, key), [[] for _ in kinds]
                if what == 0:
                    stack = stacks[number[kind]]
                    while stack and stack[-1][0] <= upto:
                        stack.pop()
                    stack.append((upto, name, holder, at))
                    continue
                tops = []
                for stack in stacks:
                    while stack and stack[-1][0] < at:
                        stack.pop()
                    tops.append(stack[-1] if stack else (None, None, None, None))
                out.append((key, at, [t[1] for t in tops], [t[2] for t in tops], [t[3] for t in tops]))
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], names=["key", "at", "names", "holders", "starts"])

    return run


_EVENT = ["piece", "key", "at", "what", "upto", "kind", "name", "holder"]
_TYPES = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]


def _crossing(events: DataFrame) -> DataFrame:
    """(key, piece, first): the pieces of keys that lie in several, with their first position.
    Only the first and the last key of a piece can."""
    ends = events.groupBy("piece").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    named = ends.select("piece", F.explode(F.array("a", "b")).alias("key")).distinct()
    keys = named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # At most two keys per piece.
    return events.join(F.broadcast(cut_lineage(keys)), "key").groupBy("key", "piece").agg(F.min("at").alias("first"))


def _carried(events: DataFrame) -> DataFrame:
    """The intervals that are open where a later piece of their key begins, once per such piece."""
    pieces = cut_lineage(_crossing(events))
    along = Window.partitionBy("key").orderBy("piece")
    nexts = pieces.withColumn("next", F.lead("first").over(along)).where("next IS NOT NULL").select("key", "piece", "next")
    starts = events.where("what = 0")
    # Pieces are few: at most one key crosses each border.
    left = starts.join(F.broadcast(nexts), ["key", "piece"]).where("upto >= next").drop("next")
    within = Window.partitionBy("key", "piece", "kind").orderBy(F.desc("at"), F.asc("upto"), F.desc("name"), F.desc("holder"))
    later = F.max("upto").over(within.rowsBetween(Window.unboundedPreceding, -1))
    left = left.withColumn("later", later).where("later IS NULL OR upto > later").drop("later")
    into = pieces.select(F.col("key").alias("_key"), F.col("piece").alias("_piece"), "first")
    met = (F.col("key") == F.col("_key")) & (F.col("piece") < F.col("_piece")) & (F.col("upto") >= F.col("first"))
    return left.join(F.broadcast(into), met).withColumn("piece", F.col("_piece")).select(*_EVENT)


def innermost(
    points: DataFrame,
    intervals: DataFrame,
    kinds: Sequence[str] | None = None,
    key: str = "path",
    at: str = "line_no",
) -> DataFrame:
    """``points`` with ``found``: an array with a struct (name, container, line) per kind, null
    where no interval of the kind holds the point; without ``kinds``, all are one kind.

    ``intervals`` has ``key``, line, end_line, name, container and, with ``kinds``, kind. Of the
    intervals around a point that which starts last is the innermost; of equal starts that which
    ends first, then the greater name and container. Intervals may nest or overlap. Points and
    intervals without a key or a position meet nothing; repeated points stay repeated.
    """
    groups = list(kinds) if kinds is not None else [""]
    if kinds is None:
        intervals = intervals.withColumn("kind", F.lit(""))
    else:
        intervals = intervals.where(F.col("kind").isin(groups))
    placed = points.select(F.col(f"`{key}`").alias("key"), F.col(f"`{at}`").cast("long").alias("at")).dropna().distinct()
    none = F.lit(None)
    asked = placed.select("key", "at", F.lit(1).alias("what"), none.cast("long").alias("upto"), *[none.cast("string").alias(c) for c in ("kind", "name", "holder")])
    starts = intervals.select(
        F.col(f"`{key}`").alias("key"), F.col("line").cast("long").alias("at"), F.lit(0).alias("what"), F.col("end_line").cast("long").alias("upto"),
        "kind", F.col("name").cast("string").alias("name"), F.col("container").cast("string").alias("holder"),
    ).where(F.col("upto") >= F.col("at")).where(F.col("key").isNotNull())
    laid = starts.unionByName(asked).repartitionByRange("key", "at", "what").withColumn("piece", F.spark_partition_id())
    # Written: the range partitioning samples its input, so pieces of a recomputed part could differ.
    events = written(laid.select(*_EVENT), "events")
    every = events.unionByName(_carried(events)).repartition("piece")
    every = every.sortWithinPartitions("piece", "key", "at", "what", F.col("upto").desc(), "name", "holder")
    found = every.mapInArrow(_swept(groups), _FOUND)
    of_kind = [
        F.when(F.col("starts")[i].isNotNull(), F.struct(F.col("names")[i].alias("name"), F.col("holders")[i].alias("container"), F.col("starts")[i].alias("line")))
        for i in range(len(groups))
    ]
    found = found.select(F.col("key").alias("_key"), F.col("at").alias("_at"), F.array(*of_kind).alias("found"))
    return points.join(found, (F.col(f"`{key}`") == F.col("_key")) & (F.col(f"`{at}`") == F.col("_at")), "left").drop("_key", "_at")
