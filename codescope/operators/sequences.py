"""Patterns over the ordered accesses of a value (T8): small automata, run piece by piece.

Accesses are range-partitioned by key and order, so a hot key is cut into pieces. A first pass
composes, for the first and the last key of each piece (no other key can go on elsewhere), the
transition functions of its accesses into one function from state to state. These few functions
are applied in order to give every piece its starting states, and a second pass reports.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescope.session import cut_lineage

ACCESS_ORDER = ("path", "line", "col", "caller_id", "ref_kind")


@dataclass(frozen=True)
class SequencePattern:
    """An automaton over access kinds that starts in state 0.

    ``moves[state, kind]`` is the next state; a pair that is not listed keeps the state.
    An access is reported if its (state, kind) is in ``reports``, and the last access of a key
    if the key ends in a state of ``open_ends``."""

    id: str
    moves: Mapping[tuple[int, str], int]
    reports: frozenset[tuple[int, str]] = frozenset()
    open_ends: frozenset[int] = frozenset()

    @property
    def n_states(self) -> int:
        return 1 + max([0, *self.moves.values(), *(s for s, _ in self.moves)])


def _each(state: int, kinds: Sequence[str], to: int) -> dict[tuple[int, str], int]:
    return {(state, kind): to for kind in kinds}


def multiple_enumeration(read: Sequence[str] = ("read",), assign: Sequence[str] = ("create", "write")) -> SequencePattern:
    """A sequence that is read again although nothing was assigned since it was read."""
    moves = _each(0, read, 1) | _each(1, assign, 0)
    return SequencePattern("multiple_enumeration", moves, frozenset((1, k) for k in read))


def value_task_misuse(consume: Sequence[str] = ("read",), obtain: Sequence[str] = ("create", "write")) -> SequencePattern:
    """A value for one use that is consumed a second time, or more often, since it was obtained."""
    moves = _each(0, obtain, 1) | _each(1, consume, 2) | _each(2, obtain, 1)
    return SequencePattern("value_task_misuse", moves, frozenset((2, k) for k in consume))


def semaphore_usage(wait: Sequence[str] = ("wait",), release: Sequence[str] = ("release",)) -> SequencePattern:
    """A wait while one is held, a release of what is not held, and a wait without a release."""
    moves = _each(0, wait, 1) | _each(1, release, 0)
    reports = {(1, k) for k in wait} | {(0, k) for k in release}
    return SequencePattern("semaphore_usage", moves, frozenset(reports), frozenset({1}))


def unobserved_task_in_field(store: Sequence[str] = ("create", "write"), observe: Sequence[str] = ("read",)) -> SequencePattern:
    """A stored task that is replaced, or left at the end, before anything observed it."""
    moves = _each(0, store, 1) | _each(1, observe, 0)
    return SequencePattern("unobserved_task_in_field", moves, frozenset((1, k) for k in store), frozenset({1}))


PATTERNS = (multiple_enumeration(), value_task_misuse(), semaphore_usage(), unobserved_task_in_field())


class _Functions:
    """The functions that arise by composing moves, as small numbers. The states of all patterns
    share one numbering; there are few functions, so each is composed once."""

    def __init__(self, patterns: Sequence[SequencePattern]) -> None:
        self.patterns = patterns
        self.offsets = [sum(p.n_states for p in patterns[:i]) for i in range(len(patterns))]
        same = tuple(range(sum(p.n_states for p in patterns)))
        self.values, self.numbers, self.known = [same], {same: 0}, {}

    def then(self, number: int, kind: str) -> int:
        step = (number, kind)
        if step not in self.known:
            value = list(self.values[number])
            for pattern, offset in zip(self.patterns, self.offsets):
                for start in range(offset, offset + pattern.n_states):
                    state = value[start] - offset
                    value[start] = offset + pattern.moves.get((state, kind), state)
            value = tuple(value)
            if value not in self.numbers:
                self.numbers[value] = len(self.values)
                self.values.append(value)
            self.known[step] = self.numbers[value]
        return self.known[step]


def _border_functions(patterns: Sequence[SequencePattern], keys: Sequence[str]):
    """Of each piece its first and its last key, with the function of the key's accesses there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _Functions(patterns)
        first, last, place, number = None, None, None, 0
        for batch in batches:
            values = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            kinds = batch.column("_kind").to_pylist()
            for i, (value, kind) in enumerate(zip(values, kinds)):
                if value != last:
                    if last is not None and first is None:
                        first = (place, functions.values[number])
                    last, number = value, 0
                    place = batch.select([*keys, "_piece"]).slice(i, 1)
                number = functions.then(number, kind)
        ends = [first] if first else []
        if last is not None:
            ends.append((place, functions.values[number]))
        for row, function in ends:
            ends_at = pa.array([list(function)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*row.columns, ends_at], names=[*keys, "_piece", "_to"])

    return run


def _reports(patterns: Sequence[SequencePattern], keys: Sequence[str], shown: Sequence[str]):
    """The reported accesses of each piece, with the pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _Functions(patterns)
        offsets, begin = functions.offsets, [0] * len(patterns)
        at, hits, ends = {}, {}, {}

        def told(state: tuple, kind: str) -> tuple:
            """The next states and the patterns that report this access."""
            found = at.get((state, kind))
            if found is None:
                nexts = tuple(p.moves.get((s, kind), s) for p, s in zip(patterns, state))
                hits[state, kind] = [p.id for p, s in zip(patterns, state) if (s, kind) in p.reports]
                found = at[state, kind] = nexts
            return found

        def open_at(state: tuple) -> list[str]:
            if state not in ends:
                ends[state] = [p.id for p, s in zip(patterns, state) if s in p.open_ends]
            return ends[state]

        last, state, more, tail = None, tuple(begin), False, None
        for batch in batches:
            values = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            kinds = batch.column("_kind").to_pylist()
            starts, follow = batch.column("_from").to_pylist(), batch.column("_more").to_pylist()
            rows, ids = [], []
            for i, (value, kind) in enumerate(zip(values, kinds)):
                if value != last:
                    if last is not None and not more and open_at(state):
                        if i:
                            rows += [i - 1] * len(open_at(state))
                            ids += open_at(state)
                        else:
                            yield _found(tail, [0] * len(open_at(state)), open_at(state), shown)
                    last, more = value, bool(follow[i])
                    state = tuple(s - o for s, o in zip(starts[i], offsets)) if starts[i] else tuple(begin)
                nexts = told(state, kind)
                for name in hits[state, kind]:
                    rows.append(i)
                    ids.append(name)
                state = nexts
            if rows:
                yield _found(batch, rows, ids, shown)
            if batch.num_rows:
                tail = batch.slice(batch.num_rows - 1, 1)
        if last is not None and not more and open_at(state):
            yield _found(tail, [0] * len(open_at(state)), open_at(state), shown)

    return run


def _found(batch: pa.RecordBatch, rows: list[int], ids: list[str], shown: Sequence[str]) -> pa.RecordBatch:
    picked = batch.select(list(shown)).take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *picked.columns], names=["detector", *shown])


def sequence_findings(
    accesses: DataFrame,
    patterns: Sequence[SequencePattern] = PATTERNS,
    keys: Sequence[str] = ("symbol_id",),
    order: Sequence[str] = ACCESS_ORDER,
    kind: str = "ref_kind",
) -> DataFrame:
    """(detector, keys, order): the accesses that ``patterns`` report.

    Accesses without a key belong to no value and are left out; a null kind moves nothing.
    Repeated accesses count as often as they occur. An access that a pattern reports itself and
    again as the last one of an open key has two rows.
    """
    shown = list(dict.fromkeys([*keys, *order]))
    rows = accesses.select(*[F.col(f"`{c}`") for c in shown], F.col(f"`{kind}`").alias("_kind")).dropna(subset=list(keys))
    place = [*shown, "_kind"]
    ranged = rows.repartitionByRange(*[F.col(f"`{c}`") for c in place]).sortWithinPartitions(*[F.col(f"`{c}`") for c in place])
    # The checkpoint keeps pieces and their order, so both passes read it without a shuffle.
    pieces = cut_lineage(ranged.withColumn("_piece", F.spark_partition_id()))
    fields = {f.name: f for f in pieces.schema.fields}
    ends = T.StructType([*[fields[k] for k in keys], T.StructField("_piece", T.IntegerType()), T.StructField("_to", T.ArrayType(T.IntegerType()))])
    functions = pieces.mapInArrow(_border_functions(patterns, keys), ends)
    # At most one row per key and piece, of at most two keys a piece.
    along = F.array_sort(F.collect_list(F.struct("_piece", "_to")))
    chains = functions.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(along.alias("_chain")).where(F.size("_chain") > 1)
    begin = F.array(*[F.lit(o) for o in _Functions(patterns).offsets])
    none = F.array().cast("array<struct<_piece:int,_from:array<int>>>")

    def onward(seen, step):
        given = F.concat(seen["given"], F.array(F.struct(step["_piece"].alias("_piece"), seen["state"].alias("_from"))))
        return F.struct(F.transform(seen["state"], lambda s: F.get(step["_to"], s)).alias("state"), given.alias("given"))

    given = F.aggregate("_chain", F.struct(begin.alias("state"), none.alias("given")), onward)["given"]
    last = F.element_at("_chain", -1)["_piece"]
    starts = chains.select(*[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)], F.explode(given).alias("g"), last.alias("_last"))
    starts = starts.select(*[f"_key_{i}" for i in range(len(keys))], F.col("g._piece").alias("_at"), F.col("g._from").alias("_from"), (F.col("g._piece") < F.col("_last")).alias("_more"))
    met = F.col("_piece") == F.col("_at")
    for i, k in enumerate(keys):
        met = met & (F.col(f"`{k}`") == F.col(f"_key_{i}"))
    # Bounded by two rows a piece; a broadcast join keeps the order of the pieces.
    placed = pieces.join(F.broadcast(cut_lineage(starts)), met, "left").select(*[F.col(f"`{c}`") for c in place], "_from", "_more")
    out = T.StructType([T.StructField("detector", T.StringType()), *[fields[c] for c in shown]])
    return placed.mapInArrow(_reports(patterns, keys, shown), out)
