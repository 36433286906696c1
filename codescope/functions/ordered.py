"""Running values over ordered rows that stay parallel inside one hot key.

A plain window sends every row of a key to one task. Here the rows are range-partitioned
by key *and* order, which cuts a hot key into pieces; each piece is scanned on its own, the
pieces' totals (one row per key and piece) are accumulated, and added back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescope.session import cut_lineage

_PIECE = "_piece"
_HEAD = "_head_of_piece"

RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class OrderedRows:
    """Rows with their group keys and a total order inside each group."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def _stage(self, specs: Sequence[tuple[str, str, Column]]) -> OrderedRows:
        df = self.df
        values = {name: f"_v_{name}" for name, _, _ in specs}
        df = df.withColumns({values[name]: col for name, _, col in specs})
        return replace(self, df=self._over_pieces(df, specs, values).drop(*values.values()))

    def _over_pieces(self, df, specs, values):
        keys = [*self.keys, _PIECE]
        position = F.struct(*self.order)
        ordered = Window.partitionBy(*keys).orderBy(*self.order)
        running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

        def summary(name, kind):
            value = F.col(values[name])
            if kind == "lag":
                return F.max_by(F.struct(value.alias("v")), position)
            return RUNNING[kind.removeprefix("total_")](value)

        summaries = df.groupBy(*keys).agg(*(summary(n, k).alias(f"_s_{n}") for n, k, _ in specs))
        group = Window.partitionBy(*self.keys)
        along = group.orderBy(_PIECE)
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        carried = []
        for name, kind, _ in specs:
            part = F.col(f"_s_{name}")
            if kind == "lag":
                carry = F.lag(part).over(along)["v"]
            elif kind.startswith("total_"):
                carry = RUNNING[kind[6:]](part).over(group)
            else:
                carry = RUNNING[kind](part).over(before)
            carried.append(carry.alias(f"_c_{name}"))
        renamed = [F.col(k).alias(f"_k_{k}") for k in keys]
        carries = summaries.select(*renamed, *carried)

        local = {}
        for name, kind, _ in specs:
            value = F.col(values[name])
            if kind == "lag":
                local[f"_l_{name}"] = F.lag(value).over(ordered)
            elif not kind.startswith("total_"):
                local[f"_l_{name}"] = RUNNING[kind](value).over(running)
        first = F.row_number().over(ordered) == 1
        df = df.withColumns({**local, _HEAD: first})
        match = F.lit(True)
        for key in keys:
            match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
        joined = df.join(carries, match)

        out = {}
        for name, kind, _ in specs:
            carry, here = F.col(f"_c_{name}"), F.col(f"_l_{name}")
            if kind == "lag":
                out[name] = F.when(F.col(_HEAD), carry).otherwise(here)
            elif kind.startswith("total_"):
                out[name] = carry
            elif kind == "sum":
                both = carry.isNotNull() & here.isNotNull()
                out[name] = F.when(both, carry + here).otherwise(F.coalesce(carry, here))
            else:
                pick = F.greatest if kind == "max" else F.least
                out[name] = pick(carry, here)
        joined = joined.withColumns(out)
        return joined.drop(*carries.columns, *local, _HEAD)

    def running(self, **specs: tuple[str, Column]) -> OrderedRows:
        """Add columns ``name=(kind, value)``; kinds are sum, max, min (up to the
        current row), lag (previous row) and total_sum, total_max, total_min (whole group)."""
        return self._stage([(name, kind, col) for name, (kind, col) in specs.items()])

    def result(self) -> DataFrame:
        return self.df.drop(_PIECE)


def ordered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> OrderedRows:
    """The rows of ``df``, ready for running values by ``keys`` in ``order``.

    They are written after the range partitioning: it samples its input, so the pieces of a
    recomputed part could differ.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return OrderedRows(cut_lineage(ranged.withColumn(_PIECE, F.spark_partition_id())), tuple(keys), tuple(order))
