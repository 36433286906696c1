"""Structured Streaming jobs (O5, O7, O10, O11), and O6 on a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codescope.operators.outcomes import (
    BREAKER_STATE,
    HALT_ATTEMPTS,
    HALT_RATE,
    HALT_SCORE,
    HALT_STREAK,
    with_severity,
)
from codescope.operators.rulepack import RULES, Rule
from codescope.operators.text_rules import rule_scan
from codescope.session import scratch_path
from codescope.sources.files import BUILD_FOLDERS, explode_lines

_BUILD = r"(?i)[/\\](?:" + "|".join(BUILD_FOLDERS) + r")[/\\]"


def append_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all input that is there now, and read back what it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    append_to_parquet(stream, path, scratch_path(spark, f"{label}-progress")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def debounce_changes(
    changes: DataFrame,
    gap: str = "500 milliseconds",
    watermark: str = "10 seconds",
    key: Sequence[str] = ("project",),
    written: DataFrame | None = None,
) -> DataFrame:
    """Batches of changes (key, path, ts) separated by less than ``gap``.

    Build output is ignored, and so are changes up to five seconds after our own write of
    the path (``written``: path, written_at). Rows later than the watermark are dropped.
    The paths of a batch are the changes inside its bounds: ``changed_paths``.
    """
    rows = changes.where(~F.col("path").rlike(_BUILD))
    if written is not None:
        own = written.select(F.col("path").alias("_path"), "written_at")
        recent = (
            (F.col("path") == F.col("_path"))
            & (F.col("ts") >= F.col("written_at"))
            & (F.col("ts") < F.col("written_at") + F.expr("INTERVAL 5 SECONDS"))
        )
        rows = rows.join(own, recent, "left_anti")
    return (
        rows.withWatermark("ts", watermark)
        .groupBy(*key, F.session_window("ts", gap).alias("_w"))
        .agg(F.count("*").alias("n_changes"))
        .select(*key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n_changes")
    )


def changed_paths(changes: DataFrame, batches: DataFrame, key: Sequence[str] = ("project",)) -> DataFrame:
    """The distinct paths of each debounced batch, a row each."""
    inside = batches.select(*(F.col(k).alias(f"_{k}") for k in key), "start", "end")
    match = (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))
    for k in key:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return changes.join(inside, match).select(*key, "start", "path").distinct()


def ledger_stream(
    operations: DataFrame,
    key: Sequence[str] = ("member",),
    window: str = "1 day",
    watermark: str = "1 hour",
    event_id: str = "event_id",
) -> DataFrame:
    """Touches per key and time window, each event counted once; a window is final when the
    watermark passes its end."""
    return (
        operations.withWatermark("ts", watermark)
        .dropDuplicatesWithinWatermark([event_id])
        .groupBy(F.window("ts", window).alias("_w"), *key)
        .agg(F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .select(F.col("_w.start").alias("window_start"), *key, "hits", "first_seen", "last_seen")
    )


def rescan_changed(files: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Findings of file versions as they arrive: a stateless stream of the rule scan."""
    return rule_scan(explode_lines(files), rules)


STATE = T.StructType(
    [T.StructField(name, T.BooleanType() if name == "open" else T.LongType()) for name in BREAKER_STATE]
)


def _advance(order: list[str]) -> Callable:
    """The state of one session, moved on by its batches of a micro-batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, failures, score, streak, is_open = state.get if state.exists else (0, 0, 0, 0, False)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        counts = rows[["succeeded", "failed", "rolled_back", "skipped"]].fillna(0).astype(int)
        resets = rows["reset"].fillna(False).astype(bool) if "reset" in rows else [False] * len(rows)
        out = []
        for (good, failed, rolled, skipped), reset in zip(counts.itertuples(index=False), resets):
            if reset:
                attempts, failures, score, streak, is_open = 0, 0, 0, 0, False
            attempts, failures, score = attempts + good + failed + rolled + skipped, failures + failed + rolled, score + 2 * rolled + failed
            streak = 0 if good else streak + (failed + rolled > 0)
            rate = failures / attempts if attempts else 0.0
            trips = streak >= HALT_STREAK or (attempts >= HALT_ATTEMPTS and rate > HALT_RATE) or score > HALT_SCORE
            is_open = bool(is_open or trips)
            out.append((attempts, failures, score, streak, is_open))
        state.update(tuple(int(v) if n != "open" else v for n, v in zip(BREAKER_STATE, out[-1])))
        yield rows.reset_index(drop=True).join(pd.DataFrame(out, columns=BREAKER_STATE))

    return step


def breaker_stream(batches: DataFrame, out: str, checkpoint: str, order: Sequence[str] = ("batch_no",)) -> StreamingQuery:
    """The breaker on a stream of batches keyed by ``session``, with one row of state per session
    in Spark's state store: a micro-batch reads and writes the sessions it holds and no others.

    Batches of a session are taken in ``order`` within a micro-batch, so they must arrive in
    that order across micro-batches; a trigger that admits less at a time bounds the memory of
    a busy session. A repeated micro-batch starts from the state it started from before.
    """
    kept = list(batches.schema.fields)
    schema = T.StructType([*kept, *STATE.fields])
    moved = batches.groupBy("session").applyInPandasWithState(
        _advance(list(order)), schema, STATE, "append", GroupStateTimeout.NoTimeout
    )
    return append_to_parquet(with_severity(moved), out, checkpoint)


