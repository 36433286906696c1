"""Outcomes of batch operations: summaries, ledger, breaker, limits, routing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescope.functions.ordered import ordered_rows
from codescope.functions.text import contains_ci

# Item outcomes.
OUTCOMES = ["Succeeded", "AlreadySatisfied", "Skipped", "Failed", "Blocked", "RolledBack", "NeedsManualReview"]
# Filter prefixes and the outcome each selects.
OUTCOME_SYNONYMS = {
    "fail": "Failed", "err": "Failed",
    "skip": "Skipped", "warn": "Skipped",
    "ok": "Succeeded", "pass": "Succeeded", "info": "Succeeded", "success": "Succeeded", "succeed": "Succeeded",
    "roll": "RolledBack", "revert": "RolledBack", "undo": "RolledBack",
    "manual": "NeedsManualReview", "needs_manual": "NeedsManualReview",
}
# Breaker thresholds.
HALT_STREAK, HALT_ATTEMPTS, HALT_RATE, HALT_SCORE = 8, 20, 0.30, 20
CAUTION_STREAK, CAUTION_ATTEMPTS, CAUTION_RATE, CAUTION_SCORE = 4, 10, 0.15, 10
# Calls per minute by tool.
TOOL_LIMITS = {
    "list_project_documentation": 20, "read_project_documentation": 30, "update_project_documentation": 10,
    "read_plan": 30, "update_plan": 10, "read_handoff": 30, "write_handoff": 10, "read_completed_work": 30,
    "append_completed_work": 15, "read_current_state": 30, "update_current_state": 5, "run_bridge_batch": 5,
    "run_uplift_batch": 5, "propagate_cancellation_token_batch": 5,
}
# Named conditions and the text in a reason that shows them.
REASON_CONDITIONS = {
    "below_threshold": "below minScore",
    "already_flagged": "already flagged",
    "compiler_error": "validation",
    "event_handler": "event handler",
}


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Counts per change and the derived outcome of the whole change."""
    names = {
        "succeeded": "Succeeded",
        "already_satisfied": "AlreadySatisfied",
        "skipped": "Skipped",
        "failed": "Failed",
        "blocked": "Blocked",
    }
    counts = [F.count_if(F.col("outcome") == v).alias(k) for k, v in names.items()]
    failures = (F.col("failed") + F.col("blocked")) > 0
    derived = (
        F.when(F.col("attempted") == 0, "NothingToDo")
        .when(~failures & (F.col("already_satisfied") == 0) & (F.col("succeeded") > 0), "CompletedFully")
        .when(~failures & (F.col("already_satisfied") > 0), "CompletedWithNoOps")
        .when(failures & (F.col("succeeded") > 0), "PartialProgress")
        .when(failures, "NoProgress")
        .otherwise("NothingToDo")
    )
    return outcomes.groupBy("change_id").agg(*counts, F.count("*").alias("attempted")).withColumn("outcome", derived)


def failure_sample(outcomes: DataFrame, order: Sequence[str], size: int = 10) -> DataFrame:
    """The first failures of each change. The rank filter is applied before the shuffle
    too, so a change with many failures sends at most ``size`` rows per task."""
    failed = outcomes.where(F.col("outcome").isin("Failed", "Blocked"))
    rank = F.row_number().over(Window.partitionBy("change_id").orderBy(*order))
    return failed.withColumn("sample_no", rank).where(F.col("sample_no") <= size)


def reason_counts(outcomes: DataFrame) -> DataFrame:
    failed = outcomes.where(F.col("outcome").isin("Failed", "Blocked"))
    return failed.groupBy("change_id", "reason").agg(F.count("*").alias("n_failures"))


def ledger(
    outcomes: DataFrame,
    key: Sequence[str] = ("path", "member"),
    phase: str | None = None,
    repeated_only: bool = False,
) -> DataFrame:
    """First and last touch and number of touches per key, the most touched first."""
    aggregates = [F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("hits")]
    if phase is not None:
        aggregates.append(F.bool_or(F.col("phase") == phase).alias("_in_phase"))
    entries = outcomes.groupBy(*key).agg(*aggregates)
    if phase is not None:
        entries = entries.where("_in_phase").drop("_in_phase")
    if repeated_only:
        entries = entries.where("hits > 1")
    return entries


def ledger_totals(outcomes: DataFrame, key: Sequence[str] = ("path", "member")) -> DataFrame:
    entries = outcomes.groupBy(*key).agg(F.count("*").alias("hits"))
    return entries.agg(
        F.count("*").alias("total_entries"),
        F.sum("hits").alias("total_operations"),
        F.count_if(F.col("hits") > 1).alias("repeated_keys"),
    )


def ledger_operations(
    outcomes: DataFrame,
    key: Sequence[str] = ("path", "member"),
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """The operations of every key, numbered in order."""
    numbered = ordered_rows(outcomes, key, order).running(
        operation_no=("sum", F.lit(1).cast("long"))
    )
    return numbered.result()


def outcome_of_filter(text: str) -> str:
    for prefix, outcome in OUTCOME_SYNONYMS.items():
        if text.lower().startswith(prefix):
            return outcome
    raise ValueError(f"unknown filter: {text}")


def operation_detail(
    outcomes: DataFrame,
    change_id: str,
    filter: str | None = None,
    max_items: int = 50,
    order: Sequence[str] = ("path", "member", "ts"),
) -> DataFrame:
    """The first items of a change, by ``file:`` substring or outcome word, with the exact
    total and ``has_more``."""
    rows = outcomes.where(F.col("change_id") == change_id)
    if filter and filter.lower().startswith("file:"):
        rows = rows.where(contains_ci(F.col("path"), filter[5:]))
    elif filter:
        rows = rows.where(F.col("outcome") == outcome_of_filter(filter))
    total = rows.agg(F.count("*").alias("n")).scalar()
    return rows.orderBy(*order).limit(max_items).withColumn("total_items", total).withColumn(
        "has_more", F.col("total_items") > max_items
    )


# --- breaker ------------------------------------------------------------------------

BREAKER_STATE = ["attempts", "failures", "score", "streak", "open"]


def breaker_status(
    batches: DataFrame,
    session: str = "session",
    order: Sequence[str] = ("batch_no",),
    carry: DataFrame | None = None,
) -> DataFrame:
    """The breaker's state after every batch of a session.

    ``batches`` holds succeeded, failed, rolled_back, skipped and, optionally, ``reset``: a
    manual reset, which clears all state. ``carry`` is the state the sessions start from.

    The streak is the number of failing batches so far, less that number at the last
    success; both are running values, so is the flag that stays up once it tripped.
    """
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("succeeded", "failed", "rolled_back", "skipped")}
    bad = n["failed"] + n["rolled_back"]
    has_reset = "reset" in batches.columns
    steps = batches.withColumns(
        {
            "_seq": F.lit(1),
            "_attempts": n["succeeded"] + bad + n["skipped"],
            "_failures": bad,
            "_score": n["rolled_back"] * 2 + n["failed"],
            "_failing": ((n["succeeded"] == 0) & (bad > 0)).cast("long"),
            "_success": n["succeeded"] > 0,
            "_tripped": F.lit(0),
            "_reset": F.col("reset").cast("long") if has_reset else F.lit(0).cast("long"),
        }
    )
    if carry is not None:
        start = carry.select(
            session,
            F.lit(0).alias("_seq"),
            F.col("attempts").alias("_attempts"),
            F.col("failures").alias("_failures"),
            F.col("score").alias("_score"),
            F.col("streak").alias("_failing"),
            F.lit(False).alias("_success"),
            F.col("open").cast("int").alias("_tripped"),
            F.lit(0).cast("long").alias("_reset"),
        )
        steps = steps.unionByName(start, allowMissingColumns=True)

    order = ["_seq", *order]
    keys = [session]
    rows = ordered_rows(steps, keys, order)
    if has_reset:
        epochs = rows.running(_epoch=("sum", F.col("_reset"))).result()
        keys = [session, "_epoch"]
        rows = ordered_rows(epochs, keys, order)
    rows = rows.running(
        attempts=("sum", F.col("_attempts")),
        failures=("sum", F.col("_failures")),
        score=("sum", F.col("_score")),
        _failing_so_far=("sum", F.col("_failing")),
    )
    rows = rows.running(
        _at_success=("max", F.when(F.col("_success"), F.col("_failing_so_far")).otherwise(0))
    )
    streak = F.col("_failing_so_far") - F.col("_at_success")
    rate = F.when(F.col("attempts") > 0, F.col("failures") / F.col("attempts")).otherwise(0.0)
    trips = (
        (streak >= HALT_STREAK)
        | ((F.col("attempts") >= HALT_ATTEMPTS) & (rate > HALT_RATE))
        | (F.col("score") > HALT_SCORE)
    )
    rows = rows.running(_open=("max", F.greatest(F.col("_tripped"), trips.cast("int"))))
    kept = [c for c in batches.columns]
    state = rows.result().where("_seq = 1").select(
        *kept, "attempts", "failures", "score", streak.alias("streak"), (F.col("_open") == 1).alias("open")
    )
    return with_severity(state)


def with_severity(state: DataFrame) -> DataFrame:
    """Add the failure rate in percent and the severity of a state."""
    rate = F.when(F.col("attempts") > 0, F.col("failures") / F.col("attempts")).otherwise(0.0)
    caution = (
        (F.col("streak") >= CAUTION_STREAK)
        | ((F.col("attempts") >= CAUTION_ATTEMPTS) & (rate >= CAUTION_RATE))
        | (F.col("score") >= CAUTION_SCORE)
    )
    severity = F.when(F.col("open"), "halt").when(caution, "caution").otherwise("ok")
    rest = [c for c in state.columns if c != "open"]
    return state.select(*rest, F.round(rate * 100, 1).alias("failure_rate_pct"), "open", severity.alias("severity"))


def breaker_state(status: DataFrame, session: str = "session", order: Sequence[str] = ("batch_no",)) -> DataFrame:
    """The last state of every session."""
    last = F.max_by(F.struct(*BREAKER_STATE), F.struct(*order))
    return status.groupBy(session).agg(last.alias("_s")).select(session, "_s.*")


# --- rate limits --------------------------------------------------------------------


def _in_blocks(rows: DataFrame, at: str, before: int, after: int) -> tuple[DataFrame, list[str]]:
    """Copy every row to the time blocks in which some frame can see it. A frame then needs
    one block only, so a tool with many calls is spread over as many tasks as blocks."""
    width = 10 * max(before, after)
    first = F.floor((F.col(at) - after) / width)
    last = F.floor((F.col(at) + before) / width)
    own = F.floor(F.col(at) / width)
    copied = rows.select("*", own.alias("_own"), F.explode(F.sequence(first, last)).alias("_block"))
    return copied, ["tool", "_block"]


def _only_own(rows: DataFrame) -> DataFrame:
    return rows.where("_own = _block").drop("_own", "_block")


def _with_limits(calls: DataFrame, limits: Mapping[str, int], default: int) -> DataFrame:
    limit = F.lit(default)
    for tool, n in limits.items():
        limit = F.when(F.lower("tool") == tool.lower(), n).otherwise(limit)
    return calls.withColumns({"limit": limit, "_at": F.unix_micros(F.col("ts").cast("timestamp"))})


def call_counts(
    calls: DataFrame, limits: Mapping[str, int] = TOOL_LIMITS, default_limit: int = 30, window_s: int = 60
) -> DataFrame:
    """Per call, the calls of its tool in the trailing window before it, whether or not those
    were accepted. A call exactly ``window_s`` old still counts."""
    span = window_s * 1_000_000
    rows, block = _in_blocks(_with_limits(calls, limits, default_limit), "_at", span, 0)
    # A call counts from its time on, until it is older than the window. The running sum holds
    # the calls of the window; a sliding frame would add them up anew for every call.
    changes = F.array(F.struct(F.col("_at").alias("t"), F.lit(1).alias("by")), F.struct((F.col("_at") + span + 1).alias("t"), F.lit(-1).alias("by")))
    steps = rows.withColumn("_step", F.explode(changes)).withColumns({"_t": F.col("_step.t"), "_by": F.col("_step.by")}).drop("_step")
    so_far = Window.partitionBy(*block).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = _only_own(steps.withColumn("calls_before", F.sum("_by").over(so_far) - 1).where("_by = 1")).drop("_t", "_by")
    return counted.withColumn("over_limit", F.col("calls_before") >= F.col("limit"))


def rate_limit(
    calls: DataFrame,
    limits: Mapping[str, int] = TOOL_LIMITS,
    default_limit: int = 30,
    window_s: int = 60,
    tie: str = "event_id",
) -> DataFrame:
    """Accept or reject each call: it is rejected if the accepted calls of its tool in the
    trailing window have reached the limit. Rejected calls do not count later.

    A call with fewer calls of any kind before it is accepted whatever happened to those.
    Only calls within a window of a doubtful one need the decisions before them; they form
    separate stretches, which are decided side by side, each in time order with a state of
    at most ``limit`` times. Stretches stream through their task and are not held in memory.
    """
    span = window_s * 1_000_000
    counted = call_counts(calls, limits, default_limit, window_s).withColumnRenamed("over_limit", "_doubt")
    near, block = _in_blocks(counted, "_at", span, span)
    doubtful_at = F.when(F.col("_doubt"), F.col("_at"))
    reach = lambda order: Window.partitionBy(*block).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = F.max(doubtful_at).over(reach(F.col("_at").asc())) >= F.col("_at") - span
    ahead = F.min(doubtful_at).over(reach(F.col("_at").desc())) <= F.col("_at") + span
    marked = _only_own(near.withColumn("_stretch_row", F.coalesce(behind, F.lit(False)) | F.coalesce(ahead, F.lit(False))))
    clear = F.when(F.col("_stretch_row"), 0).otherwise(1).cast("long")
    stretches = ordered_rows(marked, ["tool"], ["_at", tie]).running(_stretch=("sum", clear)).result()
    certain = stretches.where("NOT _stretch_row").withColumn("accepted", F.lit(True))
    doubtful = stretches.where("_stretch_row")
    key = ["tool", "_stretch"]
    schema = T.StructType([*doubtful.schema.fields, T.StructField("accepted", T.BooleanType())])
    decided = (
        doubtful.repartition(*key)
        .sortWithinPartitions(*key, "_at", tie)
        .mapInPandas(_decide(span), schema)
    )
    return certain.unionByName(decided).drop("_at", "_doubt", "_stretch_row", "_stretch")


def _decide(span: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted_at = None, []
        for part in parts:
            flags = []
            for tool, stretch, at, limit in zip(part["tool"], part["_stretch"], part["_at"], part["limit"]):
                if (tool, stretch) != current:
                    current, accepted_at = (tool, stretch), []
                while accepted_at and accepted_at[0] < at - span:
                    accepted_at.pop(0)
                flags.append(len(accepted_at) < limit)
                if flags[-1]:
                    accepted_at.append(at)
            yield part.assign(accepted=flags)

    return run


# --- routing and phases -------------------------------------------------------------


def route_failures(failures: DataFrame, reason_tags: DataFrame, producers: DataFrame) -> DataFrame:
    """The tool that can supply what a failure lacks: by reason to tag, and by tag to the
    producer of highest weight (ties by name). Null where no tag or producer is known."""
    best = producers.groupBy("tag").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), F.col("tool").alias("tool"))).alias("_p")
    )
    routes = reason_tags.join(best, "tag", "left").select("reason", "tag", F.col("_p.tool").alias("suggested_tool"))
    return failures.join(routes, "reason", "left")


def phase_of(reason: Column) -> Column:
    return F.nullif(F.regexp_extract(reason, r"(?i)^phase:(\w+)", 1), F.lit(""))


def phase_breakdown(outcomes: DataFrame, values: Sequence[str] = tuple(OUTCOMES)) -> DataFrame:
    """Counts per phase, a column for each outcome and named condition."""
    reason = F.col("reason")
    by_outcome = [F.count_if(F.col("outcome") == v).alias(v) for v in values]
    by_condition = [F.count_if(contains_ci(reason, text)).alias(name) for name, text in REASON_CONDITIONS.items()]
    return (
        outcomes.withColumn("phase", phase_of(reason))
        .where(F.col("phase").isNotNull())
        .groupBy("phase")
        .agg(*by_outcome, *by_condition)
    )
