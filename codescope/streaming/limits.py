"""Call limits per tool on a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codescope.operators.outcomes import TOOL_LIMITS
from codescope.streaming.stateful import in_order


class CallLimiter(StatefulProcessor):
    """Decides the calls of one tool; the state is the times of its accepted calls that are
    still in the window, at most ``limit``."""

    def __init__(self, limits: Mapping[str, int], default_limit: int, span: int, tie: str) -> None:
        self.limits = {tool.lower(): n for tool, n in limits.items()}
        self.default_limit, self.span, self.tie = default_limit, span, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "at LONG")
        self.newest = handle.getValueState("newest", "at LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [p.reset_index(drop=True) for p in rows]
        limit = self.limits.get((key[0] or "").lower(), self.default_limit)
        window = deque(at for (at,) in self.accepted.get())
        now = self.newest.get()[0] if self.newest.exists() else None
        flags = [[False] * len(p) for p in parts]
        for part, row in in_order(parts, ("at_micros", self.tie)):
            at = int(parts[part]["at_micros"].iat[row])
            # A tool's clock never runs back: a call older than one decided before counts as now.
            now = at if now is None else max(now, at)
            while window and window[0] < now - self.span:
                window.popleft()
            if len(window) < limit:
                window.append(now)
                flags[part][row] = True
        self.newest.update((now,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if window:
            self.accepted.put([(at,) for at in window])
        else:
            self.accepted.clear()
        self.handle.registerTimer((now + self.span) // 1000 + 1)
        for part, flag in zip(parts, flags):
            yield part.drop(columns="at_micros").assign(limit=limit, accepted=flag)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # The watermark passed the window of the newest call: an idle tool keeps no state.
        self.accepted.clear()
        self.newest.clear()
        return iter(())


def rate_limit_stream(
    calls: DataFrame,
    limits: Mapping[str, int] = TOOL_LIMITS,
    default_limit: int = 30,
    window_s: int = 60,
    tie: str = "event_id",
    watermark: str = "1 hour",
) -> DataFrame:
    """``calls`` (tool, ts, and ``tie``) with ``limit`` and ``accepted``, decided as they come.

    A call is rejected if the accepted calls of its tool in the trailing window have reached the
    limit; rejected calls do not count later, and a call exactly ``window_s`` old still counts.
    Within a micro-batch calls are taken by time and ``tie``. A call that comes after a later one
    of its tool was decided is decided as of that one's time, as by a limiter with one clock.
    Calls later than the watermark are dropped by Spark; those without a time are rejected
    before. Start it inside ``stateful.rocksdb``.
    """
    rows = calls.where("ts IS NOT NULL").withColumn("at_micros", F.unix_micros("ts")).withWatermark("ts", watermark)
    schema = T.StructType([*calls.schema.fields, T.StructField("limit", T.IntegerType()), T.StructField("accepted", T.BooleanType())])
    limiter = CallLimiter(limits, default_limit, window_s * 1_000_000, tie)
    return rows.groupBy("tool").transformWithStateInPandas(limiter, schema, "append", "eventTime")
