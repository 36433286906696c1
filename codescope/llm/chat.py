"""Transcript parsing with a hidden Markov model (operator 4).

A transcript is lines of text; who speaks is marked in many ways, or not at all. The hidden
states are a role's first line of a turn and its further lines; observed are the speaker marker
and features of the line. Transitions and emissions are counted on labelled turns, Viterbi
recovers the states, and turns are rendered in one canonical form.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
# The state of a role's first line is twice its number, that of its further lines one more.
STATES = 2 * len(ROLES)
# Names that transcripts use for the speakers.
ALIASES = {
    "system": "system", "sys": "system", "instruction": "system", "instructions": "system",
    "user": "user", "human": "user", "customer": "user", "client": "user", "question": "user", "q": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "model": "assistant", "answer": "assistant",
    "a": "assistant", "chatgpt": "assistant", "gpt": "assistant",
}
MARKER = re.compile(
    r"^\s*(?P<open>#{1,6}\s+|\*\*|\[|<\|im_start\|>|<\|?|\()?(?P<who>[A-Za-z]{1,12})"
    r"(?P<close>\s*(?::\*\*|\*\*:?|\]:?|\|?>:?|\):?|:))?\s*(?P<rest>.*)$",
    re.S,
)
LISTED = re.compile(r"\s*(?:[-*+]\s|\d+[.)]\s|```|>)")
SIZES = np.array([0, 20, 80, 200, 600])
# Observed features with the number of values each can have.
FEATURES = {"marker": 4, "size": 6, "ending": 3, "after_blank": 2, "listed": 2}
LEAST_BLOCK = 1024


def marker(line: str) -> tuple[str | None, str]:
    """(role, rest of the line) if the line starts with a speaker's name set off as one."""
    found = MARKER.match(line)
    role = ALIASES.get(found["who"].lower()) if found else None
    if role is None:
        return None, line
    opened, closed = (found["open"] or "").strip(), found["close"]
    alone = not found["rest"] and (opened.startswith("#") or opened == "<|im_start|>")
    return (role, found["rest"]) if closed or alone else (None, line)


def observe(line: str, after_blank: bool) -> tuple[int, ...]:
    role, rest = marker(line)
    text = rest.rstrip()
    return (
        ROLES.index(role) if role else 3,
        int(np.searchsorted(SIZES, len(text))) if text else 0,
        0 if not text else 1 if text[-1] == "?" else 2,
        int(after_blank),
        int(bool(LISTED.match(text))),
    )


@dataclass
class Model:
    """Log probabilities: of the first state, of the next, and of each feature's values."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    @classmethod
    def of_counts(cls, counts: dict[tuple[str, int, int], int], smooth: float = 0.5) -> Model:
        """``counts``: (kind, state, value) to number, kinds being start, move and the features.
        A turn's further lines follow its first; that is the only fixed zero. Markers are smoothed
        less: a speaker's name outweighs the look of a line."""

        def shares(kind: str, rows: int, width: int, allowed: np.ndarray | None = None) -> np.ndarray:
            table = np.full((rows, width), smooth / 100 if kind == "marker" else smooth)
            for (k, s, v), n in counts.items():
                if k == kind:
                    table[s, v] += n
            if allowed is not None:
                table = np.where(allowed, table, 0)
            with np.errstate(divide="ignore"):
                return np.log(table / table.sum(axis=1, keepdims=True))

        later = np.array([[t % 2 == 0 or t // 2 == s // 2 for t in range(STATES)] for s in range(STATES)])
        first = np.array([[t % 2 == 0 for t in range(STATES)]])
        emit = [shares(name, STATES, width) for name, width in FEATURES.items()]
        return cls(shares("start", 1, STATES, first)[0], shares("move", STATES, STATES, later), emit)


class Decoder:
    """Viterbi over the lines of one transcript as they come. Lines are given out once the paths
    into all states agree on them, so a long transcript is not held whole."""

    def __init__(self, model: Model):
        self.model, self.score = model, None
        self.back: list[np.ndarray] = []
        self.block = LEAST_BLOCK

    def add(self, seen: tuple[int, ...]) -> None:
        emitted = sum(table[:, v] for table, v in zip(self.model.emit, seen))
        if self.score is None:
            self.score = self.model.start + emitted
            self.back.append(np.full(STATES, -1))
            return
        paths = self.score[:, None] + self.model.move
        came = paths.argmax(axis=0)
        self.score = paths[came, np.arange(STATES)] + emitted
        self.score -= self.score.max()
        self.back.append(came)

    def decided(self) -> list[int]:
        """The states of the leading lines that no later line can change."""
        if len(self.back) < self.block:
            return []
        at = np.arange(STATES)
        for i in range(len(self.back) - 1, 0, -1):
            at = self.back[i][at]
            if (at == at[0]).all():
                path = self._trace(i - 1, int(at[0]))
                self.back, self.block = self.back[i:], LEAST_BLOCK
                return path
        self.block *= 2
        return []

    def _trace(self, i: int, state: int) -> list[int]:
        path = [state]
        for j in range(i, 0, -1):
            state = int(self.back[j][state])
            path.append(state)
        return path[::-1]

    def rest(self) -> list[int]:
        return self._trace(len(self.back) - 1, int(self.score.argmax())) if self.back else []


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, value, line, first of the transcript, last of its row, after a blank line)."""
    before, blank = object(), False
    for batch in batches:
        for key, text, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for n, line in enumerate((text or "").split("\n")):
                new = key != before
                yield key, value, line, new, n == 0, blank and not new
                before, blank = key, not line.strip()


def _laid(turns: DataFrame, id_col: str, order_col: str, text: Column, value: Column) -> DataFrame:
    key = F.col(f"`{id_col}`").cast("string").alias("key")
    rows = turns.select(key, text.alias("text"), value.alias("value"), F.col(f"`{order_col}`").alias("at"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "text").select("key", "text", "value")


def fit(turns: DataFrame, id_col: str, order_col: str, text: Column, role: Column) -> Model:
    """Count states and features over all labelled turns, in order; rows whose role is none of
    ``ROLES`` are left out. The counts are a few hundred numbers."""
    known = turns.where(F.coalesce(role, F.lit("")).isin(*ROLES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        state = 0
        for _, value, line, new, first, blank in _lines(batches):
            last, state = state, 2 * ROLES.index(value) + (0 if first else 1)
            counts["start" if new else "move", 0 if new else last, state] += 1
            for name, v in zip(FEATURES, observe(line, blank)):
                counts[name, state, v] += 1
        rows = [(k, s, v, n) for (k, s, v), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "state", "value", "n"])

    counted = _laid(known, id_col, order_col, text, role).mapInArrow(count, "kind string, state long, value long, n long")
    total = counted.groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect()
    return Model.of_counts({(r["kind"], r["state"], r["value"]): r["n"] for r in total})


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def parse(lines: DataFrame, model: Model, id_col: str, order_col: str, text: Column) -> DataFrame:
    """(key, turn, role, text, rendered), one row per turn recovered.

    The rows of an id, in order, are its transcript; a row may hold many lines. ``key`` is the id
    as a string; null ids are one transcript. Null and empty texts are blank lines; blank lines
    at a turn's ends are not part of it, and a turn of blank lines alone is left out. Repeated
    rows are repeated lines. A transcript is read by one task, line by line: memory holds the
    turn at hand and the lines whose roles later lines can still change.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, waiting, held, key, turn, rows = Decoder(model), deque(), [], None, 0, []

        def place(states: list[int]) -> None:
            for state in states:
                line = waiting.popleft()
                if state % 2 == 0:
                    close()
                    line = marker(line)[1]
                held.append((state // 2, line))

        def close() -> None:
            nonlocal turn
            body = "\n".join(line for _, line in held).strip("\n\r \t")
            if body:
                role = ROLES[held[0][0]]
                rows.append((key, turn, role, body, render(role, body)))
                turn += 1
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["key", "turn", "role", "text", "rendered"])

        started = False
        for k, _, line, new, _, blank in _lines(batches):
            if new:
                if started:
                    place(decoder.rest())
                    close()
                decoder, key, turn, started = Decoder(model), k, 0, True
                waiting.clear()
                if len(rows) >= 1000:
                    yield batch()
            decoder.add(observe(line, blank))
            waiting.append(line)
            place(decoder.decided())
        if started:
            place(decoder.rest())
            close()
        yield batch()

    laid = _laid(lines, id_col, order_col, text, F.lit(None).cast("string"))
    return laid.mapInArrow(run, "key string, turn long, role string, text string, rendered string")
