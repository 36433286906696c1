"""Benchmark decontamination by pigeonhole edit matching (operator 6).

A passage within k edits of a test item holds one of any k + 1 pieces of the item unchanged.
All pieces of a shard of items are found in one pass over a text (Aho-Corasick); around every
hit, Myers' bit-parallel algorithm gives the least edit distance and where it ends. Items are
read in shards of bounded size, one pass over the documents each, so the benchmark may grow.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.08
EXACT_BELOW = 40  # letters; a shorter item must be found exactly, as whole words
SHARD_CHARS = 8_000_000
WIDE_GAP = re.compile(r"\s{2,}|[^\S ]")


def normalized(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Lower case with single spaces, and (place, shift) pairs that lead back: a place p stands
    for p plus the shift of the last pair at or before it. Letters whose lower case has another
    length stay as they are."""
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    parts, shifts, at, done = [], [(0, 0)], 0, 0
    for gap in WIDE_GAP.finditer(lowered):
        parts += [lowered[done : gap.start()], " "]
        at += gap.start() - done + 1
        done = gap.end()
        shifts.append((at, done - at))
    parts.append(lowered[done:])
    return "".join(parts), shifts


def original(place: int, shifts: list[tuple[int, int]]) -> int:
    low, high = 0, len(shifts)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if shifts[mid][0] <= place else (low, mid)
    return place + shifts[low][1]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least distance of ``pattern`` to a passage of ``text``, where it ends first). One bit of
    a whole number per letter of the pattern; a step per letter of the text."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    ones, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        level = eq | down
        eq |= ((eq & up) + up) ^ up
        plus, minus = down | ~(eq | up) & ones, up & eq
        score += (plus & last != 0) - (minus & last != 0)
        if score < best:
            best, end = score, j
        plus, minus = plus << 1 & ones, minus << 1 & ones
        up, down = minus | ~(level | plus) & ones, plus & level
    return best, end


def ends_within(pattern: str, text: str, most: int) -> list[tuple[int, int]]:
    """(distance, end) of the passages of ``text`` within ``most`` edits of ``pattern``: the local
    minima of the distance over all ends, the first of equal neighbours. Steps as in ``myers``."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    ones, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    found, falling, before = [], True, m + 1
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        level = eq | down
        eq |= ((eq & up) + up) ^ up
        plus, minus = down | ~(eq | up) & ones, up & eq
        score += (plus & last != 0) - (minus & last != 0)
        plus, minus = plus << 1 & ones, minus << 1 & ones
        up, down = minus | ~(level | plus) & ones, plus & level
        if score < before:
            falling, low = True, j
        elif score > before:
            if falling and before <= most:
                found.append((before, low))
            falling = False
        before = score
    if falling and before <= most and text:
        found.append((before, low))
    return found


def budget(n: int, error_rate: float) -> int:
    return int(n * error_rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece): the item in ``errors + 1`` pieces of about equal length."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Matcher:
    """Finds the items of one shard in texts."""

    def __init__(self, items: list[tuple], error_rate: float, exact_below: int = EXACT_BELOW):
        self.items = [(key, plain) for key, text in items if (plain := normalized(text)[0].strip())]
        self.exact_below = exact_below
        self.budgets = [budget(len(t), error_rate) if len(t) >= exact_below else 0 for _, t in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            for start, piece in pieces(text, self.budgets[n]):
                places.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, listed in places.items():
            self.automaton.add_word(piece, (len(piece), listed))
        if places:
            self.automaton.make_automaton()

    def _windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per item, where it may lie: overlapping surroundings of its hits are joined."""
        spans: dict[int, list[list[int]]] = {}
        for end, (size, listed) in self.automaton.iter(text):
            for n, start in listed:
                at = end + 1 - size - start
                low, high = max(0, at - self.budgets[n]), min(len(text), at + len(self.items[n][1]) + self.budgets[n])
                of = spans.setdefault(n, [])
                if of and low <= of[-1][1] and low >= of[-1][0]:
                    of[-1][1] = max(of[-1][1], high)
                else:
                    of.append([low, high])
        return spans

    def find(self, text: str) -> list[tuple]:
        """(item key, start, end, edits) with places in the text as given. Of passages of an item
        that overlap, the one of fewer edits is given, or the first."""
        if not len(self.automaton):
            return []
        plain, shifts = normalized(text)
        found = []
        for n, windows in self._windows(plain).items():
            key, item = self.items[n]
            ends = {(edits, low + end) for low, high in windows for edits, end in ends_within(item, plain[low:high], self.budgets[n])}
            # Taken passages lie apart: (start, end) in order, so only neighbours can overlap.
            taken: list[tuple[int, int]] = []
            for edits, end in sorted(ends):
                # From the end, backwards, the least distance ends at the passage's start.
                _, size = banded_end(item[::-1], plain[max(0, end - len(item) - edits) : end][::-1], edits)
                start = end - size
                if len(item) < self.exact_below and not whole_words(plain, start, end):
                    continue
                at = bisect(taken, (start, end))
                if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                    continue
                taken.insert(at, (start, end))
                found.append((key, original(start, shifts), original(end - 1, shifts) + 1, edits))
        return sorted(set(found), key=lambda f: f[1:3])


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word goes on across either end of a passage."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    after = end < len(text) and text[end].isalnum() and text[end - 1].isalnum()
    return not (before or after)


def banded_end(pattern: str, text: str, edits: int) -> tuple[int, int]:
    """(distance, length) of the prefix of ``text`` nearest to the whole pattern, by a band of
    width ``edits`` around the diagonal; shortest first."""
    m, far = len(pattern), edits + 1
    row = {j: j for j in range(min(len(text), edits) + 1)}
    for i in range(1, m + 1):
        new = {}
        for j in range(max(0, i - edits), min(len(text), i + edits) + 1):
            step = row.get(j, far) + 1
            if j:
                step = min(step, new.get(j - 1, far) + 1, row.get(j - 1, far) + (pattern[i - 1] != text[j - 1]))
            new[j] = min(step, far)
        row = new
    return min((d, j) for j, d in row.items())


def _shards(spark, benchmark: DataFrame, item_col: str, item_text: str, shard_chars: int) -> Iterator:
    """Broadcast lists of (item, text): items go to shards by a hash, as many as keep one at about
    ``shard_chars`` letters, and are read a shard at a time."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")).dropna()
    items = items.distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * size // shard_chars) if size > shard_chars else 1
    for shard in range(n):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == shard).orderBy("item", "text")
        yield spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()])


MATCHES = "array<struct<item: {kind}, start: int, end: int, edits: int>>"


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    back: list[str] | None = None,
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    exact_below: int = EXACT_BELOW,
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """(row, matches), one row per row of ``docs`` and shard of the benchmark: ``matches`` lists
    the items found with the place of the passage in the text (in characters) and its edits.

    Letter case and the amount of white space do not count. Items shorter than ``exact_below`` after that
    are found as they are, as whole words. Null texts match nothing; null items and items without
    letters are skipped; repeated items are found like others. Texts of any length are searched whole. ``row`` has the columns ``back`` (all if not
    given). A benchmark of at most ``shard_chars`` letters is one shard.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    names = docs.columns if back is None else back
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    parts = []
    for shared in _shards(docs.sparkSession, benchmark, item_col, item_text, shard_chars):
        parts.append(rows.select("row", _matching(shared, error_rate, exact_below, kind)("text").alias("matches")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def without_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    exact_below: int = EXACT_BELOW,
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; arguments as ``find_matches``."""
    kind = benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    for shared in _shards(docs.sparkSession, benchmark, item_col, item_text, shard_chars):
        rows = rows.where(F.size(_matching(shared, error_rate, exact_below, kind)("text")) == 0)
    return rows.select("row.*")


def _matching(shared, error_rate: float, exact_below: int, kind: str):
    @F.pandas_udf(MATCHES.format(kind=kind))
    def match(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, error_rate, exact_below)
        for some in texts:
            yield pd.Series([[dict(zip(("item", "start", "end", "edits"), f)) for f in matcher.find(t)] if t else [] for t in some])

    return match
