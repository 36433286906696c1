"""Periodic run detection (operator 13).

A run is a maximal stretch of words with smallest period q that repeats it ``repeats`` times.
Words q apart match all along it, so at the scale S with S <= q < 2S it holds a block of S words
that starts at a multiple of S (an anchor) and returns q words later. Documents are exploded
into overlapping tiles per scale; a tile none of whose anchors' blocks returns at that distance
holds no part of a run and is not sent on. Tiles are solved alone: Z-functions at each anchor
tell how far every period of the octave reaches forward and back. The pieces are shuffled by
document and period, and pieces that meet are stitched to runs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescope.llm.shared import small_batches, written

MIN_WORDS, REPEATS = 24, 3
WORDS_AT_ONCE = 200_000
TILE_ANCHORS = 16
TEXTS_AT_ONCE = 512

Piece = tuple[int, int, int]  # period, first place whose word returns, end of these places

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


# --- scales and tiles ---------------------------------------------------------------


def first_scale(min_words: int) -> int:
    """The largest power of two of which a run of ``min_words`` words holds an aligned block,
    whatever its period below it."""
    return 1 << max(min_words // 3, 1).bit_length() - 1


def _power(which: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers[which]) < n:
        factors = np.full(max(n, 2 * WORDS_AT_ONCE), _BASE if which == "up" else _INVERSE)
        factors[0] = 1
        _powers[which] = np.cumprod(factors, dtype=np.uint64)
    return _powers[which][:n]


def _prefix_sums(words: np.ndarray) -> np.ndarray:
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    return np.concatenate(([np.uint64(0)], np.cumsum(mixed * _power("up", len(words)), dtype=np.uint64)))


def returning_anchors(sums: np.ndarray, scale: int, first: bool) -> np.ndarray:
    """Anchors (multiples of ``scale``) whose block of ``scale`` words seems to return ``scale``
    to 2 * scale - 1 words later, or from one word later on at the first scale. Equal blocks
    have equal sums, so none is missed."""
    n = len(sums) - 1 - scale + 1
    if n < 2:
        return np.zeros(0, np.int64)
    blocks = (sums[scale:] - sums[:-scale]) * _power("down", n)
    rows = -(-n // scale)
    # The pad repeats no block: its values are only met by blocks before it.
    padded = np.concatenate((blocks, np.full(rows * scale - n, ~blocks[-1]))).reshape(rows, scale)
    hit = np.zeros(rows, bool)
    hit[:-1] = (padded[1:] == padded[:-1, :1]).any(axis=1)
    if first:
        hit |= (padded[:, 1:] == padded[:, :1]).any(axis=1)
    return np.flatnonzero(hit) * scale


def tiles(words: np.ndarray, ends: np.ndarray, min_words: int, repeats: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(document, scale, start, end, anchors) of the tiles to solve. ``words`` holds documents
    one after the other, each followed by a word of its own; ``ends`` their ends."""
    sums = _prefix_sums(words)
    starts = np.concatenate(([0], ends[:-1] + 1))
    longest, scale, first = int((ends - starts).max(initial=0)), first_scale(min_words), first_scale(min_words)
    while repeats * (scale if scale > first else 1) <= longest:
        at = returning_anchors(sums, scale, scale == first)
        doc = np.searchsorted(ends, at)
        at, doc = at[at < ends[doc]], doc[at < ends[doc]]
        if len(at):
            place = at // (scale * TILE_ANCHORS)
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(place) != 0)) + 1
            for anchors, d in zip(np.split(at, cut), doc[np.concatenate(([0], cut))].tolist()):
                start, end = max(int(starts[d]), int(anchors[0]) - scale), min(int(ends[d]), int(anchors[-1]) + 4 * scale)
                yield d, scale, start, end, anchors
        scale *= 2


# --- tiles, solved ------------------------------------------------------------------


def z_function(s: list[int], upto: int) -> list[int]:
    """How many items from each of the first ``upto`` places on agree with those from the start."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _prime_divisors(q: int) -> list[int]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return found + [q] * (q > 1)


def solve(words: list[int], scale: int, anchors: list[int], first: bool) -> list[Piece]:
    """Pieces (period, from, to), places in the tile: word i equals word i + period for all i in
    [from, to). A piece ends at most 2 * scale after its anchor and ``scale`` before it; pieces
    of the next anchors go on from there. Periods that are multiples of a smaller one are none."""
    spans: dict[int, list[list[int]]] = {}
    for c in anchors:
        ahead = words[c : c + 4 * scale]
        z = z_function(ahead, min(2 * scale, len(ahead)))
        found = [q for q in range(1 if first else scale, len(z)) if z[q] >= scale]
        # With a smaller period of the stretch the whole run has it: it is found as that.
        found = [q for q in found if not any(z[q // d] >= q + scale - q // d for d in _prime_divisors(q))]
        if not found:
            continue
        low, high = max(0, c - scale), min(c + 2 * scale, len(words))
        behind = words[low:c][::-1]
        back = z_function([*behind, -1, *words[low:high][::-1]], len(behind) + 1 + high - c)
        for q in found:
            start, end = c - back[len(behind) + 1 + high - c - q], c + min(z[q], 2 * scale)
            of_period = spans.setdefault(q, [])
            if of_period and start <= of_period[-1][1]:
                of_period[-1][1] = max(end, of_period[-1][1])
            else:
                of_period.append([start, end])
    return [(q, a, b) for q, parts in spans.items() for a, b in parts]


# --- on Spark -----------------------------------------------------------------------

_PART = "key binary, n_words long, words binary, marked boolean, scale int, at long, anchors binary, tile binary"


def _to_parts(min_words: int, repeats: int):
    def flush(ids: list, keys: list, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        number = defaultdict()
        number.default_factory = number.__len__
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        words = np.zeros(int(ends[-1]) + 1, np.int64)
        for text, end, n in zip(texts, ends.tolist(), lengths.tolist()):
            words[end - n : end] = np.fromiter(map(number.__getitem__, text), np.int64, n)
        words[ends] = len(number) + np.arange(len(ends))  # ends are met by nothing
        starts, marked, rows = ends - lengths, [False] * len(texts), []
        for d, scale, start, end, anchors in tiles(words, ends, min_words, repeats):
            marked[d] = True
            rows.append((ids[d], keys[d], scale, start - int(starts[d]), (anchors - start).astype(np.int32).tobytes(), words[start:end].astype(np.int32).tobytes()))
        none = [None] * len(texts)
        joined = [b" ".join(t) for t in texts]
        yield batch(ids, keys, lengths.tolist(), joined, marked, none, none, none, none)
        for i in range(0, len(rows), TEXTS_AT_ONCE):
            part = rows[i : i + TEXTS_AT_ONCE]
            tile_ids, tile_keys, scale, at, anchors, tile = zip(*part)
            none = [None] * len(part)
            yield batch(tile_ids, tile_keys, none, none, none, scale, at, anchors, tile)

    def batch(ids, keys, n_words, words, marked, scale, at, anchors, tile) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip((keys, n_words, words, marked, scale, at, anchors, tile), kinds)]
        names = ["id", "key", "n_words", "words", "marked", "scale", "at", "anchors", "tile"]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type[0]), *columns], names=names)

    id_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, texts, n = [], [], [], 0
        for b in batches:
            id_type[:] = [b.column(0).type]
            for id_, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_py() or b""
                ids.append(id_)
                keys.append(xxhash.xxh3_128_digest(raw))
                texts.append(raw.split())  # bytes: the six ASCII blanks only
                n += len(texts[-1])
                if n >= WORDS_AT_ONCE:
                    yield from flush(ids, keys, texts)
                    ids, keys, texts, n = [], [], [], 0
        if ids:
            yield from flush(ids, keys, texts)

    return run


def _solved(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, period, start, end = [], [], [], []
            for i in range(b.num_rows):
                words = np.frombuffer(b.column("tile")[i].as_py(), np.int32).tolist()
                anchors = np.frombuffer(b.column("anchors")[i].as_py(), np.int32).tolist()
                scale, at = b.column("scale")[i].as_py(), b.column("at")[i].as_py()
                for q, x, y in solve(words, scale, anchors, scale == first):
                    row.append(i)
                    period.append(q)
                    start.append(at + x)
                    end.append(at + y)
            took = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(took), b.column("key").take(took), *[pa.array(v, pa.int64()) for v in (period, start, end)]],
                names=["id", "key", "period", "start", "end"],
            )

    return run


def stitch(pieces: DataFrame, min_words: int, repeats: int) -> DataFrame:
    """(id, key, start, period, length): runs from pieces of matching places that meet."""
    along = Window.partitionBy("id", "key", "period").orderBy("start", "end")
    so_far = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > so_far, F.lit(True)).cast("long")
    numbered = pieces.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(along))
    whole = numbered.groupBy("id", "key", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    long_enough = (length >= min_words) & (length >= repeats * F.col("period"))
    return whole.where(long_enough).select("id", "key", "start", "period", length.alias("length"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, found in zip(b.column("words"), b.column("runs").to_pylist()):
            words = text.as_py().split()
            change = np.zeros(len(words) + 1, np.int64)
            for r in found or ():
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            out.append(b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist())))
        at = b.schema.get_field_index("words")
        yield b.set_column(at, "words", pa.array(out, pa.binary()))


def with_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """(id, n_words, runs, collapsed), a row per row of ``docs``.

    ``runs`` holds (start, period, length) by start and then period: every maximal stretch of
    words with smallest period ``period`` that has ``min_words`` words and ``repeats`` periods.
    ``collapsed`` is the text without the words that a run repeats, joined by single spaces.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Rows without
    an id and repeated rows are rows like others, and rows that share an id but not the text are
    told apart by a digest of the text. Texts of any length are covered whole. Other columns are
    not read.
    """
    if repeats < 3:
        raise ValueError("runs are found from three repeats on")
    spark = docs.sparkSession
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    runs_type = "array<struct<start:bigint,period:bigint,length:bigint>>"
    with small_batches(spark, TEXTS_AT_ONCE):
        parts = written(read.mapInArrow(_to_parts(min_words, repeats), f"id {kind}, {_PART}"), "run-parts")
        todo = parts.where("scale IS NOT NULL").select("id", "key", "scale", "at", "anchors", "tile").repartition("id", "key", "scale", "at")
        pieces = todo.mapInArrow(_solved(first_scale(min_words)), f"id {kind}, key binary, period long, start long, end long")
        found = stitch(pieces, min_words, repeats)
        # As many runs as a document has words, at most: they fit where its text does.
        runs = F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")
        of_text = written(found.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(runs), "runs")
        texts = parts.where("scale IS NULL")
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
        marked = texts.where("marked").join(of_text, same, "left").select("id", "n_words", "words", "runs")
        shorter = written(marked.mapInArrow(_collapsed, f"id {kind}, n_words long, words binary, runs {runs_type}"), "collapsed")
    plain = texts.where("NOT marked").select("id", "n_words", "words", F.lit(None).cast(runs_type).alias("runs"))
    every = plain.unionByName(shorter)
    return every.select(
        "id", "n_words", F.coalesce("runs", F.array().cast(runs_type)).alias("runs"), F.col("words").cast("string").alias("collapsed")
    )


def greatest_run(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the first in order."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>"), better)
