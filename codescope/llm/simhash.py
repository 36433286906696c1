"""Near duplicates by SimHash (operator 1).

Fingerprints that differ in at most ``distance`` bits are linked. Cut into ``blocks`` blocks,
two linked fingerprints agree on at least ``blocks - distance`` of them, so they meet under
one of the keys made of that many blocks. Keys that many different fingerprints share are cut
into tiles of bounded size, and a tile reports a forest that spans its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.llm.shared import free_name, small_batches, written
from codescope.operators.graph import connected_components

BITS = 64
SEED = 42
TILE_ROWS = 2048
CHUNK_SHINGLES = 16_384
TEXTS_AT_ONCE = 256


def _hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def _majority(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def _ones(hashes: list[int]) -> np.ndarray:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK_SHINGLES):
        part = np.array(hashes[i : i + CHUNK_SHINGLES], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return ones


def _fingerprints(texts: list[bytes | None], width: int) -> list[int]:
    # One text's hashes at a time: as Python numbers they take many times its size.
    return [_majority(_ones(h := _hashes(t or b"", width)), len(h)) for t in texts]


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3, name: str = "simhash", keep_text: bool = True) -> DataFrame:
    """``docs`` with a 64-bit SimHash as a (signed) long under ``name``, and without the text
    unless it is to be kept: it then goes to Python and back beside its bytes."""
    content = free_name(docs, "content")
    sent = docs.withColumn(content, F.col(f"`{text}`").cast("binary"))
    if not keep_text:
        sent = sent.drop(text)
    schema = sent.drop(content).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(content).to_pylist()
            marks = np.array(_fingerprints(texts, width), np.uint64).view(np.int64)
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != content]
            names = [n for n in batch.schema.names if n != content]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(marks)], names=[*names, name])

    return sent.mapInArrow(run, schema)


def block_masks(distance: int, blocks: int) -> list[int]:
    """A mask for every choice of ``blocks - distance`` blocks, as signed 64-bit numbers."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(block, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _forest(marks: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the groups of close fingerprints: (found from, found) as positions."""
    if len(marks) == 2:
        return [(0, 1)] if int(marks[0] ^ marks[1]).bit_count() <= distance else []
    left, links = np.arange(len(marks)), []
    while len(left) > 1:
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(marks[left] ^ marks[at]) <= distance
            found = left[near].tolist()
            links += [(at, x) for x in found]
            frontier += found
            left = left[~near]
    return links


def _links_of_tiles(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((5, 0), np.int64)
        for batch in batches:
            rows = np.vstack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            rows = np.hstack([rest, rows])
            yield from links(rows[:, : (cut := last_start(rows))])
            rest = rows[:, cut:]
        yield from links(rest)

    def starts(rows: np.ndarray) -> np.ndarray:
        return np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1

    def last_start(rows: np.ndarray) -> int:
        s = starts(rows) if rows.shape[1] else []
        return int(s[-1]) if len(s) else 0

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        s = starts(rows)
        a, b = np.concatenate(([0], s)), np.concatenate((s, [rows.shape[1]]))
        many = b - a > 1
        found = []
        for i, j in zip(a[many].tolist(), b[many].tolist()):
            marks = rows[4, i:j].view(np.uint64) if rows.flags.c_contiguous else np.ascontiguousarray(rows[4, i:j]).view(np.uint64)
            found += [(i + x, i + y) for x, y in _forest(marks, distance)]
        if found:
            at = np.array(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[4, at[:, k]]) for k in (0, 1)], names=["src", "dst"])

    return run


def links(marks: DataFrame, distance: int = 3, blocks: int = 6, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(src, dst): links that join the same groups as all pairs within ``distance`` bits.

    ``marks`` has one column ``mark`` with distinct fingerprints. A key shared by more than
    ``tile_rows`` of them is dealt to parts of about that size, and every two parts meet in
    one tile: all its pairs are compared, in tasks of bounded size.
    """
    masks = block_masks(distance, blocks)
    keys = marks.select(
        "mark",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("choice"), F.col("mark").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
        ).alias("k"),
    ).select("k.choice", "k.key", "mark")
    heavy = (
        keys.groupBy("choice", "key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > tile_rows)
        .select("choice", "key", F.ceil(F.col("n") / tile_rows).cast("int").alias("parts"))
    )
    dealt = keys.join(written(heavy, "heavy-keys"), ["choice", "key"], "left")
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("mark"), parts).cast("int")
    tiles = dealt.withColumn("part", part).select(
        "choice", "key", "mark", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    )
    tiles = tiles.select(
        F.col("choice").cast("long").alias("choice"),
        "key",
        F.least("part", "other").cast("long").alias("low"),
        F.greatest("part", "other").cast("long").alias("high"),
        "mark",
    )
    place = ["choice", "key", "low", "high"]
    laid = tiles.repartition(*place).sortWithinPartitions(*place)
    return laid.mapInArrow(_links_of_tiles(distance), "src long, dst long")


def _grouped(docs: DataFrame, id_col: str, mark: str, distance: int, blocks: int, tile_rows: int) -> DataFrame:
    """(mark, component): the smallest id that a fingerprint reaches."""
    marks = written(docs.groupBy(F.col(mark).alias("mark")).agg(F.min(id_col).alias("least")), "marks")
    groups = connected_components(links(marks.select("mark"), distance, blocks, tile_rows))
    groups = written(groups.toDF("mark", "group"), "groups")
    named = marks.join(groups, "mark", "left").select("mark", "least", F.coalesce("group", "mark").alias("group"))
    least = written(named.groupBy("group").agg(F.min("least").alias("component")), "components")
    return named.join(least, "group").select("mark", "component")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = 3,
    distance: int = 3,
    blocks: int = 6,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``.

    Null and empty texts have the fingerprint zero and are linked like any other. Rows whose
    id is null take part; a component without any id is null. Repeated rows stay repeated.
    Columns other than the id and the text are not read.
    """
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        marked = written(with_fingerprint(read, "text", width, "mark", keep_text=False), "fingerprints")
    groups = written(_grouped(marked, "id", "mark", distance, blocks, tile_rows), "fingerprint-groups")
    return marked.join(groups, "mark").select(F.col("id").alias(id_col), hexed("mark").alias("fingerprint"), F.col("component").alias("component_id"))


def hexed(mark: str) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The row with the smallest id of every group of near duplicates, all columns kept.

    Rows with a null id are kept: no id tells them apart, so none can stand for another.
    Of rows that repeat an id, all are kept or none.
    """
    groups = near_duplicates(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, **settings)
    copies = groups.where(F.col(id_col) != F.col("component_id"))
    gone = free_name(docs, "gone")
    copies = written(copies.select(F.col(id_col).alias(gone)).distinct(), "near-copies")
    return docs.join(copies, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
