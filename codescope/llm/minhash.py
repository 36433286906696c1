"""Near duplicates by MinHash with tensored tables (operator 12).

A text is its set of shingles. Two small collections of ``SUBKEYS`` sub-keys, each of ``ROWS``
minimal hashes, are worked out per set; every pair of a sub-key from the one and a sub-key from
the other is a table key. So SUBKEYS ** 2 tables of 2 * ROWS hashes each cost 2 * SUBKEYS * ROWS
hashes, about the square root of what they would cost one by one. Sets of similarity s share no
table with probability 1 - (1 - (1 - s**ROWS)**SUBKEYS)**2: 1 in 7,000 at s = 0.85.

Tables propose, sets decide. A bucket is never expanded to its pairs. In each round the sets of
a bucket meet its head, and every group of sets takes its best supported partner. When rounds
find little more, what is left in buckets of several groups is joined exactly by prefixes: two
sets of the wanted similarity share one of the few rarest shingles of each, at places that leave
enough of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.llm.shared import free_name, small_batches, written
from codescope.llm.simhash import _hashes
from codescope.operators.graph import connected_components
from codescope.session import cut_and_count, lookup_side

SUBKEYS, ROWS = 10, 3
TEXTS_AT_ONCE = 256
AT_ONCE = 1024  # shingles times 2 * SUBKEYS * ROWS products that fit a cache
TILE_ROWS = 2048
SLOTS = 1 << 20  # counters of shingles, whatever the size of the corpus
BITS = 2048  # of a set's parity bits, more only for long texts
PAYS, ADDS = 0.1, 0.01  # rounds go on while this part of the tried pairs is linked, and of all links is new
_RNG = np.random.default_rng(12)
_FACTORS = _RNG.integers(0, 1 << 63, 2 * SUBKEYS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, ROWS + 3, np.uint64) * np.uint64(2) + np.uint64(1)

Similarity = tuple[int, int]  # a ratio of whole numbers


# --- sets and keys ------------------------------------------------------------------


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The set of hashed shingles of ``width`` words (fewer words: all of them as one), sorted."""
    return np.unique(np.array(_hashes(text or b"", width), np.uint64))


def set_key(found: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    mixed = (found ^ found >> np.uint64(29)) * _MIX[ROWS]
    size = np.array([len(found)], np.uint64) * _MIX[ROWS + 1]  # arrays wrap without a warning
    total = size[0] ^ np.bitwise_xor.reduce(mixed ^ mixed >> np.uint64(32), initial=np.uint64(0))
    return int((total ^ (found * _MIX[ROWS + 2]).sum(dtype=np.uint64)).view(np.int64))


def subkeys(found: np.ndarray) -> np.ndarray:
    """2 * SUBKEYS signed numbers: the sub-keys of the first collection, then of the second."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), AT_ONCE):
        np.minimum(least, (found[i : i + AT_ONCE, None] * _FACTORS).min(axis=0), out=least)
    least ^= least >> np.uint64(31)
    return (least.reshape(2 * SUBKEYS, ROWS) * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            nodes, sizes, keys = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2 * SUBKEYS), np.int64)
            for i, text in enumerate(batch.column("text")):
                found = shingles(text.as_py(), width)
                nodes[i], sizes[i], keys[i] = set_key(found), len(found), subkeys(found)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * 2 * SUBKEYS)
            lists = pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))
            columns = [batch.column("id"), batch.column("text_key"), pa.array(nodes), pa.array(sizes), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "node", "n", "keys"])

    return run


def _sets(width: int):
    """(node, set) of the texts asked for; a text that shares its key with the one meant is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), width)
                if set_key(s) == node:
                    nodes.append(node)
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "set"])

    return run


# --- verification -------------------------------------------------------------------


def similar(x: np.ndarray, y: np.ndarray, least: Similarity) -> bool:
    """Whether the common part of two sorted sets is at least least[0] / least[1] of both together."""
    num, den = least
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, sets: DataFrame, least: Similarity) -> DataFrame:
    """The pairs (src, dst) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield batch.select(["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    a, b = sets.toDF("src", "a"), sets.toDF("dst", "b")
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


# --- prefixes -----------------------------------------------------------------------


def _slots_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for s in batch.column(0):
            total += np.bincount((np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])


def prefix(found: np.ndarray, counts: np.ndarray, least: Similarity) -> np.ndarray:
    """The rarest shingles, of which a similar set has at least one among its own rarest."""
    num, den = least
    size = len(found) - -(-num * len(found) // den) + 1
    frequency = counts[(found % np.uint64(SLOTS)).astype(np.int64)]
    return found[np.lexsort((found, frequency))[:size]]


def parity_bits(found: np.ndarray, least: Similarity) -> bytes:
    """Whether an odd number of shingles fall on each of b places. Two sets differ in at least as
    many shingles as their bits do; b is a power of two, some times the number of shingles in
    which sets of this size may differ and still be similar: 32 times up to BITS, 4 times beyond."""
    num, den = least
    apart, b = 2 * len(found) * (den - num) // (num + den), 64
    while b < 4 * apart or b < min(32 * apart, BITS):
        b *= 2
    odd = np.bincount((found >> np.uint64(20) & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parity bits for fewer places."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _prefixes(counts, least: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("set")]
            keys = [prefix(f, counts.value, least).view(np.int64) for f in found]
            ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            sizes = pa.array([len(f) for f in found], pa.int64())
            bits = pa.array([parity_bits(f, least) for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, lists, bits], names=["node", "n", "keys", "bits"])

    return run


_TILE = ["key", "low", "high", "node", "group", "n", "place"]


def _pairs_of_tiles(least: Similarity, best: bool):
    """(group, src, dst, apart) of the sets of one tile that can still be similar enough: of other
    groups, of sizes near enough, with enough left from the shared shingle on, and with parity
    bits that differ little enough. ``best``: of every set the one whose bits differ least."""
    num, den = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, rest_bits = np.zeros((len(_TILE), 0), np.int64), []
        for batch in batches:
            rows = np.hstack([rest, np.vstack([batch.column(c).to_numpy(zero_copy_only=False) for c in _TILE])])
            bits = rest_bits + batch.column("bits").to_pylist()
            cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from pairs(rows[:, :last], bits, cuts[:-1])
            rest, rest_bits = rows[:, last:], bits[last:]
        yield from pairs(rest, rest_bits, np.zeros(0, np.int64))

    def pairs(rows: np.ndarray, bits: list[bytes], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.shape[1]]):
            node, group, n, place = rows[3:, i:j]
            left, words = n - place, np.array([len(x) // 8 for x in bits[i:j]])
            of_size = {w: np.frombuffer(b"".join(x for x in bits[i:j] if len(x) == 8 * w), np.uint64).reshape(-1, w) for w in set(words.tolist())}
            at = np.zeros(j - i, np.int64)
            nearest, other = np.full(j - i, 1 << 62), np.full(j - i, -1)
            for w in of_size:
                at[words == w] = np.arange(np.count_nonzero(words == w))
            for k in range(j - i - 1):
                others = slice(k + 1, None)
                both = n[others] + n[k]
                near = (group[others] != group[k]) & (den * np.minimum(n[others], n[k]) >= num * np.maximum(n[others], n[k]))
                near &= (num + den) * np.minimum(left[others], left[k]) >= num * both
                if not near.any():
                    continue
                found = np.flatnonzero(near) + k + 1
                for w in set(words[found].tolist()):
                    met = found[words[found] == w]
                    few = min(w, int(words[k]))
                    own = folded(of_size[int(words[k])][at[k]][None], few)
                    apart = np.bitwise_count(folded(of_size[w][at[met]], few) ^ own).sum(axis=1, dtype=np.int64)
                    # Similar sets differ in (den - num) / (den + num) of their sizes, at most.
                    can = (num + den) * apart <= (den - num) * (n[met] + n[k])
                    met, apart = met[can], apart[can]
                    if not best:
                        out.append(np.stack((np.full(len(met), group[k]), np.full(len(met), node[k]), node[met], apart)))
                    elif len(met):
                        if apart.min() < nearest[k]:
                            nearest[k], other[k] = apart.min(), met[apart.argmin()]
                        better = apart < nearest[met]
                        nearest[met[better]], other[met[better]] = apart[better], k
            has = np.flatnonzero(other >= 0)
            if len(has):
                out.append(np.stack((group[has], node[has], node[other[has]], nearest[has])))
        if out:
            group, a, b, apart = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group, np.minimum(a, b), np.maximum(a, b), apart)], names=["group", "src", "dst", "apart"])

    return run


def rare_shingles(sets: DataFrame, least: Similarity) -> DataFrame:
    """(node, n, keys, bits): the prefixes of ``sets`` (node, set), the rarest shingle first."""
    counted = sets.select("set").mapInArrow(_slots_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    return written(sets.select("node", "set").mapInArrow(_prefixes(shared, least), "node long, n long, keys array<long>, bits binary"), "prefixes")


def prefix_pairs(rare: DataFrame, groups: DataFrame, least: Similarity, tile_rows: int, best: bool = False) -> DataFrame:
    """(group, src, dst, apart): pairs of ``rare`` that hold all similar ones of two groups of
    ``groups`` (node, group), or for every set and shingle the ``best`` one. Parity bits, by far
    the widest column, join the rows of mixed shingles last."""
    own = rare.select("node", "n", "keys").join(groups, "node")
    rows = own.select("node", "n", "group", F.posexplode("keys").alias("place", "key")).withColumn("place", F.col("place").cast("long"))
    mixed = rows.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.count("*").alias("rows"))
    mixed = written(mixed.where("a < b").select("key", "rows"), "mixed-prefixes")
    dealt = rows.join(mixed, "key").withColumn("parts", F.ceil(F.col("rows") / tile_rows).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # A shingle that many share is cut into parts, and every two parts meet in one tile.
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = met.withColumns({"low": F.least("part", "other").cast("long"), "high": F.greatest("part", "other").cast("long")})
    wide = tiles.select(*_TILE).join(rare.select("node", "bits"), "node").select(*_TILE, "bits")
    laid = wide.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return laid.mapInArrow(_pairs_of_tiles(least, best), "group long, src long, dst long, apart long")


# --- groups -------------------------------------------------------------------------


def _tables(marks: DataFrame) -> DataFrame:
    """(table, key, node): the tensored keys. Sub-keys of the first collection that no two sets
    share are left out before they are combined with those of the second."""
    first = marks.select("node", F.posexplode(F.slice("keys", 1, SUBKEYS)).alias("i", "a"))
    shared = written(first.groupBy("i", "a").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared-subkeys")
    kept = first.join(shared, ["i", "a"])
    second = marks.select("node", F.slice("keys", SUBKEYS + 1, SUBKEYS).alias("b"))
    pairs = kept.join(second, "node").select("node", "i", "a", F.posexplode("b").alias("j", "b"))
    return pairs.select((F.col("i") * SUBKEYS + F.col("j")).cast("short").alias("table"), F.xxhash64("a", "b").alias("key"), "node")


def _groups(links: DataFrame) -> DataFrame:
    """(node, group) of the nodes that have links."""
    return written(connected_components(links).toDF("node", "group"), "set-groups")


def _mixed(buckets: DataFrame) -> DataFrame:
    """``buckets`` (table, key, node, group) that hold several groups, with the head of each."""
    head = F.min(F.struct(F.xxhash64("node").alias("at"), F.col("node").alias("node"), F.col("group").alias("group"))).alias("head")
    heads = buckets.groupBy("table", "key").agg(head, F.min("group").alias("a"), F.max("group").alias("b"))
    return buckets.join(written(heads.where("a < b").select("table", "key", "head"), "heads"), ["table", "key"])


def linked(docs: DataFrame, marks: DataFrame, width: int, least: Similarity, tile_rows: int) -> DataFrame:
    """(node, group): groups of the sets in ``marks`` (node, text_key, keys) that have links.
    ``docs`` holds (text_key, text)."""
    mixed = written(_mixed(_tables(marks).withColumn("group", F.col("node"))), "buckets")
    wanted, n = cut_and_count(marks.join(mixed.select("node").distinct(), "node", "left_semi").select("node", F.col("text_key").alias("_key")))
    texts = docs.join(lookup_side(wanted, n), F.col("text_key") == F.col("_key")).select("node", "text")
    sets = written(texts.mapInArrow(_sets(width), "node long, set binary").dropDuplicates(["node"]), "sets")
    found = _Links(sets, least)
    meeting = mixed.where("group <> head.group").select("group", F.col("node").alias("src"), F.col("head.node").alias("dst"))
    support = meeting.groupBy("group", "src", "dst").agg(F.count("*").alias("n"))
    best = support.groupBy("group").agg(F.max(F.struct("n", F.xxhash64("src", "dst"), "src", "dst")).alias("best"))
    found.try_pairs(best.select("best.src", "best.dst"))
    named = found.named(mixed.select("table", "key", "node"))
    several = named.groupBy("table", "key").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").select("table", "key")
    left = written(mixed.join(several, ["table", "key"], "left_semi").select("node").distinct(), "left-sets")
    rare = rare_shingles(left.join(sets, "node"), least)
    while True:
        near = written(prefix_pairs(rare, found.named(left), least, tile_rows, best=True), "nearest")
        # Groups only grow, so a set that met no other it could be similar to never will.
        left = written(near.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "left-sets")
        best = near.groupBy("group").agg(F.min(F.struct("apart", "src", "dst")).alias("best"))
        if not found.try_pairs(best.select("best.src", "best.dst")):
            break
    found.try_pairs(prefix_pairs(rare, found.named(left), least, tile_rows).select("src", "dst"))
    return found.groups


class _Links:
    """The links found so far, the pairs tried, and the groups of sets that links join."""

    def __init__(self, sets: DataFrame, least: Similarity) -> None:
        self.sets, self.least = sets, least
        self.tried = sets.select(F.col("node").alias("src"), F.col("node").alias("dst")).where("false")
        self.links = self.tried
        self.groups = self.tried.toDF("node", "group")
        self.n_links = 0

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with node) with their group."""
        return rows.join(self.groups, "node", "left").withColumn("group", F.coalesce("group", "node"))

    def try_pairs(self, pairs: DataFrame) -> bool:
        """Verify pairs not yet tried; whether that paid."""
        pairs, n_pairs = cut_and_count(pairs.distinct().join(self.tried, ["src", "dst"], "left_anti"))
        fresh, n_fresh = cut_and_count(_verified(pairs, self.sets, self.least))
        self.tried = self.tried.unionByName(pairs)
        if n_fresh:
            self.links = self.links.unionByName(fresh)
            self.groups = _groups(self.links)
        self.n_links += n_fresh
        return n_fresh > max(PAYS * n_pairs, ADDS * self.n_links)


def components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = 5,
    similarity: Similarity = (8, 10),
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``.

    Letter case (A-Z) and the kind and number of blanks do not count. Texts are linked if their
    sets of shingles have a Jaccard similarity of ``similarity`` or more; a component is named by
    the smallest id in it. Texts without words (null, too) have no shingles, are linked with
    nothing, and are named by their own id. Rows without an id take part; a component without
    any id is null. Repeated rows stay repeated. Sets are told apart by 64-bit numbers. Texts of
    any length are taken whole. Other columns are not read.
    """
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    read = read.withColumn("text_key", F.xxhash64("text"))
    kind = read.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        marked = written(read.mapInArrow(_sketched(width), f"id {kind}, text_key long, node long, n long, keys array<long>"), "sketches")
        held = marked.where("n > 0").groupBy("node")
        marks = written(held.agg(F.min("id").alias("least"), F.min("text_key").alias("text_key"), F.any_value("keys").alias("keys")), "distinct-sets")
        groups = linked(read.select("text_key", "text"), marks, width, similarity, tile_rows)
    named = marks.join(groups, "node", "left").select("node", "least", F.coalesce("group", "node").alias("group"))
    first = written(named.groupBy("group").agg(F.min("least").alias("component")), "first-of-groups")
    of_set = written(named.join(first, "group").select("node", "component"), "set-components")
    empty = marked.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    rows = marked.where("n > 0").select("id", "node", "n").join(of_set, "node")
    return rows.select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(empty)


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The row with the smallest id of every component, all columns kept. Rows with a null id
    are kept, and so are texts without words; of rows that repeat an id, all are kept or none."""
    found = components(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, **settings)
    gone = free_name(docs, "gone")
    copies = written(found.where("id <> component_id").select(F.col("id").alias(gone)).distinct(), "near-copies")
    return docs.join(copies, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
