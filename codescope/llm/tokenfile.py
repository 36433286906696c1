"""Token files compressed by grammar (operator 7).

A shard holds the ids of consecutive documents as a Re-Pair grammar: frequent pairs of ids are
replaced by new symbols again and again; the rules and the length each symbol expands to are
stored, so any range of ids is decoded without the rest. A table of shards is the file format,
written by Spark: (part, shard, doc_ids, lengths, base, rules, expansions, sequence).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codescope.llm.encoding import ID, default_path, encoder, slices
from codescope.llm.shared import release_unused

SHARD_TOKENS = 1 << 20
MIN_COUNT = 16  # a rule pays from this many uses


# --- grammar ------------------------------------------------------------------------


def _frequent_pairs(seq: np.ndarray, symbols: int, min_count: int, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (left, right) that occur at least ``min_count`` times and hold a symbol from
    ``since`` on, with the places where they may lie. A pair is as frequent as its rarer symbol
    at most, so only places of two frequent symbols are counted."""
    at = np.arange(len(seq) - 1)
    if since:
        new = np.flatnonzero(seq >= since)
        near = np.zeros(len(seq) + 1, bool)
        near[new] = near[new + 1] = True
        at = np.flatnonzero(near[1:-1])
    often = np.bincount(seq, minlength=symbols) >= min_count
    at = at[often[seq[at]] & often[seq[at + 1]]]
    packed = np.sort(seq[at].astype(np.int64) << 32 | seq[at + 1])
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
    found = packed[first[np.diff(first, append=len(packed)) >= min_count]]
    return found >> 32, found & 0xFFFFFFFF, at


def _replace(seq: np.ndarray, left: np.ndarray, right: np.ndarray, symbols: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence with the pairs replaced, from the left where they overlap, and the uses of
    each pair. ``at`` has all places of the pairs, and may have others. New symbols follow ``symbols``."""
    row = np.full(symbols, -1, np.int32)
    heads = np.unique(left)
    row[heads] = np.arange(len(heads), dtype=np.int32)
    column = np.full(symbols, -1, np.int32)
    tails = np.unique(right)
    column[tails] = np.arange(len(tails), dtype=np.int32)
    rule = np.full((len(heads) + 1, len(tails) + 1), -1, np.int32)
    rule[row[left], column[right]] = np.arange(len(left), dtype=np.int32)
    found = rule[row[seq[at]], column[seq[at + 1]]]
    at, found = at[found >= 0], found[found >= 0]
    # In a run of neighbouring hits, every other one counts, from the first.
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    run = np.flatnonzero(first)
    if len(at):
        taken = (np.arange(len(at)) - run[np.cumsum(first) - 1]) % 2 == 0
        at, found = at[taken], found[taken]
    out = seq.copy()
    out[at] = symbols + found
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return out[keep], np.bincount(found, minlength=len(left))


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules, expansions, sequence): symbols from ``base`` on are rules, pairs of earlier
    symbols; ``expansions`` has the number of ids of each. Rounds end when no pair
    occurs ``min_count`` times.

    A round leaves no place of a pair that it replaces, and brings no two earlier symbols
    together, so the next one looks for pairs with a symbol of this round only."""
    base = int(ids.max()) + 1 if len(ids) else 0
    seq = ids.astype(np.int32)
    rules, sizes, since = np.zeros((0, 2), np.int64), np.ones(base, np.int64), 0
    while len(seq) > 1:
        symbols = base + len(rules)
        left, right, at = _frequent_pairs(seq, symbols, min_count, since)
        if not len(left):
            break
        shorter, uses = _replace(seq, left, right, symbols, at)
        # Pairs that others left no use of are no rules.
        used = uses > 0
        number = np.concatenate((np.arange(symbols), symbols + np.cumsum(used) - 1)).astype(np.int32)
        seq, since = number[shorter], symbols
        rules = np.concatenate((rules, np.stack((left[used], right[used]), axis=1)))
        sizes = np.concatenate((sizes, sizes[left[used]] + sizes[right[used]]))
    return base, rules.astype(ID), sizes[base:].astype(ID), seq.astype(ID)


def _expanded_rules(base: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths) by symbol: the ids of all symbols, one after the other."""
    own = [b""] * len(rules)
    plain = np.arange(base, dtype=ID).tobytes()
    width = ID.itemsize
    get = lambda s: plain[s * width : (s + 1) * width] if s < base else own[s - base]
    for k, (a, b) in enumerate(rules.tolist()):
        own[k] = get(a) + get(b)
    lengths = np.concatenate((np.ones(base, np.int64), np.array([len(x) // width for x in own], np.int64)))
    starts = np.cumsum(lengths) - lengths
    return np.frombuffer(plain + b"".join(own), ID), starts, lengths


def _spelled(seq: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    ids, starts, lengths = table
    n = lengths[seq]
    ends = np.cumsum(n)
    return ids[np.repeat(starts[seq] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def decode(base: int, rules: np.ndarray, seq: np.ndarray) -> np.ndarray:
    return _spelled(seq, _expanded_rules(base, rules))


def decode_range(base: int, rules: np.ndarray, expansions: np.ndarray, seq: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop``: symbols before and after are skipped by the lengths
    they expand to, at every level of the grammar."""
    sizes = np.concatenate((np.ones(base, np.int64), expansions.astype(np.int64)))
    ends = np.cumsum(sizes[seq])
    i, j = np.searchsorted(ends, [start, stop - 1], side="right")
    out: list[int] = []
    stack = [(int(s), int(e - sizes[s])) for s, e in zip(seq[i : j + 1][::-1], ends[i : j + 1][::-1])]
    while stack and stop > start:
        symbol, at = stack.pop()
        if at >= stop or at + sizes[symbol] <= start:
            continue
        if symbol < base:
            out.append(symbol)
        else:
            a, b = (int(x) for x in rules[symbol - base])
            stack += [(b, at + int(sizes[a])), (a, at)]
    return np.array(out, ID)


# --- files --------------------------------------------------------------------------


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shards of ``docs`` in ascending order of the id (nulls first, ties by text).

    Null and empty texts have the end id alone. A shard is closed once it has ``shard_tokens``
    ids. ``part`` and ``shard`` give the order.
    """
    path = tokenizer or default_path()
    end = np.array([end_id], ID).tobytes()
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    laid = read.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn = encoder(path).encode
        part, shard = TaskContext.get().partitionId(), 0
        ids, codes, size = [], [], 0
        for batch in batches:
            for some in slices(batch):
                for doc, code in zip(some.column(0).to_pylist(), learn(some.column(1).to_numpy(zero_copy_only=False).tolist())):
                    ids.append(doc)
                    codes.append(code + end)
                    size += len(codes[-1]) // ID.itemsize
                    if size >= shard_tokens:
                        yield row(part, shard, ids, codes)
                        shard, ids, codes, size = shard + 1, [], [], 0
        if ids:
            yield row(part, shard, ids, codes)
        release_unused()

    def row(part: int, shard: int, ids: list, codes: list[bytes]) -> pa.RecordBatch:
        base, rules, expansions, seq = compress(np.frombuffer(b"".join(codes), ID))
        narrow = base + len(rules) <= 1 << 16
        values = {
            "part": part,
            "shard": shard,
            "doc_ids": ids,
            "lengths": [len(x) // ID.itemsize for x in codes],
            "base": base,
            "rules": rules.tobytes(),
            "expansions": expansions.tobytes(),
            "narrow": narrow,
            "sequence": (seq.astype("<u2") if narrow else seq).tobytes(),
        }
        return pa.RecordBatch.from_pylist([values], schema=SHARD)

    return laid.mapInArrow(run, "part int, shard int, doc_ids array<long>, lengths array<int>, base int, rules binary, expansions binary, narrow boolean, sequence binary")


SHARD = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("base", pa.int32()),
        ("rules", pa.binary()),
        ("expansions", pa.binary()),
        ("narrow", pa.bool_()),
        ("sequence", pa.binary()),
    ]
)


def write(shards: DataFrame, path: str) -> None:
    shards.write.option("compression", "zstd").parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """(part, shard, first): the ids before each shard. Parts are as many as the range
    partitions of the writer; their totals are few, and shards are summed within a part."""
    sizes = shards.select("part", "shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("part", "shard", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside"))
    return inside.join(parts, "part").select("part", "shard", (F.col("ahead") + F.col("inside")).alias("first"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files at ``path``; ``ids`` are
    little-endian unsigned 32-bit integers."""
    shards = spark.read.parquet(path)
    placed = shards.join(_starts(shards), ["part", "shard"]).drop("part", "shard", "expansions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                seq = np.frombuffer(r["sequence"], "<u2" if r["narrow"] else ID)
                raw = decode(r["base"], np.frombuffer(r["rules"], ID).reshape(-1, 2), seq).tobytes()
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                content = [raw[a * ID.itemsize : b * ID.itemsize] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + ends - lengths), pa.array(lengths), pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents asked for: only their ranges are decoded, in the
    shards that hold them."""
    wanted = sorted(set(doc_ids))
    shards = spark.read.parquet(path).drop("part", "shard")
    chosen = shards.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in wanted]).cast("array<bigint>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = set(wanted)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                grammar = (r["base"], np.frombuffer(r["rules"], ID).reshape(-1, 2), np.frombuffer(r["expansions"], ID))
                seq = np.frombuffer(r["sequence"], "<u2" if r["narrow"] else ID)
                ends = np.cumsum(np.array(r["lengths"], np.int64)).tolist()
                at = [(d, e - n, e) for d, n, e in zip(r["doc_ids"], r["lengths"], ends) if d in asked]
                content = [decode_range(*grammar, seq, a, b).tobytes() for _, a, b in at]
                columns = [pa.array([d for d, _, _ in at], pa.int64()), pa.array([b - a for _, a, b in at], pa.int64()), pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids binary")
