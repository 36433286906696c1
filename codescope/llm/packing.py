"""Cost-balanced packing (operator 9).

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention within it does.
Documents go in descending order to the cheapest sequence that has room for the whole; where
none has, to the cheapest with any room, cut there. The sequences of a group hold exactly its
tokens: full ones, and the rest in sequences whose lengths are powers of two, so that nothing
is padded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.llm.encoding import ID, default_path, encoder, slices
from codescope.llm.shared import release_unused

CAPACITY = 1024
GROUP_TOKENS = 1 << 20
TEXTS_AT_ONCE = 512


def sequence_sizes(tokens: int, capacity: int) -> list[int]:
    """Full sequences, then the powers of two that make up the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths.

    Sequences with equal room are kept in a heap by cost; ``top`` has the least cost by room.
    Equal costs: the sequence with most room, then the first.
    """
    sizes = sequence_sizes(sum(lengths), capacity)
    filled, heaps, top = [0] * len(sizes), [[] for _ in range(capacity + 1)], np.full(capacity + 1, np.inf)
    for s, size in enumerate(sizes):
        heaps[size].append((0.0, s))
        top[size] = 0.0
    pieces = []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[doc]
        while left:
            least = min(left, capacity)
            room = capacity - int(np.argmin(top[least:][::-1]))
            if top[room] == np.inf:
                room = capacity - int(np.argmin(top[1:][::-1]))
            cost, s = heapq.heappop(heaps[room])
            top[room] = heaps[room][0][0] if heaps[room] else np.inf
            n = min(left, room)
            pieces.append((doc, start, n, s, filled[s]))
            filled[s] += n
            start, left, room, cost = start + n, left - n, room - n, cost + linear * n + quadratic * n * n
            if room:
                heapq.heappush(heaps[room], (cost, s))
                top[room] = heaps[room][0][0]
    return pieces


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    tokenizer: str | None = None,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: the id column, and ``SCHEMA`` with the piece's ids.

    Documents are encoded and packed where they are read, in groups of about ``group_tokens``
    tokens (a longer document is a group), so no row is moved. Null and empty texts have the end
    id alone. Null and repeated ids are packed like others. Columns but the two are not read.
    """
    path = tokenizer or default_path()
    end = np.array([end_id], ID).tobytes()
    read = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        base = TaskContext.get().partitionId() << 32
        ids, group, size = [], [], 0
        for batch in batches:
            for some in slices(batch, TEXTS_AT_ONCE):
                for doc, code in zip(some.column(0).to_pylist(), encode(some.column(1).to_numpy(zero_copy_only=False).tolist())):
                    ids.append(doc)
                    group.append(code + end)
                    size += len(group[-1]) // ID.itemsize
                    if size >= group_tokens:
                        yield from packed(ids, group, base)
                        base += len(sequence_sizes(size, capacity))
                        ids, group, size = [], [], 0
        if group:
            yield from packed(ids, group, base)
        release_unused()

    def packed(ids: list, group: list[bytes], base: int) -> Iterator[pa.RecordBatch]:
        lengths = [len(x) // ID.itemsize for x in group]
        pieces = assign(lengths, capacity)
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*some))
            content = [group[d][a * ID.itemsize : (a + n) * ID.itemsize] for d, a, n, _, _ in some]
            columns = [
                pa.array([ids[d] for d in doc.tolist()], id_type),
                pa.array(start),
                pa.array(length),
                pa.array(content, pa.binary()),
                pa.array(np.array(lengths, np.int64)[doc]),
                pa.array(sequence + base),
                pa.array(offset),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(read.schema[0].dataType)
    schema = read.select(F.col(f"`{id_col}`")).schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split(" "))
    names = schema.names
    return read.mapInArrow(run, schema)
