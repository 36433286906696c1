"""Centroid clustering over subvector dictionaries (operator 11).

Vectors of whole numbers are stored in shards. In a shard every block of ``block`` dimensions
is dictionary-encoded: its distinct subvectors are kept once, and a vector is its codes, so
nothing is lost. A round works out the exact squared distance of each distinct subvector to
each centroid once, and a vector's distances are the sums of what its codes look up. Means are
made from the counts of codes. A shard needs no other, so rounds shuffle only totals: the
driver sees one count and sum per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.llm.shared import small_batches, written

SHARD_VECTORS = 32_768
BATCH_VECTORS = 4_096
SHARDS_AT_ONCE = 8
# Components beyond are taken as the bound, so that distances stay in 64 bits.
BOUND = 1 << 27

Centroids = list[list[int]]


@dataclass(frozen=True)
class Clustering:
    assigned: DataFrame  # (id, cluster, distance), a row per vector
    totals: dict[int, tuple[int, int]]  # per cluster: vectors, inertia
    centroids: Centroids


# --- dictionaries -------------------------------------------------------------------


def whole_vectors(vectors: pa.Array, components: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which are kept, floor(scale * x) of those): vectors with ``components`` finite values."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    keep = pc.fill_null(pc.equal(pc.list_value_length(vectors), components), False).to_numpy(zero_copy_only=False).copy()
    values = vectors.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = values.reshape(-1, components)  # a null is NaN here
    finite = np.isfinite(values).all(axis=1)
    keep[np.flatnonzero(keep)[~finite]] = False
    return keep, np.clip(np.floor(scale * values[finite]), -BOUND, BOUND).astype(np.int64)


def dictionary(numbers: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes by block, distinct subvectors of all blocks, number of them by block)."""
    codes, entries, sizes = [], [], []
    for i in range(0, numbers.shape[1], block):
        distinct, code = np.unique(numbers[:, i : i + block], axis=0, return_inverse=True)
        codes.append(code.reshape(-1))
        entries.append(distinct)
        sizes.append(len(distinct))
    return np.array(codes, np.uint16), np.concatenate(entries).astype(np.int32), np.array(sizes, np.int32)


def decoded(codes: np.ndarray, entries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The vectors that ``dictionary`` encoded."""
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([entries[s + c.astype(np.int64)] for s, c in zip(starts, codes)], axis=1).astype(np.int64)


def nearest(codes: np.ndarray, entries: np.ndarray, sizes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every vector; of equally near centroids the first."""
    block = entries.shape[1]
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    ends = np.cumsum(sizes)
    for b, (start, end) in enumerate(zip(ends - sizes, ends)):
        apart = entries[start:end, None, :].astype(np.int64) - centroids[None, :, b * block : (b + 1) * block]
        total += (apart * apart).sum(axis=2)[codes[b]]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def sums(codes: np.ndarray, entries: np.ndarray, sizes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """The sum of the vectors of each cluster, from how often it holds each code."""
    ends = np.cumsum(sizes)
    parts = []
    for b, (start, end) in enumerate(zip(ends - sizes, ends)):
        n = end - start
        held = np.bincount(cluster * n + codes[b], minlength=k * n).reshape(k, n)
        parts.append(held @ entries[start:end].astype(np.int64))
    return np.concatenate(parts, axis=1)


# --- shards -------------------------------------------------------------------------


def _to_shards(kind: pa.DataType, components: int, scale: int, block: int, shard_vectors: int):
    def shard(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        codes, entries, sizes = dictionary(np.concatenate(rows), block)
        ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([codes.tobytes()], pa.binary()),
                pa.array([entries.tobytes()], pa.binary()),
                pa.array([sizes.tobytes()], pa.binary()),
            ],
            names=["ids", "codes", "entries", "sizes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for batch in batches:
            keep, numbers = whole_vectors(batch.column(1), components, scale)
            here = batch.column(0).filter(pa.array(keep)).cast(kind)
            for i in range(0, len(numbers), shard_vectors):
                part = numbers[i : i + shard_vectors]
                if n + len(part) > shard_vectors:
                    yield shard(ids, rows)
                    ids, rows, n = [], [], 0
                ids.append(here.slice(i, len(part)))
                rows.append(part)
                n += len(part)
        if n:
            yield shard(ids, rows)

    return run


def _opened(row: dict, components: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(row["codes"], np.uint16).reshape(components // block, -1)
    return codes, np.frombuffer(row["entries"], np.int32).reshape(-1, block), np.frombuffer(row["sizes"], np.int32)


def _moments(centroids: Centroids, block: int):
    """One (cluster, n, sums) per cluster that a task's shards hold."""
    k, components = len(centroids), len(centroids[0])
    at = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, components), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                opened = _opened({c: batch.column(c)[i].as_py() for c in ("codes", "entries", "sizes")}, components, block)
                cluster, _ = nearest(*opened, at)
                n += np.bincount(cluster, minlength=k)
                total += sums(*opened, cluster, k)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(held, pa.int32()), "n": n[held], "sums": total[held].tolist()}, schema=_MOMENTS)

    return run


_MOMENTS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _assigned(centroids: Centroids, block: int):
    components, at = len(centroids[0]), np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                opened = _opened({c: batch.column(c)[i].as_py() for c in ("codes", "entries", "sizes")}, components, block)
                cluster, distance = nearest(*opened, at)
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


# --- clustering ---------------------------------------------------------------------


def first_centroids(df: DataFrame, id_col: str, vector: str, k: int, seed: str, components: int, scale: int) -> Centroids:
    """The ``k`` kept vectors with the least sha256 of ``seed:id``; ties by the vector. A null
    id is written as nothing."""
    x = F.col("vector")
    kept = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(
        (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    if not rows:
        return []
    _, numbers = whole_vectors(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), components, scale)
    return numbers.tolist()


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    seed: str = "1",
    components: int = 64,
    scale: int = 64,
    block: int = 2,
    shard_vectors: int = SHARD_VECTORS,
) -> Clustering:
    """Lloyd's rounds over whole-numbered vectors, exact in every step.

    Vectors with another number of components than ``components``, or a null or non-finite
    one, are left out (null and empty lists, too). A component becomes floor(scale * x), at
    most 2**27 in size. Every row is a vector: repeated rows and ids count as often as they
    occur, rows without an id are assigned like others. With fewer than ``k`` vectors there are
    as many centroids as vectors; without any, none and no rows. Ties of distance go to the
    smaller number; a cluster that becomes empty keeps its centroid. Other columns are not read.
    """
    if components % block or shard_vectors > 1 << 16:
        raise ValueError("blocks must divide the components, and codes have 16 bits")
    centroids = first_centroids(df, id_col, vector, k, seed, components, scale)
    read = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    kind = read.schema["id"].dataType
    if not centroids:
        nothing = read.where("false").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(nothing, {}, [])
    arrow = pa.int64() if kind.simpleString() == "bigint" else _arrow_type(df, id_col)
    with small_batches(df.sparkSession, BATCH_VECTORS):
        to_shards = _to_shards(arrow, components, scale, block, shard_vectors)
        shards = written(read.mapInArrow(to_shards, f"ids array<{kind.simpleString()}>, codes binary, entries binary, sizes binary"), "vector-shards")
    with small_batches(df.sparkSession, SHARDS_AT_ONCE):
        for _ in range(rounds):
            moments = shards.select("codes", "entries", "sizes").mapInArrow(_moments(centroids, block), "cluster int, n long, sums array<long>")
            each = moments.select("cluster", "n", F.posexplode("sums").alias("at", "sum"))
            means = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
            for r in means.collect():  # a number per centroid and component
                centroids[r["cluster"]][r["at"]] = int(r["sum"]) // r["n"]
        assigned = written(shards.mapInArrow(_assigned(centroids, block), f"id {kind.simpleString()}, cluster int, distance long"), "assigned")
    totals = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"))
    return Clustering(assigned, {r["cluster"]: (r["n"], int(r["inertia"])) for r in totals.collect()}, centroids)


def _arrow_type(df: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[id_col].dataType)


def described(found: Clustering, id_name: str = "vec_id") -> DataFrame:
    """``assigned`` with its cluster's inertia, that of all, and the digest of the centroid."""
    spark = found.assigned.sparkSession
    inertia = sum(i for _, i in found.totals.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()
    top = (1 << 63) - 1
    rows = [(c, min(i, top), min(inertia, top), digest(c)) for c, (_, i) in sorted(found.totals.items())]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most one row per centroid.
    return found.assigned.join(F.broadcast(clusters), "cluster").select(
        F.col("id").alias(id_name), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
