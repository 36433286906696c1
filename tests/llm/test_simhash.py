"""SimHash groups against all pairs, fingerprints against their definition."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest import rows
from pyspark.sql import functions as F

from edge_cases import edge_docs, no_docs  # noqa: F401

from codescope.llm import simhash


def fingerprint(text, width=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(marks, distance):
    least = {m: m for m in marks}

    def find(m):
        while least[m] != m:
            m = least[m]
        return m

    for a in marks:
        for b in marks:
            if a < b and (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {m: find(m) for m in marks}


def test_edge_rows(edge_docs):
    found = simhash.near_duplicates(edge_docs).collect()
    assert len(found) == 9
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect() if r["doc_id"]}
    for i, text in texts.items():
        assert {f for f, _ in by_id[i]} == {f"{fingerprint(text):016x}"}
    assert by_id[1] == [by_id[1][0]] * 2 and by_id[1][0][1] == 1
    assert {c for _, c in by_id[2] + by_id[3] + by_id[4]} == {2}  # no words: fingerprint zero, linked
    assert sorted(c for _, c in by_id[None]) == [1, 2]


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.first_of_groups(no_docs).count() == 0


@pytest.mark.parametrize("tile_rows", [5, 2048])
def test_groups_equal_all_pairs(spark, tile_rows):
    """Dense families of fingerprints, whose keys need many small tiles."""
    random.seed(tile_rows)
    marks = {0, (1 << 64) - 1}
    for _ in range(12):
        base = random.getrandbits(64)
        for _ in range(40):
            marks.add(base ^ sum(1 << b for b in set(random.choices(range(64), k=random.randint(0, 6)))))
    signed = {m - (1 << 64) if m >> 63 else m: m for m in marks}
    table = spark.createDataFrame([(m,) for m in signed], "mark long")
    links = [(signed[a], signed[b]) for a, b in rows(simhash.links(table, tile_rows=tile_rows))]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    expected = groups(marks, 3)
    joined = {m: m for m in marks}

    def find(m):
        while joined[m] != m:
            m = joined[m]
        return m

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        joined[y] = x
    assert {m: find(m) for m in marks} == expected


def test_block_masks_catch_every_error():
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(3, 6)]
    random.seed(1)
    for _ in range(2000):
        errors = sum(1 << b for b in random.sample(range(64), 3))
        assert any(errors & m == 0 for m in masks)


def test_first_of_groups_keeps_columns_and_rows_without_id(edge_docs):
    kept = simhash.first_of_groups(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (False, 0), (True, 1), (True, 1), (True, 2), (True, 5), (True, 6)]


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)).encode()
    whole = simhash._fingerprints([text], 3)
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", 7)
    assert simhash._fingerprints([text], 3) == whole == [fingerprint(text.decode())]
    assert np.array(whole, np.uint64)[0] == whole[0]


def test_hexed(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "m long").select(simhash.hexed("m").alias("h"), F.lit(1))
    assert [r["h"] for r in df.collect()] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]


def test_hashes_of_one_text_at_a_time_are_held(monkeypatch):
    steps, hashes, ones = [], simhash._hashes, simhash._ones
    monkeypatch.setattr(simhash, "_hashes", lambda *a: steps.append("hashes") or hashes(*a))
    monkeypatch.setattr(simhash, "_ones", lambda *a: steps.append("ones") or ones(*a))
    simhash._fingerprints([b"a b c d", None, b"e f g"], 3)
    assert steps == ["hashes", "ones"] * 3
