"""Periodic runs against their definition, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from edge_cases import edge_docs, no_docs  # noqa: F401

from codescope.llm import periodic
from codescope.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def runs_of(words, min_words=24, repeats=3):
    """(start, period, length) by trying every period."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w, found = np.array([ids[x] for x in words]), {}
    for q in range(1, len(w) // repeats + 1):
        same = np.concatenate(([0], (w[:-q] == w[q:]).astype(int), [0]))
        change = np.diff(same)
        for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            if b - a + q >= max(min_words, repeats * q):
                found.setdefault((a, b - a + q), q)  # the smallest period comes first
    return sorted((a, q, n) for (a, n), q in found.items())


def collapsed(words, runs):
    gone = {i for a, q, n in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repetitive(rng, n):
    """Words with runs of all kinds: nested, neighbouring, broken by one word, multiples of periods."""
    words = []
    while len(words) < n:
        kind = rng.randrange(6)
        if kind == 0:
            words += rng.choices("abcdefgh", k=rng.randrange(1, 40))
        else:
            unit = rng.choices("abcdefgh"[: rng.randrange(1, 9)], k=rng.randrange(1, 70))
            if kind == 1:
                unit = unit[:3] * rng.randrange(1, 9) + unit[:2]
            words += (unit * rng.randrange(1, 12))[: rng.randrange(10, 600)]
            if kind == 2:
                words[-rng.randrange(1, len(words) + 1)] = "x"
    return words[:n]


def found_by(df, **settings):
    found = {}
    for r in periodic.with_runs(df, **settings).collect():
        found.setdefault(r["id"], []).append(([tuple(x) for x in r["runs"]], r["n_words"], r["collapsed"]))
    return found


def test_runs_equal_definition(spark):
    rng = random.Random(13)
    texts = [repetitive(rng, rng.randrange(1, 900)) for _ in range(150)]
    texts += [["a"] * n for n in (1, 23, 24, 25, 700)] + [list("ab" * 12), list("ab" * 11 + "a"), list("abcdefgh" * 3), list("abcdefghi" * 3)[:-1]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = found_by(df)
    for i, words in enumerate(texts):
        assert found[i] == [(runs_of(words), len(words), collapsed(words, runs_of(words)))], i


@pytest.mark.parametrize("min_words, repeats", [(3, 3), (10, 4), (60, 3)])
def test_other_thresholds(spark, min_words, repeats):
    rng = random.Random(min_words)
    texts = [repetitive(rng, 300) for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = found_by(df, min_words=min_words, repeats=repeats)
    for i, words in enumerate(texts):
        assert found[i][0][0] == runs_of(words, min_words, repeats)


def test_groups_of_texts_and_small_tiles(spark, monkeypatch):
    """Runs far longer than a tile, and runs at the borders of texts that are taken together."""
    rng = random.Random(5)
    unit = [f"u{i}" for i in range(37)]
    texts = [unit * 200, ["a"] * 5000, repetitive(rng, 4000), unit * 3, unit * 3, (["x"] * 7 + ["y"]) * 500]
    number = {w: i for i, w in enumerate({w for t in texts for w in t})}
    words, ends = [], []
    for k, t in enumerate(texts):
        words += [number[w] for w in t] + [len(number) + k]
        ends.append(len(words) - 1)
    words, ends = np.array(words), np.array(ends)
    monkeypatch.setattr(periodic, "TILE_ANCHORS", 2)
    pieces = {}
    for d, scale, start, end, anchors in periodic.tiles(words, ends, 24, 3):
        assert end - start <= 7 * scale
        for q, a, b in periodic.solve(words[start:end].tolist(), scale, (anchors - start).tolist(), scale == 8):
            low = ends[d] - len(texts[d])
            pieces.setdefault((d, q), []).append((a + start - low, b + start - low))
    rows_ = [(d, b"", q, int(a), int(b)) for (d, q), spans in pieces.items() for a, b in spans]
    df = spark.createDataFrame(rows_, "id long, key binary, period long, start long, end long")
    found = sorted((r["id"], r["start"], r["period"], r["length"]) for r in periodic.stitch(df, 24, 3).collect())
    assert found == sorted((d, a, q, n) for d, t in enumerate(texts) for a, q, n in runs_of(t))


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = rng.choices([1, 2], k=rng.randrange(1, 30))
        z = periodic.z_function(s, len(s))
        assert z[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


def test_odd_rows(spark, edge_docs, no_docs):  # noqa: F811
    long_run = "na " * 5000
    more = spark.createDataFrame([(7, long_run), (7, "a " * 30), (None, long_run), (None, long_run), (8, "\x0b\x0c".join(["ä", "Ä"] * 20))], "doc_id long, text string")
    docs = edge_docs.unionByName(more, allowMissingColumns=True).withColumns({"words": F.lit(0), "tile": F.lit(1), "runs": F.lit(2)})
    wanted = {}
    for r in docs.select("doc_id", "text").collect():
        words = split(r["text"])
        wanted.setdefault(r["doc_id"], []).append((runs_of(words), len(words), collapsed(words, runs_of(words))))
    found = found_by(docs)
    assert found.keys() == wanted.keys()
    for i, each in wanted.items():
        assert sorted(found[i]) == sorted(each)
    assert wanted[7][0][0] == [(0, 1, 5000)] and found[2] == [([], 0, "")]
    assert periodic.with_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic.with_runs(no_docs, repeats=2)


def test_query_equals_definition(spark):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    wanted = []
    for i, text in texts.items():
        words = split(text)
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = runs_of(words)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if runs else None
        top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        lines = "".join(f"{a},{n},{q}\n" for a, q, n in runs)
        wanted.append((i, len(runs), *top, digest(lines), digest(collapsed(words, runs))))
    found = QUERIES["op13_periodic_runs"](spark, SF_DIR)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows(found, *columns) == sorted(wanted)
    assert sum(w[1] for w in wanted) > 15
