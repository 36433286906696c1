"""The queries and the pipeline over the smallest tables, against brute force."""

import zlib

import duckdb
import numpy as np
import pytest
from test_minhash import expected as similar_groups
from test_quality import statistics
from test_simhash import fingerprint, groups
from test_text import least_edits
from edge_cases import edge_docs, no_docs  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codescope.llm import decontam, encoding
from codescope.llm.queries import ORACLES, QUERIES
from codescope.llm.shared import written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_simhash_query(spark, texts):
    marks = {i: fingerprint(t) for i, t in texts.items()}
    of = groups(set(marks.values()), 3)
    least = {}
    for i, m in sorted(marks.items(), reverse=True):
        least[of[m]] = i
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash"](spark, SF_DIR).collect()}
    assert found == {i: (f"{m:016x}", least[of[m]]) for i, m in marks.items()}


def test_quality_query(spark, texts):
    for r in QUERIES["op2_quality"](spark, SF_DIR).collect():
        n, chars, symbols, dup, repeats = statistics(texts[r["doc_id"]])
        failed = n < 10 or 100 * repeats > 20 * n
        assert tuple(r)[:7] == (r["doc_id"], n, chars, symbols, dup, repeats, failed)
        assert not (failed and r["kept"])


def test_warc_query_equals_sql(spark, duck):
    found = QUERIES["op3_warc"](spark, SF_DIR)
    columns = sorted(found.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op3_warc']})").fetchall()
    key = lambda row: [(v is not None, str(v)) for v in row]
    assert sorted((tuple(r) for r in found.select(columns).collect()), key=key) == sorted(expected, key=key)


def test_toxicity_query(spark, texts):
    rows = QUERIES["op5_toxicity"](spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_token_file_and_packing_queries(spark, texts):
    tokenizer = Tokenizer.from_file(encoding.default_path())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], encoding.ID) for i, t in texts.items()}
    at, starts = 0, {}
    for i in sorted(ids):
        starts[i], at = at, at + len(ids[i])
    found = {r["doc_id"]: tuple(r[c] for c in ("start", "n_tokens", "ids_crc32")) for r in QUERIES["op7_tokenfile"](spark, SF_DIR).collect()}
    assert found == {i: (starts[i], len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}
    sequences, pieces = {}, {}
    for r in QUERIES["op9_packing"](spark, SF_DIR).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    gapless = lambda parts: all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
    for parts in sequences.values():
        size = sum(n for _, n in parts)
        assert gapless(sorted(parts)) and size <= 1024 and (size == 1024 or size & (size - 1) == 0)
    assert all(gapless(sorted(parts)) and sum(n for _, n in parts) == len(ids[i]) for i, parts in pieces.items())


@pytest.mark.parametrize("name", ["op4_chat", "op6_decontamination", "op8_token_counts", "op10_html"])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def contaminated(text, items):
    plain = decontam.normalized(text)[0]
    for item in items:
        item = decontam.normalized(item)[0].strip()
        errors = int(len(item) * decontam.ERROR_RATE)
        if item in plain or (any(p in plain for _, p in decontam.pieces(item, errors)) and least_edits(item, plain) <= errors):
            return True
    return False


def test_stages(spark, duck, texts):
    """Each stage on what the one before kept; the brute-force version of its decision."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    good, mild, single, clean = kept[1:]
    for i, t in texts.items():
        n, _, symbols, _, repeats = statistics(t)
        if n < 10 or 100 * repeats > 20 * n:
            assert i not in good
        elif symbols == 0 and repeats == 0:  # outliers are planted in test_quality.py
            assert i in good
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op5_toxicity"](spark, SF_DIR).select("doc_id", "score").collect()}
    assert sum((i in mild) != (scores[i] < 0.3) for i in good) <= 0.02 * len(good)
    marks = {i: fingerprint(texts[i], 5) for i in mild}
    of = groups(set(marks.values()), 3)
    least = {}
    for i in sorted(mild, reverse=True):
        least[of[marks[i]]] = i
    first = {i: texts[i] for i in least.values()}
    assert single == {i for i, _, component in similar_groups(first, 5, 8, 10) if i == component}
    items = [t for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    assert clean == {i for i in single if not contaminated(texts[i], items)}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == clean


def test_stages_on_odd_rows(spark, edge_docs, no_docs):  # noqa: F811
    """Nulls, blanks, a long text, repeated rows and clashing columns pass through every stage."""
    docs = edge_docs.withColumns({"gone": F.lit("!"), "component_id": F.lit(0), "matches": F.lit(0)})
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, SF_DIR), f"odd-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    # Kept: the two equal rows of document 1 and that without an id.
    assert sizes == [3, 3, 3, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF_DIR).count() == 0


def test_run_applies_the_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "decontamination", "packing"]
