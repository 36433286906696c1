"""Base statistics against a direct count; the robust fit against numpy and planted outliers."""

import random
import re

import numpy as np
from edge_cases import edge_docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from codescope.llm import quality


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_equal_a_direct_count(spark, edge_docs):
    random.seed(5)
    texts = ["", " a b ", "\x0b\x0ca\n\na\r\na", "é ü 😀 # & <", None]
    for _ in range(300):
        texts.append("".join(random.choice(["a", "b", "é", "#", " ", " ", "\n", "\t", "ab "]) for _ in range(random.randint(0, 120))))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (table, edge_docs):
        for r in quality.with_statistics(docs).select("row.doc_id", "row.text", "stats.*").collect():
            assert tuple(r[c] for c in COUNTS) == statistics(r["text"]), r["text"]


def test_edge_rows_and_columns(edge_docs, no_docs):
    judged = quality.assess(edge_docs)
    assert judged.select("row.*").columns == edge_docs.columns
    found = {(r["row"]["doc_id"], r["base_failed"], r["kept"], r["d2"]) for r in judged.collect()}
    # Too few rows for any estimate: the base rules alone decide.
    assert found == {(1, False, True, None), (2, True, False, None), (3, True, False, None), (4, True, False, None), (5, True, False, None), (6, True, False, None), (None, False, True, None), (None, True, False, None)}
    assert judged.count() == 9 and quality.assess(no_docs).count() == 0


def fixture(spark, n=900):
    """Clean texts of two languages, one in ten with symbols glued to its words."""
    random.seed(11)
    words = ["".join(random.choice("aeioubdfgklmnprst") for _ in range(random.randint(2, 9))) for _ in range(800)]
    out = []
    for i in range(n):
        text = [random.choice(words) for _ in range(int(random.lognormvariate(5, 0.8)) + 10)]
        if i % 10 == 0:
            text = [w + "%%%" for w in text]
        out.append((i, " ".join(text), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 40}"))
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string")


def test_planted_outliers_go_and_clean_texts_stay(spark):
    judged = quality.assess(fixture(spark), min_rows=60).select("row.doc_id", "kept", "base_failed").collect()
    assert len(judged) == 900 and not any(r["base_failed"] for r in judged)
    assert {r["doc_id"] for r in judged if not r["kept"]} == set(range(0, 900, 10))


def brute_mcd(x, floors, core, steps):
    """The same concentration steps with numpy."""
    centre = np.median(np.round(x, 2), axis=0)
    spread = np.maximum(1.4826 * np.median(np.round(np.abs(x - centre), 2), axis=0), floors)
    inverse = np.diag(1 / spread**2)
    for _ in range(steps):
        d2 = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        step = np.round(np.log1p(d2), 2)
        near = x[step <= np.percentile(step, 100 * core) + 1e-12]
        centre = near.mean(axis=0)
        inverse = np.linalg.inv(np.cov(near.T, bias=True) + np.diag(np.array(floors) ** 2))
    return centre, inverse


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.multivariate_normal(np.zeros(5), np.diag([1, 0.4, 0.2, 0.3, 0.5]) + 0.1, 600)
    x[:80] += 9
    table = spark.createDataFrame([("en", "s", *map(float, v)) for v in x], "lang string, source string, " + ", ".join(f"x{i} double" for i in range(5)))
    _, model = quality.fit(table, min_rows=50, max_steps=3, settled=-1e9)
    found = model.first()
    centre, inverse = brute_mcd(x, list(quality.FLOORS.values()), 0.75, 3)
    assert np.allclose([found[f"m_{i}"] for i in range(5)], centre, atol=1e-6)
    factor = np.array([[found[f"f_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose(np.linalg.inv(factor @ factor.T), inverse, rtol=1e-5, atol=1e-6)


def test_small_groups_are_pooled(spark):
    sizes = spark.createDataFrame([("en", "a", 500), ("en", "b", 30), ("en", None, 80), ("de", "a", 10), (None, None, 5)], "lang string, source string, n long")
    found = {(r["lang"], r["source"]): r["group"] for r in quality._level(sizes, 100).collect()}
    assert found["en", "b"] == found["en", None] != found["en", "a"]
    assert found["de", "a"] == found[None, None] and "rest" in found["de", "a"]


def test_no_python_in_the_plan(spark):
    plan = quality.assess(fixture(spark, 300), min_rows=60).select(F.col("kept"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chi_square():
    assert abs(quality.chi_square(5, 0.5) - 4.351) < 0.02 and abs(quality.chi_square(5, 0.99) - 15.086) < 0.05
