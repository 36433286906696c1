"""MinHash components against all pairs of sets."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from edge_cases import edge_docs, no_docs  # noqa: F401

from codescope.llm import minhash


def words_of(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split()


def set_of(text, width):
    words = words_of(text)
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def expected(texts, width, num, den):
    """(id, size, least id reachable) by all pairs."""
    sets = {i: set_of(t, width) for i, t in texts.items()}
    least = {i: i for i in texts}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and den * len(x & y) >= num * len(x | y):
                u, v = sorted((find(a), find(b)))
                least[v] = u
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def families(rng, n_families, size, n_words, most_edits):
    """Texts that share much: each family edits its base, some also share a passage with others."""
    shared = [f"s{i}" for i in range(n_words)]
    texts = {}
    for _ in range(n_families):
        base = [f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(5, n_words))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(most_edits)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                words += shared[: rng.randrange(n_words)]
            texts[len(texts) * 3 + 7] = rng.choice([" ", "\n"]).join(words)
    return texts


@pytest.mark.parametrize("width, ratio, tile_rows", [(3, (85, 100), 2048), (5, (8, 10), 16), (1, (9, 10), 3)])
def test_components_equal_all_pairs(spark, width, ratio, tile_rows):
    rng = random.Random(width)
    texts = families(rng, 8, 40, 120, 9) | {1: "one", 2: "ONE", 4: "one two", 5: "", 6: None, 8: "\x0c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert rows(minhash.components(df, width=width, similarity=ratio, tile_rows=tile_rows)) == expected(texts, width, *ratio)


def test_prefix_join_is_exact(spark):
    """All pairs of similar sets of other groups, with keys cut into tiles."""
    rng = random.Random(9)
    sets = [minhash.shingles((t or "").encode(), 2) for t in families(rng, 4, 25, 60, 8).values()]
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, set binary")
    groups = spark.createDataFrame([(i, i % 7) for i in range(len(sets))], "node long, group long")
    rare = minhash.rare_shingles(df, (8, 10))
    wanted = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if i % 7 != j % 7 and minhash.similar(sets[i], sets[j], (8, 10))}
    for tile_rows in (4, 1000):
        found = {(r["src"], r["dst"]) for r in minhash.prefix_pairs(rare, groups, (8, 10), tile_rows).collect()}
        assert wanted <= found and all(i % 7 != j % 7 for i, j in found)
        best = minhash.prefix_pairs(rare, groups, (8, 10), tile_rows, best=True).collect()
        assert {(r["src"], r["dst"]) for r in best} <= found
        # Every set that is similar to one of another group takes some partner.
        assert {i for pair in wanted for i in pair} <= {i for r in best for i in (r["src"], r["dst"])}


def test_unlike_texts_with_a_common_part_are_not_paired(spark):
    """Texts of a mutual similarity of 0.66 meet in nearly every table; no pair of them comes
    out of the prefixes."""
    rng = random.Random(4)
    n = 300
    common = minhash.shingles(" ".join(f"c{i}" for i in range(81)).encode(), 2)
    own = [np.array([rng.getrandbits(64) for _ in range(20)], np.uint64) for _ in range(n)]
    sets = [np.unique(np.concatenate((common, o))) for o in own]
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, set binary")
    groups = df.select("node", F.col("node").alias("group"))
    assert minhash.prefix_pairs(minhash.rare_shingles(df, (8, 10)), groups, (8, 10), 64).count() <= n


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 50, 400, 5000):
        for own in (1, n // 10 + 1):
            both = rng.integers(0, 1 << 63, n, np.uint64)
            x, y = (np.concatenate((both, rng.integers(0, 1 << 63, own, np.uint64))) for _ in range(2))
            a, b = (np.frombuffer(minhash.parity_bits(s, (8, 10)), np.uint64)[None] for s in (x, y))
            few = min(a.shape[1], b.shape[1])
            for words in (few, 1):
                apart = int(np.bitwise_count(minhash.folded(a, words) ^ minhash.folded(b, words)).sum())
                assert apart <= 2 * own and (words == 1 or own > 5 or apart == 2 * own or n > 400)


def test_tables_find_similar_sets():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        both, own = rng.integers(0, 1 << 63, 170, np.uint64), rng.integers(0, 1 << 63, 30, np.uint64)
        x, y = np.concatenate((both, own[:15])), np.concatenate((both, own[15:]))  # similarity 0.85
        a, b = minhash.subkeys(x), minhash.subkeys(y)
        m = minhash.SUBKEYS
        met += (a[:m] == b[:m]).any() and (a[m:] == b[m:]).any()
    assert met >= 298


def test_odd_rows(spark, edge_docs, no_docs):  # noqa: F811
    found = minhash.components(edge_docs.withColumnRenamed("n_chars", "node"), width=3).collect()
    assert len(found) == 9
    of = {}
    for r in found:
        of.setdefault(r["id"], []).append((r["n_shingles"], r["component_id"]))
    assert of[1] == [(9, 1)] * 2 and of[3] == [(0, 3)]
    assert of[2] == [(0, 2)] and of[4] == [(0, 4)] and of[6] == [(1, 6)] and of[5][0][1] == 5
    assert sorted(of[None], key=str) == [(0, None), (9, 1)]
    assert minhash.components(no_docs).count() == 0 and minhash.first_of_groups(no_docs).count() == 0
    kept = minhash.first_of_groups(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0)] * 2 + [(True, i) for i in (1, 1, 2, 3, 4, 5, 6)]


def test_sets_without_a_candidate_leave_the_rounds(spark, monkeypatch):
    """After the first round over the prefixes only sets that met a possible partner are laid out."""
    rng, laid = random.Random(3), []
    pairs = minhash.prefix_pairs

    def watched(rare, groups, *rest, **settings):
        laid.append(groups.count())
        return pairs(rare, groups, *rest, **settings)

    monkeypatch.setattr(minhash, "prefix_pairs", watched)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join([*common, *(f"{k}x{rng.random()}" for _ in range(30))]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, texts[0])], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.components(docs).withColumnRenamed("id", "doc_id").collect()}
    assert found == {i: i for i in range(60)} | {99: 0}
    assert laid[0] > 0 and laid[1:] == [0]
