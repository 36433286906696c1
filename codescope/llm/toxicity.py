"""Toxicity by nearest labelled examples (operator 5).

Texts are TF-IDF vectors over the words and beginnings of words that the labels single out. A text's nearest labelled
examples by cosine are found exactly, through an inverted index in blocks: the blocks' greatest
weights bound what an example in them can score, and blocks that cannot reach the best k are
not opened. The neighbours vote by distance, and the votes are calibrated on the examples,
each left out of its own vote.

Fixed bounds: ``MAX_EXAMPLES`` labelled rows are examples (half of them of either label, the
first by a hash of the id), ``MAX_TERMS`` words. Documents counted for the inverse document
frequencies are all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.llm.shared import written

MAX_EXAMPLES = 8_000
MAX_TERMS = 2_000
BLOCK = 128
NEIGHBOURS = 25
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
LEAST_RATIO = 8


def term_counts(text: str | None, chosen: dict[str, int] | None = None) -> Counter:
    """How often each term occurs: words, and the beginnings of longer words marked ``*``, so
    that inflections count together. With ``chosen``, the numbers of those terms only."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower()) if text else ()).items():
        for term in (word, *[word[:k] + "*" for k in STEMS if len(word) > k]):
            if chosen is None:
                found[term] += n
            elif term in chosen:
                found[chosen[term]] += n
    return found


# --- what is learned ----------------------------------------------------------------


def sample_labels(labels: DataFrame, id_col: str, label: str, max_examples: int = MAX_EXAMPLES) -> tuple[DataFrame, dict[int, float]]:
    """(id, label): the examples, and for each label how many labelled rows one stands for."""
    clean = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label}`") > 0).cast("int").alias("label")).dropna()
    counts = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    half = max_examples // 2
    parts = [clean.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(half) for y in (0, 1)]
    weights = {y: max(1.0, counts.get(y, 0) / half) for y in (0, 1)}
    return written(parts[0].unionAll(parts[1]), "examples"), weights


def choose_terms(examples: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """The words that toxic examples use more often than chance allows, most telling first.

    ``examples`` has text and label. A word's log-likelihood ratio must reach one and a half times the
    logarithm of the number of words tried.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(term_counts(text))
                yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.string()), "label": pa.array([label] * len(found), pa.int32())})

    totals = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    used = examples.select("text", "label").mapInArrow(distinct, "term string, label int")
    used = written(used.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")), "terms")
    tried = max(2, used.count())
    part = lambda count, share: F.when(count > 0, count * F.log(count / share)).otherwise(0.0)
    a, b, share = F.col("a"), F.col("b"), n1 / (n1 + n0)
    total = a + b
    ratio = 2 * (part(a, total * share) + part(b, total * (1 - share)))
    telling = used.where(a * n0 >= LEAST_RATIO * (b + 0.5) * n1).withColumn("g", ratio).where(F.col("g") >= 1.5 * math.log(tried))
    return [r["term"] for r in telling.orderBy(F.desc("g"), "term").limit(max_terms).collect()]


def counted(text: Column, terms: list[str]) -> Column:
    """struct(terms, counts): the numbers of the chosen terms in a text, ascending, and how often."""
    number = {t: i for i, t in enumerate(terms)}

    @F.pandas_udf("terms array<int>, counts array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = [sorted(term_counts(t, number).items()) for t in texts]
        return pd.DataFrame({"terms": [[t for t, _ in r] for r in rows], "counts": [[c for _, c in r] for r in rows]})

    return count(text)


def _weights(terms, counts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.asarray(terms, np.int64)
    w = (1 + np.log(np.asarray(counts, float))) * idf[terms]
    length = math.sqrt(float(w @ w))
    return terms, w / length if length else w


@dataclass
class Index:
    """Examples in blocks; per term, the blocks it occurs in with its greatest weight there, and
    its postings (place in the block, weight) block by block."""

    ids: list
    labels: np.ndarray
    by_term: dict = field(default_factory=dict)
    n_blocks: int = 0
    block: int = BLOCK

    @classmethod
    def build(cls, rows: list[tuple], block: int = BLOCK) -> Index:
        """``rows``: (id, label, terms, weights). Examples alike in their heaviest terms share
        blocks, which keeps the bounds tight."""
        rows = sorted(rows, key=lambda r: ([int(t) for t in np.asarray(r[2])[np.argsort(-r[3], kind="stable")][:3]], r[0]))
        index = cls([r[0] for r in rows], np.array([r[1] for r in rows], float), {}, -(-len(rows) // block), block)
        postings: dict[int, list] = {}
        for n, (_, _, terms, weights) in enumerate(rows):
            for t, w in zip(terms.tolist(), weights.tolist()):
                postings.setdefault(t, []).append((n, w))
        for t, listed in postings.items():
            at = np.array([n for n, _ in listed])
            w = np.array([x for _, x in listed])
            blocks, starts = np.unique(at // block, return_index=True)
            index.by_term[t] = (blocks, np.maximum.reduceat(w, starts), np.append(starts, len(at)), at % block, w)
        return index

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the ``k`` nearest with a common term, nearest first, ties
        by number; ``skip`` is left out."""
        bound = np.zeros(self.n_blocks)
        query = [(self.by_term[t], q) for t, q in zip(terms.tolist(), weights.tolist()) if t in self.by_term]
        for (blocks, most, *_), q in query:
            bound[blocks] += q * most
        best_n, best_s = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best_s) == k and bound[b] < best_s[-1] - 1e-9):
                break
            scores = np.zeros(self.block)
            for (blocks, _, starts, places, w), q in query:
                i = int(np.searchsorted(blocks, b))
                if i < len(blocks) and blocks[i] == b:
                    scores[places[starts[i] : starts[i + 1]]] += q * w[starts[i] : starts[i + 1]]
            found = np.flatnonzero(scores > 0)
            numbers, values = found + b * self.block, np.round(scores[found], 9)
            if skip >= 0:
                values, numbers = values[numbers != skip], numbers[numbers != skip]
            best_n, best_s = np.concatenate((best_n, numbers)), np.concatenate((best_s, values))
            order = np.lexsort((best_n, -best_s))[:k]
            best_n, best_s = best_n[order], best_s[order]
        return best_n, best_s


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    index: Index
    class_weights: dict[int, float]
    base: float
    silent: float
    k: int = NEIGHBOURS
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        """The weighted share of toxic neighbours; the base rate counts as one far neighbour."""
        y = self.index.labels[numbers]
        near = 1 / (1.1 - cosines)
        w = near * np.where(y > 0, self.class_weights[1], self.class_weights[0])
        return float((w @ y + self.base) / (w.sum() + 1)) if len(y) else self.silent

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps)) if self.steps is not None else vote

    def score(self, terms, counts) -> tuple[float, list[tuple]]:
        """(score, evidence): evidence lists (id, label, cosine) of the nearest."""
        if len(terms) == 0:
            return self.silent, []
        numbers, cosines = self.index.nearest(*_weights(terms, counts, self.idf), self.k)
        found = self.calibrated(self.vote(numbers, cosines)) if len(numbers) else self.silent
        return found, [(self.index.ids[n], int(self.index.labels[n]), float(c)) for n, c in zip(numbers[:5], cosines[:5])]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step curve nearest to ``y``: neighbours out of order are pooled. One example
    more of either label keeps the ends off 0 and 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order.tolist():
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    total = np.array(pools)
    return total[:, 0] / total[:, 2], (total[:, 1] + 0.5) / (total[:, 2] + 1)


def fit_index(rows: list[tuple], terms: list[str], idf: np.ndarray, class_weights: dict[int, float], k: int = NEIGHBOURS) -> Model:
    """``rows``: (id, label, terms, counts) of the examples; those without terms set the score of
    texts without any."""
    weighted = lambda some: sum(class_weights[r[1]] for r in some)
    rate = lambda some: (weighted([r for r in some if r[1]]) + 0.5) / (weighted(some) + 1)
    with_terms = [(r[0], r[1], *_weights(r[2], r[3], idf)) for r in rows if len(r[2])]
    silent = [r for r in rows if not len(r[2])]
    model = Model(terms, idf, Index.build(with_terms), class_weights, rate(rows), rate(silent or rows), k)
    number = {i: n for n, i in enumerate(model.index.ids)}
    votes = [(model.vote(*model.index.nearest(t, w, k, number[i])), y) for i, y, t, w in with_terms]
    if votes:
        x, y = np.array(votes, float).T
        model.steps = isotonic(x, y, np.where(y > 0, class_weights[1], class_weights[0]))
    return model


# --- over tables --------------------------------------------------------------------

EVIDENCE = "score double, evidence array<struct<id: string, label: int, cosine: double>>"


def assess(
    docs: DataFrame,
    labels: DataFrame,
    back: list[str] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    labelled_docs: DataFrame | None = None,
    max_examples: int = MAX_EXAMPLES,
) -> DataFrame:
    """(row, score, evidence), one row per row of ``docs``.

    ``labels`` has the id and the label (over 0: toxic) of the rows to learn from; their texts
    are in ``labelled_docs``, ``docs`` itself if not given. ``row`` has the columns ``back`` (all
    if not given). Null and empty texts, and texts without a telling term, get the share of
    toxic rows among the examples like them. Labels that are null, or of no document, teach
    nothing; without examples of both labels every score is the share of toxic examples.
    """
    names = docs.columns if back is None else back
    examples, class_weights = sample_labels(labels, id_col, label, max_examples)
    source = docs if labelled_docs is None else labelled_docs
    # At most ``max_examples`` ids: a few kilobytes.
    taught = source.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(examples), "id")
    taught = written(taught.groupBy("id", "label").agg(F.min("text").alias("text")), "taught")
    terms = choose_terms(taught)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    measured = written(docs.select(row, counted(F.col(f"`{text}`"), terms).alias("found")), "term-counts")
    seen = measured.agg(F.count("*").alias("n")).first()["n"]
    spread = measured.select(F.explode("found.terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    idf = np.full(len(terms), math.log(1 + seen))
    for r in spread:
        idf[r["term"]] = math.log(1 + seen / r["n"])
    rows = taught.select("id", "label", counted(F.col("text"), terms).alias("found")).select("id", "label", "found.*").collect()
    model = fit_index([tuple(r) for r in rows], terms, idf, class_weights)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(EVIDENCE)
    def scored(terms_of: pd.Series, counts_of: pd.Series) -> pd.DataFrame:
        known: dict = {}
        out = []
        for t, c in zip(terms_of, counts_of):
            key = (tuple(t), tuple(c))
            if key not in known:
                known[key] = shared.value.score(*key)
            out.append(known[key])
        evidence = [[{"id": str(i), "label": y, "cosine": s} for i, y, s in e] for _, e in out]
        return pd.DataFrame({"score": [s for s, _ in out], "evidence": evidence})

    judged = measured.select("row", scored("found.terms", "found.counts").alias("judged"))
    return judged.select("row", "judged.score", "judged.evidence")
