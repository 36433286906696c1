"""A corpus pipeline over ``documents``: every stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from codescope.llm import decontam, minhash, packing, quality, simhash, toxicity
from codescope.llm.queries import HELD_OUT, TOXIC_FROM
from codescope.llm.shared import table, written
from codescope.session import remove_scratch, scratch_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []


def stage(fn: Stage) -> Stage:
    """A stage that first deletes the scratch tables of the stage before. Its result must be
    written before the next stage is called, as ``run`` does: then nothing reads them any more,
    and the disk in use is that of one stage."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_scratch(spark, _LEFT)
        before = set(scratch_paths())
        result = fn(spark, docs, sf_dir)
        _LEFT[:] = [p for p in scratch_paths() if p not in before]
        return result

    return run_stage


# Of all stages: rows with null, empty, blank or very long texts, repeated rows, rows without an
# id, and empty tables are allowed, and columns of any other name are kept as they are.


@stage
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source. Texts
    without ten words (null, too) fail; equal rows share one verdict."""
    return quality.assess(docs).where("kept").select("row.*").select(*docs.columns)


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxic threshold. The labelled examples are those of the
    whole table, whether or not earlier stages kept them; held-out labels stay unused. Texts
    without words have the score of a text without neighbours."""
    labels = table(spark, sf_dir, "labels").where(f"NOT {HELD_OUT}")
    scored = toxicity.assess(docs, labels, labelled_docs=table(spark, sf_dir, "documents"))
    return scored.where(f"score < {TOXIC_FROM}").select("row.*")


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    SimHash fingerprints of five-word shingles within three bits come first. They hold few of
    the pairs of similarity 0.8 (a distance of about ten bits), so what they keep is joined by
    the similarity of the shingle sets themselves, at 0.8 or more. Texts without words are
    copies of each other. Rows without an id are kept; of rows that repeat an id, all or none.
    """
    first = written(simhash.first_of_groups(docs, width=5), "by-fingerprint")
    return minhash.first_of_groups(first, width=5, similarity=(8, 10))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Texts without letters hold none."""
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences, with their ids. Every row is packed, a
    text without letters as its end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", reject_low_quality),
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Robust fits, nearest examples and edit matching have no SQL form; a brute-force version
# tests the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done: list[str] = []
    for name, apply in STAGES[:-1]:
        docs = written(apply(spark, docs, sf_dir), f"stage-{name}")
        remove_scratch(spark, done)  # what the stage read
        done = scratch_paths()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
