"""Named detectors with one result schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.schemas import FINDINGS
from codescope.session import disk_released

Context = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Detector:
    """``find`` returns some of the columns of the findings table; the rest become null."""

    id: str
    domain: str
    severity: str
    needs: tuple[str, ...]
    find: Callable[..., DataFrame]


def as_findings(rows: DataFrame, detector: Detector) -> DataFrame:
    fixed = {"detector": detector.id, "domain": detector.domain, "severity": detector.severity}
    columns = []
    for field in FINDINGS.fields:
        if field.name in fixed:
            value = F.lit(fixed[field.name])
        elif field.name in rows.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def catalogue(spark: SparkSession, detectors: Iterable[Detector]) -> DataFrame:
    rows = [(d.id, d.domain, d.severity, ",".join(d.needs)) for d in detectors]
    return spark.createDataFrame(rows, "detector STRING, domain STRING, severity STRING, needs STRING")


def run_detectors(
    context: Context,
    detectors: Iterable[Detector],
    ids: Iterable[str] | None = None,
    domain: str | None = None,
) -> DataFrame:
    """The findings of the chosen detectors as one table."""
    detectors = list(detectors)
    wanted = None if ids is None else set(ids)
    unknown = (wanted or set()) - {d.id for d in detectors}
    if unknown:
        raise LookupError(f"unknown detectors: {sorted(unknown)}")
    chosen = [
        d for d in detectors if (wanted is None or d.id in wanted) and (domain is None or d.domain == domain)
    ]
    if not chosen:
        raise LookupError("no detector chosen")
    parts = [as_findings(d.find(*(context[n] for n in d.needs)), d) for d in chosen]
    return reduce(DataFrame.unionByName, parts)


def count_findings(
    spark: SparkSession, groups: Iterable[tuple[Iterable[str], Context]], detectors: Iterable[Detector]
) -> DataFrame:
    """(detector, n_findings) of the detectors that found something, for ids and their tables.

    One group is counted after the other, and gives its disk back before the next begins: in one
    plan the shuffles of all of them would lie on disk together.
    """
    detectors, counts = list(detectors), []
    with disk_released(spark):
        for ids, context in groups:
            with disk_released(spark):
                found = run_detectors(context, detectors, ids=ids)
                counts += found.groupBy("detector").agg(F.count("*").alias("n_findings")).collect()
    return spark.createDataFrame(counts, "detector STRING, n_findings BIGINT")
