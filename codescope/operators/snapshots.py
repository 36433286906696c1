"""Comparing snapshots and rewriting text in bulk."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codescope.functions.ordered import ordered_rows
from codescope.functions.text import check_pattern
from codescope.session import cut_and_count, cut_lineage, lookup_side
from codescope.sources.files import explode_lines


def breaking_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline members (kind, container, signature) that are gone: removed types, types
    with another signature, and removed or renamed members of the types that remain."""
    gone = baseline.select("kind", "container", "signature").distinct().join(
        current.select("container", "signature").distinct(), ["container", "signature"], "left_anti"
    )
    types = current.where(F.col("kind") == "Type").select("container").distinct().withColumn("_kept", F.lit(True))
    kept = F.col("_kept").isNotNull()
    change = (
        F.when((F.col("kind") == "Type") & ~kept, "TypeRemoved")
        .when(F.col("kind") == "Type", "TypeSignatureChanged")
        .when(kept, "MemberRemovedOrRenamed")
    )
    return (
        gone.join(types, "container", "left")
        .select(change.alias("change"), "container", "signature")
        .where(F.col("change").isNotNull())
    )


def content_drift(before: DataFrame, after: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Files changed, added or removed between two snapshots. Only digests are shuffled."""
    old = before.select(key, F.sha2(text, 256).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(key, F.sha2(text, 256).alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return old.join(new, key, "full").select(key, change.alias("change")).where(F.col("change").isNotNull())


def bulk_rewrite(
    files: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    text: str = "content",
    dry_run: bool = False,
    refuse_backtracking: bool = False,
) -> DataFrame:
    """Apply rewrites in order: ``("rename", old, new)`` replaces whole words,
    ``("regex", pattern, replacement)`` matches. Files without a match are left out.

    Returns the new text, the number of replacements and the outcome of each file. A dry run
    gives the same rows without the new text, with the outcome the rewrite would have.
    """
    content, count = F.col(text), F.lit(0)
    for kind, old, new in rules:
        if kind not in ("rename", "regex"):
            raise ValueError(f"unknown rewrite: {kind}")
        pattern = rf"\b{re.escape(old)}\b" if kind == "rename" else old
        if refuse_backtracking and kind == "regex":
            check_pattern(old)
        count = count + F.regexp_count(content, F.lit(pattern))
        if kind == "rename":
            new = new.replace("\\", "\\\\").replace("$", "\\$")
        content = F.regexp_replace(content, pattern, new)
    outcome = F.when(F.col("new_content") == F.col(text), "AlreadySatisfied").otherwise("Succeeded")
    keep = [c for c in files.columns if c != text]
    return (
        files.withColumns({"replacements": count.cast("long"), "new_content": content})
        .where("replacements > 0")
        .withColumn("outcome", outcome)
        .select(*keep, *([] if dry_run else ["new_content"]), "replacements", "outcome")
    )


def write_snapshot(rewritten: DataFrame, files: DataFrame, path: str, key: str = "path", text: str = "content") -> None:
    """Write the next snapshot: rewritten files with their new text, all others as they are."""
    new = rewritten.select(key, F.col("new_content").alias("_new"))
    merged = files.join(new, key, "left").withColumn(text, F.coalesce("_new", text)).drop("_new")
    merged.write.mode("errorifexists").parquet(path)


def line_diff(before: DataFrame, after: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Lines removed and added, compared position by position: after an inserted line all
    later lines differ. Files equal as a whole never reach the line join."""
    changed = content_drift(before, after, key, text).select(key)
    old = before.select(key, F.col(text).alias("content")).join(changed, key, "left_semi")
    new = after.select(key, F.col(text).alias("content")).join(changed, key, "left_semi")
    old_lines = explode_lines(old).withColumnRenamed("text", "removed")
    new_lines = explode_lines(new).withColumnRenamed("text", "added")
    return old_lines.join(new_lines, [key, "line_no"], "full").where(
        ~F.col("removed").eqNullSafe(F.col("added"))
    )


# --- many snapshots -----------------------------------------------------------------

MEMBER = ("container", "signature")


def api_history(snapshots: DataFrame, member: Sequence[str] = MEMBER, at: str = "snapshot") -> DataFrame:
    """One row per stretch of consecutive snapshots that hold a member: the member,
    ``valid_from`` (the first of them), ``valid_to`` (the first snapshot without it, null if it is
    in the latest) and ``n_snapshots``.

    ``snapshots`` has a row per member and snapshot; repeated rows count once, rows without a
    snapshot not at all. A null in a member is a value like any other. A member has at most as
    many rows as there are snapshots, so its window is bounded by their number.
    """
    names = [F.col(f"`{m}`") for m in member]
    present = cut_lineage(snapshots.select(*names, F.col(f"`{at}`").alias("_at")).where("_at IS NOT NULL").distinct())
    times = present.select("_at").distinct().withColumn("_all", F.lit(0))
    numbered = ordered_rows(times, ["_all"], ["_at"]).running(_nth=("sum", F.lit(1).cast("long"))).result().drop("_all")
    numbered, n = cut_and_count(numbered)
    placed = present.join(lookup_side(numbered, n), "_at")
    island = F.col("_nth") - F.row_number().over(Window.partitionBy(*names).orderBy("_nth"))
    spans = placed.withColumn("_island", island).groupBy(*names, "_island").agg(
        F.min("_at").alias("valid_from"), F.max("_nth").alias("_last"), F.count("*").alias("n_snapshots")
    )
    after = numbered.select(F.col("_at").alias("valid_to"), (F.col("_nth") - 1).alias("_last"))
    return spans.join(lookup_side(after, n), "_last", "left").select(*names, "valid_from", "valid_to", "n_snapshots")


def as_of(
    probes: DataFrame,
    versions: DataFrame,
    keys: Sequence[str] = MEMBER,
    at: str = "at",
    since: str = "valid_from",
) -> DataFrame:
    """``probes`` with ``found``: the last version of the key that began at or before ``at``, as a
    struct of ``since`` and the columns of ``versions`` that are no keys; null if there is none.

    Of versions that begin together the one with the greatest other columns is taken. Probes
    without a key or a time find nothing; repeated probes stay repeated. Versions and the distinct
    questions lie in one range-partitioned order, so a key with many of both is cut into pieces.
    """
    own = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    columns = [f"_k{i}" for i in range(len(keys))]
    shown = [since, *[c for c in versions.columns if c not in (*keys, since)]]
    version = F.struct(*[F.col(f"`{c}`") for c in shown])
    starts = versions.select(*own, F.col(f"`{since}`").alias("_at"), F.lit(0).alias("_asks"), version.alias("_version"))
    starts = starts.dropna(subset=[*columns, "_at"])
    # The last of those that begin together.
    starts = starts.groupBy(*columns, "_at", "_asks").agg(F.max("_version").alias("_version"))
    asked = probes.select(*own, F.col(f"`{at}`").alias("_at"), F.lit(1).alias("_asks")).dropna().distinct()
    laid = starts.unionByName(asked.withColumn("_version", F.lit(None).cast(starts.schema["_version"].dataType)))
    ordered = ordered_rows(laid, columns, ["_at", "_asks"]).running(found=("max", F.col("_version"))).result()
    found = ordered.where("_asks = 1").select(*columns, "_at", "found")
    met = F.col(f"`{at}`") == F.col("_at")
    for i, k in enumerate(keys):
        met = met & (F.col(f"`{k}`") == F.col(f"_k{i}"))
    return probes.join(found, met, "left").drop(*columns, "_at")
