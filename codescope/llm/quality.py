"""Quality rules (operator 2): base rules, and robust multivariate outliers.

Statistics of a text become a vector of transformed values. Per language and source, the
minimum-covariance-determinant estimate finds the centre and spread of the densest part of
the vectors; rows too far from it by Mahalanobis distance are rejected. Column expressions
only: no Python runs on the executors.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.llm.shared import BLANKS, written

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
# Features with the least standard deviation each is taken to have.
FLOORS = {"length": 0.5, "word_length": 0.1, "symbols": 0.04, "dup_lines": 0.2, "repeats": 0.15}
BLANK_CHARS = " \t\n\x0b\x0c\r"


def _parts(text: Column) -> list[Column]:
    trimmed = F.trim(text, F.lit(BLANK_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANK_CHARS)) != "")
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return [words.alias("words"), lines.alias("lines"), symbols.cast("long").alias("n_symbols")]


def _windows(words: Column) -> Column:
    """A hash of every window of five words, in order."""
    ends = F.sequence(F.lit(WINDOW), F.size(words))
    window = lambda e: F.xxhash64(*[F.get(words, e - k) for k in range(WINDOW, 0, -1)])
    return F.when(F.size(words) >= WINDOW, F.transform(ends, window)).otherwise(F.array().cast("array<bigint>"))


def _shifted(array: Column) -> Column:
    return F.slice(array, 2, F.size(array))


def _covered(marks: Column) -> Column:
    """How many words lie in windows whose hash occurs again; sorting brings equals together."""
    same = F.zip_with(marks, _shifted(marks), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    before = F.concat(F.array(F.lit(False)), same)
    at = F.zip_with(marks, F.zip_with(same, before, lambda a, b: a | b), lambda m, again: F.when(again, m["i"]))
    at = F.sort_array(F.filter(at, lambda i: i.isNotNull()))
    steps = F.zip_with(at, _shifted(at), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, stats): the rows of ``docs`` as a struct, so that no column name can clash, and the
    counts n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words of the whole
    text. Null texts have no words."""
    out = docs.select(F.struct("*").alias("row"))
    out = out.withColumn("content", F.coalesce(F.col(f"row.`{text}`"), F.lit("")))
    out = out.select("row", *_parts(F.col("content")))
    out = out.withColumn("hashes", _windows(F.col("words")))
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    out = out.withColumn("marks", F.when(repeated, F.sort_array(F.transform("hashes", pair))))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_lines": F.size("lines"),
        "n_repeat_words": F.when(F.col("marks").isNull(), F.lit(0)).otherwise(_covered(F.col("marks"))),
    }
    return out.select("row", F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]).alias("stats"))


def base_failed(stats: str = "stats") -> Column:
    """Too short (under 10 words), or over a fifth of the words lie in repeated windows."""
    n, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 10) | (100 * repeats > 20 * n)


def features(stats: str = "stats") -> list[Column]:
    """The transformed statistics, in the order of ``FLOORS``; zero where nothing is counted."""
    s = lambda name: F.col(f"{stats}.{name}").cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(s(a), s(b)), F.lit(0.0))
    return [
        F.log1p(s("n_words")),
        F.log1p(share("word_chars", "n_words")),
        F.sqrt(share("n_symbols", "word_chars")),
        F.sqrt(share("n_dup_lines", "n_lines")),
        F.sqrt(share("n_repeat_words", "n_words")),
    ]


def chi_square(degrees: int, probability: float) -> float:
    """The quantile, by the cube-root approximation of Wilson and Hilferty."""
    spread = 2 / (9 * degrees)
    return degrees * (1 - spread + NormalDist().inv_cdf(probability) * spread**0.5) ** 3


P = len(FLOORS)
X = [f"x{i}" for i in range(P)]


def _level(sizes: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, group): the pair itself if it has enough rows; else what is left over of
    its language; else what is left over in all."""
    pair = sizes.withColumn("own", F.col("n") >= min_rows)
    rest = pair.where(~F.col("own")).groupBy("lang").agg(F.sum("n").alias("n_rest"))
    pair = pair.join(rest.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left")
    name = lambda kind, *cols: F.to_json(F.struct(F.lit(kind).alias("kind"), *cols))
    group = (
        F.when(F.col("own"), name("pair", "lang", "source"))
        .when(F.col("n_rest") >= min_rows, name("lang", "lang"))
        .otherwise(name("rest"))
    )
    return pair.select("lang", "source", group.alias("group"))


def _cholesky(rows: DataFrame) -> DataFrame:
    """Add the Cholesky factor ``f_i_j`` of the covariances ``c_i_j``, one entry after the other,
    and the log determinant."""
    for i in range(P):
        for j in range(i + 1):
            value = F.col(f"c_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"f_{i}_{k}") * F.col(f"f_{j}_{k}")
            value = F.sqrt(value) if i == j else value / F.col(f"f_{j}_{j}")
            rows = rows.withColumn(f"f_{i}_{j}", value)
    log_det = sum((2 * F.log(f"f_{i}_{i}") for i in range(1, P)), 2 * F.log("f_0_0"))
    return rows.withColumn("log_det", log_det)


# Tables with a row per group are broadcast up to so many rows (a few megabytes); beyond it
# they are joined by shuffle. Their rows are counted: small files would look larger than they are.
BROADCAST_GROUPS = 20_000


def _side(table: DataFrame, n_groups: int) -> DataFrame:
    return F.broadcast(table) if n_groups <= BROADCAST_GROUPS else table


MODEL = [*[f"m_{i}" for i in range(P)], *[f"f_{i}_{j}" for i in range(P) for j in range(i + 1)], "log_det"]


def _squared(rows: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance: forward substitution with the Cholesky
    factor, one step a column."""
    for i in range(P):
        value = F.col(X[i]) - F.col(f"m_{i}")
        for j in range(i):
            value = value - F.col(f"f_{i}_{j}") * F.col(f"z_{j}")
        rows = rows.withColumn(f"z_{i}", value / F.col(f"f_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") ** 2 for i in range(1, P)), F.col("z_0") ** 2)).drop(*[f"z_{i}" for i in range(P)])


def _step(column: Column) -> Column:
    """A squared distance in steps of a hundredth of its logarithm: few enough values that an
    exact percentile holds a bounded table, whatever the number of rows."""
    return F.round(F.log1p(column), 2)


def fit(stats: DataFrame, min_rows: int = 200, core: float = 0.75, max_steps: int = 10, settled: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Fit the estimate; ``stats`` has lang, source and the features x0...

    Returns (lang, source, group) and a model row per group. Starting from the ``core`` share of
    rows nearest to the medians, concentration steps re-estimate mean and covariance and pick
    the nearest rows anew, until no group's log determinant falls by more than ``settled``.
    Groups under ``min_rows`` rows are pooled with what is left over of their language, or in
    all; a pool still below it has no model, and none of its rows is an outlier.
    """
    sizes = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    levels = written(_level(sizes, min_rows), "levels")
    n = levels.count()
    floors = list(FLOORS.values())
    rows = written(
        stats.join(_side(levels.toDF("_l", "_s", "group"), n), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).select("group", *X),
        "vectors",
    )
    median = rows.groupBy("group").agg(F.count("*").alias("n"), *[F.percentile(F.round(x, 2), F.lit(0.5)).alias(f"m_{i}") for i, x in enumerate(X)])
    median = written(median.where(F.col("n") >= min_rows).drop("n"), "medians")
    spread = rows.join(_side(median, n), "group").groupBy("group").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(P)],
        *[F.greatest(1.4826 * F.percentile(F.round(F.abs(F.col(x) - F.col(f"m_{i}")), 2), F.lit(0.5)), F.lit(floors[i])).alias(f"f_{i}_{i}") for i, x in enumerate(X)],
    )
    zeros = [F.lit(0.0).alias(f"f_{i}_{j}") for i in range(P) for j in range(i)]
    model = spread.select("*", *zeros, F.lit(float("inf")).alias("log_det")).select("group", *MODEL)
    model = written(model, "start")
    for _ in range(max_steps):
        near = rows.join(_side(model, n), "group")
        near = _squared(near).select("group", *X, _step(F.col("d2")).alias("step"))
        bound = written(near.groupBy("group").agg(F.percentile("step", F.lit(core)).alias("bound")), "bounds")
        chosen = near.join(_side(bound, n), "group").where("step <= bound")
        moments = chosen.groupBy("group").agg(
            *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(X)],
            *[
                (F.covar_pop(X[i], X[j]) + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}")
                for i in range(P)
                for j in range(i + 1)
            ],
        )
        before, model = model, written(_cholesky(moments).select("group", *MODEL), "model")
        old = before.select("group", F.col("log_det").alias("old"))
        if model.join(old, "group").where(F.col("old") - F.col("log_det") > settled).isEmpty():
            break
    near = _squared(rows.join(_side(model, n), "group"))
    scale = near.groupBy("group").agg((F.expm1(F.percentile(_step(F.col("d2")), F.lit(0.5))) / chi_square(P, 0.5)).alias("scale"))
    return levels, written(model.join(scale, "group").withColumn("scale", F.greatest("scale", F.lit(1.0))), "fitted")


def judge(measured: DataFrame, levels: DataFrame, model: DataFrame, cutoff: float) -> DataFrame:
    """(row, stats, base_failed, d2, kept): not kept are rows that fail the base rules or lie
    further from their group's centre than the chi-square quantile ``cutoff``."""
    table = written(levels.join(model, "group", "left").withColumnsRenamed({"lang": "l", "source": "s"}), "judges")
    same = F.col("row.lang").eqNullSafe(F.col("l")) & F.col("row.source").eqNullSafe(F.col("s"))
    vectors = measured.select("*", *[f.alias(x) for f, x in zip(features(), X)])
    out = _squared(vectors.join(_side(table, table.count()), same, "left")).withColumn("d2", F.col("d2") / F.col("scale"))
    inside = F.coalesce(F.col("d2") <= chi_square(P, cutoff), F.lit(True))
    return out.select("row", "stats", base_failed().alias("base_failed"), "d2", (~base_failed() & inside).alias("kept"))


CUTOFF = 1 - 1e-7


def assess(docs: DataFrame, back: list[str] | None = None, cutoff: float = CUTOFF, text: str = "text", min_rows: int = 200) -> DataFrame:
    """(row, stats, base_failed, d2, kept), one row per row of ``docs``.

    ``docs`` has the columns lang and source; nulls there form groups of their own. The estimate
    is fitted on the rows that pass the base rules; d2 is null for groups too small for one.
    ``row`` has the columns ``back`` (all if not given; lang and source always).
    """
    names = list(dict.fromkeys([*(docs.columns if back is None else back), "lang", "source"]))
    row = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in names]).alias("row")
    measured = written(with_statistics(docs, text).select(row, "stats"), "statistics")
    passing = measured.where(~base_failed()).select("row.lang", "row.source", *[f.alias(x) for f, x in zip(features(), X)])
    levels, model = fit(passing, min_rows)
    return judge(measured, levels, model, cutoff)
