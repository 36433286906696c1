"""Size, complexity, cohesion and summary metrics.

Records that hold lists (method names, parameter names) come back as rows next to
their group's totals: a list column would have to gather a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescope.functions.text import any_of, contains_ci, ends_with_any
from codescope.operators.graph import connected_components
from codescope.session import cut_lineage

# Endings of injected parameter types, and primitive type names.
INJECTED_SUFFIXES = ["Service", "Repository", "Options", "Factory"]
PRIMITIVE_TYPES = ["string", "int", "long", "Guid", "bool", "String", "Int32", "Int64", "Boolean"]
# Branching keywords and operators, each adding one path.
BRANCHES = r"\b(?:if|while|for|foreach|case|catch)\b| \? |&&|\|\|"
# Cohesion ratings by upper score bound.
COHESION_RATINGS = [(0.2, "Excellent"), (0.4, "Good"), (0.7, "Poor")]
# Ids reported wrongly for projects with generated pages.
GENERATED_PAGE_IDS = ["CS0234", "CS0246", "CS0103"]
# Score buckets with their inclusive upper bounds.
SCORE_BUCKETS = [("<0", -1), ("0-25", 25), ("26-50", 50), ("51-75", 75), ("76plus", None)]


def project_metrics(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Files, lines, types and methods per project, and over all (``is_total``)."""
    kind = F.col("kind")
    per_file = files.select(
        "project",
        F.lit(1).alias("files"),
        F.size(F.split("content", "\n", -1)).cast("long").alias("lines"),
        F.lit(0).alias("types"),
        F.lit(0).alias("methods"),
    )
    per_definition = definitions.select(
        "project",
        F.lit(0).alias("files"),
        F.lit(0).cast("long").alias("lines"),
        kind.isin("type", "interface").cast("int").alias("types"),
        (kind == "method").cast("int").alias("methods"),
    )
    counts = [F.sum(c).cast("long").alias(c) for c in ("files", "lines", "types", "methods")]
    return (
        per_file.unionByName(per_definition)
        .rollup("project")
        .agg(*counts, (F.grouping("project") == 1).alias("is_total"))
    )


def inventory(definitions: DataFrame) -> DataFrame:
    """The names of every file by kind, sorted, as rows with the kind's count."""
    counts = definitions.groupBy("path", "kind").agg(F.count("*").alias("n_of_kind"))
    return (
        definitions.select("path", "kind", "name")
        .join(counts, ["path", "kind"])
    )


def inventory_counts(definitions: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per file with a count column for each kind."""
    return definitions.groupBy("path").pivot("kind", list(kinds)).count().na.fill(0)


def large_units(definitions: DataFrame, kinds: Sequence[str], max_lines: int) -> DataFrame:
    """Units spanning more than ``max_lines`` (a one-line unit spans 0), largest first."""
    span = F.col("end_line") - F.col("line")
    return (
        definitions.where(F.col("kind").isin(list(kinds)))
        .withColumn("n_lines", span)
        .where(F.col("n_lines") > max_lines)
        .select("symbol_id", "name", "kind", "container", "path", "line", "n_lines")
    )


def large_switches(case_labels: DataFrame, max_sections: int = 10) -> DataFrame:
    """Switches with more than ``max_sections`` sections."""
    return (
        case_labels.groupBy("switch_id")
        .agg(F.count_distinct("label").alias("n_sections"))
        .where(F.col("n_sections") > max_sections)
    )


def long_parameter_lists(
    parameters: DataFrame, definitions: DataFrame, min_parameters: int = 4
) -> DataFrame:
    """Members with many parameters. A constructor whose parameters are all injected is exempt."""
    injected = F.col("type").rlike("(?:" + "|".join(INJECTED_SUFFIXES) + ")$")
    per_member = (
        parameters.groupBy("symbol_id")
        .agg(F.count("*").alias("n_parameters"), F.bool_and(injected).alias("_all_injected"))
        .where(F.col("n_parameters") >= min_parameters)
    )
    exempt = (F.col("kind") == "constructor") & F.col("_all_injected")
    return (
        definitions.join(per_member, "symbol_id")
        .where(~exempt)
        .select("symbol_id", "name", "kind", "path", "line", "n_parameters")
    )


def parameters_of(members: DataFrame, parameters: DataFrame) -> DataFrame:
    """The parameters of the reported members, in order."""
    return (
        parameters.join(members.select("symbol_id"), "symbol_id", "left_semi")
        .select("symbol_id", "ord", "name", "type")
    )


def repeated_parameter_types(parameters: DataFrame, min_same: int = 3) -> DataFrame:
    """Members with several parameters of one primitive type."""
    return (
        parameters.where(F.col("modifier") != "params")
        .where(F.col("type").isin(PRIMITIVE_TYPES))
        .groupBy("symbol_id", "type")
        .agg(F.count("*").alias("n_parameters"))
        .where(F.col("n_parameters") >= min_same)
    )


def multiple_out_parameters(
    parameters: DataFrame, definitions: DataFrame, min_out: int = 2
) -> DataFrame:
    """Methods with several out parameters: one row per element of the suggested tuple.

    The tuple starts with the current return value (``ord`` 0) unless that is void.
    """
    outs = parameters.where(F.col("modifier") == "out")
    many = (
        outs.groupBy("symbol_id")
        .agg(F.count("*").alias("n_out"))
        .where(F.col("n_out") >= min_out)
    )
    methods = definitions.where(F.col("kind") == "method").join(many, "symbol_id")
    element = F.concat_ws(" ", "type", "name").alias("tuple_element")
    members = methods.select(
        "symbol_id", F.col("name").alias("method"), "container", "return_type", "n_out"
    )
    elements = members.join(outs.select("symbol_id", "ord", element), "symbol_id")
    result = members.where(F.col("return_type") != "void").select(
        "*", F.lit(0).alias("ord"), F.concat("return_type", F.lit(" result")).alias("tuple_element")
    )
    return elements.unionByName(result)


def complexity(lines: DataFrame, member: Sequence[str] = ("project", "path")) -> DataFrame:
    """1 + the branches of every member, counted on its lines."""
    branches = F.regexp_count("text", F.lit(BRANCHES))
    return lines.groupBy(*member).agg((F.sum(branches) + 1).cast("long").alias("complexity"))


def complexity_of_units(units: DataFrame, branch_shapes: Sequence[str]) -> DataFrame:
    """The same on units, where the shape of an element tells a branch."""
    is_branch = F.col("shape").isin(list(branch_shapes))
    return units.groupBy("unit_id").agg((F.count_if(is_branch) + 1).alias("complexity"))


_BITS = 62
_CHUNK = 62 * 1024


def _numbered_methods(methods: DataFrame) -> DataFrame:
    """Give each method of a type a word and a bit.

    Methods of a large type are first spread over chunks by hash, so numbering never
    sorts a whole type in one task; numbers stay dense inside a chunk.
    """
    sizes = methods.groupBy("type_id").agg(F.count("*").alias("_n"))
    chunks = F.ceil(F.col("_n") / _CHUNK)
    chunk = F.pmod(F.xxhash64("method"), chunks)
    spread = methods.join(sizes, "type_id").withColumn("_chunk", chunk)
    number = F.row_number().over(Window.partitionBy("type_id", "_chunk").orderBy("method")) - 1
    return (
        spread.withColumn("_i", number)
        .withColumn("_word", F.struct("_chunk", F.floor(F.col("_i") / _BITS).alias("w")))
        .withColumn("_bit", F.expr(f"shiftleft(1L, CAST(_i % {_BITS} AS INT))"))
        .select("type_id", "method", "_word", "_bit")
    )


def cohesion_lcom(usages: DataFrame) -> DataFrame:
    """Lack of cohesion per type: the share of method pairs with no field in common.

    ``usages`` holds (type_id, method, field); a method without fields has a null field.
    Pairs are counted, never produced. Every method owns one bit; a field's users are the
    OR of their bits, and a field set's partners the OR over its fields. Methods with equal
    field sets have equal partners, so partners are built once per distinct set.
    """
    rows = usages.select("type_id", "method", "field").distinct()
    methods = rows.select("type_id", "method").distinct()
    total = methods.groupBy("type_id").agg(F.count("*").alias("n_methods"))

    # A field with one user joins no methods: most usages leave here.
    several = (
        rows.where(F.col("field").isNotNull())
        .groupBy("type_id", "field")
        .agg(F.count("*").alias("_users"))
        .where("_users > 1")
    )
    # Read four times below, so it is written once.
    used = cut_lineage(rows.join(several.select("type_id", "field"), ["type_id", "field"], "left_semi"))
    users = used.join(_numbered_methods(used.select("type_id", "method").distinct()), ["type_id", "method"])
    field_bits = users.groupBy("type_id", "field", "_word").agg(F.bit_or("_bit").alias("_bits"))

    # The set of fields is identified by two order-free hashes and its size.
    set_key = ["_n_fields", "_h1", "_h2"]
    field_sets = used.groupBy("type_id", "method").agg(
        F.count("*").alias("_n_fields"),
        F.bit_xor(F.xxhash64("field")).alias("_h1"),
        F.bit_xor(F.xxhash64(F.lit("set"), "field")).alias("_h2"),
    )
    sets = field_sets.groupBy("type_id", *set_key).agg(
        F.min("method").alias("method"), F.count("*").alias("_copies")
    )
    partners = (
        used.join(sets.select("type_id", "method", "_copies"), ["type_id", "method"])
        .join(field_bits, ["type_id", "field"])
        .groupBy("type_id", "method", "_copies", "_word")
        .agg(F.bit_count(F.bit_or("_bits")).alias("_n"))
        .groupBy("type_id", "method", "_copies")
        .agg(F.sum("_n").alias("_n"))
    )
    # Each method counts itself once among its partners; each pair is seen from both ends.
    sharing = partners.groupBy("type_id").agg(
        F.expr("sum(_copies * (_n - 1)) div 2").alias("_q")
    )
    pairs = F.expr("n_methods * (n_methods - 1) div 2")
    sharing_pairs = F.coalesce(F.col("_q"), F.lit(0).cast("long"))
    score = F.when(F.col("_pairs") > 0, F.round((F.col("_pairs") - sharing_pairs) / F.col("_pairs"), 4))
    rating = F.lit("Very Poor")
    for bound, name in reversed(COHESION_RATINGS):
        rating = F.when(F.col("lcom") <= bound, name).otherwise(rating)
    return (
        total.join(sharing, "type_id", "left")
        .withColumn("_pairs", pairs)
        .select(
            "type_id",
            "n_methods",
            (F.col("_pairs") - sharing_pairs).alias("pairs_apart"),
            sharing_pairs.alias("pairs_sharing"),
            F.coalesce(score, F.lit(0.0)).alias("lcom"),
        )
        .withColumn("rating", rating)
    )


def cohesion_components(usages: DataFrame) -> DataFrame:
    """Suggested splits: the groups of methods linked by shared fields, for types with
    more than one. One row per method or field of a group, largest group first."""
    rows = usages.select("type_id", "method", "field").distinct()
    used = rows.where(F.col("field").isNotNull())

    # Linking the users of a field to the least of them leaves the fields out of the graph,
    # and with them every method that shares nothing.
    least = used.groupBy("type_id", "field").agg(F.min("method").alias("_least"))

    def node(method: str):
        return F.concat_ws(":", F.col("type_id").cast("string"), F.col(method).cast("string"))

    links = used.join(least, ["type_id", "field"]).where("method <> _least")
    labels = connected_components(links.select(node("method").alias("src"), node("_least").alias("dst")))
    methods = (
        rows.select("type_id", "method", node("method").alias("node"))
        .distinct()
        .join(labels, "node", "left")
        .select("type_id", "method", F.coalesce("component", "node").alias("_c"))
    )
    fields = least.join(
        methods.withColumnRenamed("method", "_least"), ["type_id", "_least"]
    ).select("type_id", "_c", F.lit("field").alias("member_kind"), F.col("field").cast("string").alias("member"))
    members = methods.select(
        "type_id", "_c", F.lit("method").alias("member_kind"), F.col("method").cast("string").alias("member")
    ).unionByName(fields)
    part = ["type_id", "_c"]
    sizes = members.groupBy(*part).agg(
        F.count_if(F.col("member_kind") == "method").alias("n_methods"),
        F.min(F.when(F.col("member_kind") == "method", F.col("member"))).alias("component"),
    )
    split = sizes.groupBy("type_id").agg(F.count("*").alias("n_components")).where("n_components > 1")
    return (
        members.join(sizes, part)
        .join(split, "type_id")
        .select("type_id", "component", "n_components", "n_methods", "member_kind", "member")
    )


def extraction_candidates(definitions: DataFrame, min_public: int = 3) -> DataFrame:
    """Public classes without a base type and with several public instance methods: a row
    per method, with their number."""
    classes = definitions.where(
        (F.col("kind") == "type") & (F.col("accessibility") == "public") & (F.coalesce(F.size("base_types"), F.lit(0)) == 0)
    ).select(F.col("name").alias("container"))
    methods = (
        definitions.where((F.col("kind") == "method") & (F.col("accessibility") == "public"))
        .where(~F.array_contains("modifiers", "static"))
        .join(classes.distinct(), "container", "left_semi")
        .select("container", "name", "symbol_id")
    )
    counts = methods.groupBy("container").agg(F.count("*").alias("n_public")).where(
        F.col("n_public") >= min_public
    )
    return methods.join(counts, "container")


def health_report(findings: DataFrame, project: str | None = None) -> DataFrame:
    """Counts per (project, category), per project, per category and over all."""
    rows = findings if project is None else findings.where(contains_ci(F.col("project"), project))
    level = (
        F.when(F.grouping_id() == 0, "project_category")
        .when(F.grouping_id() == 1, "project")
        .when(F.grouping_id() == 2, "category")
        .otherwise("all")
    )
    return rows.cube("project", "category").agg(level.alias("level"), F.count("*").alias("n_findings"))


def health_page(findings: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """One page of projects by name with their counts, ``has_more`` and the grand total."""
    # Written: the page and its totals come from one pass over the findings.
    totals = cut_lineage(findings.groupBy("project").agg(F.count("*").alias("n_findings")))
    whole = totals.agg(F.struct(F.count("*").alias("n"), F.sum("n_findings").alias("all")).alias("w")).scalar()
    page = totals.orderBy("project").offset(offset).limit(limit)
    return page.withColumns({"n_projects": whole["n"], "grand_total": whole["all"]}).withColumn(
        "has_more", F.col("n_projects") > offset + limit
    )


def severity_report(
    diagnostics: DataFrame,
    max_details: int = 50,
    flagged_project: Column | None = None,
    ignored_ids: Sequence[str] = tuple(GENERATED_PAGE_IDS),
    order: Sequence[str] = ("project", "path", "line"),
) -> DataFrame:
    """The first ``max_details`` diagnostics, errors before warnings, with exact totals."""
    rows = diagnostics.where(F.col("severity") != "Hidden")
    if flagged_project is not None:
        rows = rows.where(~(flagged_project & F.upper("id").isin(list(ignored_ids))))
    rank = F.when(F.col("severity") == "Error", 0).when(F.col("severity") == "Warning", 1).otherwise(2)
    counts = [F.count_if(F.col("severity") == severity).alias(severity) for severity in ("Error", "Warning")]
    both = rows.agg(F.struct(*counts).alias("both")).scalar()
    totals = {"total_errors": both["Error"], "total_warnings": both["Warning"]}
    return rows.orderBy(rank, *order).limit(max_details).withColumns(totals)


def coverage_progress(
    definitions: DataFrame, parameters: DataFrame, obsolete_calls: DataFrame, bridge_text: str
) -> DataFrame:
    """Per project: async methods with and without a token parameter, wrappers that bridge
    to async code, void handlers, and calls still to be moved.

    A method is a wrapper if its obsolete message contains ``bridge_text``. ``definitions`` needs is_async, return_type, modifiers and obsolete_message;
    ``obsolete_calls`` holds one row per call with its project.
    """
    token = F.col("type").rlike(r"(?:^|\.)CancellationToken$")
    with_token = parameters.where(token).select("symbol_id").distinct().withColumn("_token", F.lit(True))
    is_void = F.col("is_async") & (F.col("return_type") == "void")
    returns_task = F.col("return_type").rlike("^(?:Value)?Task")
    counted = ~is_void & (F.col("is_async") | returns_task) & ~F.array_contains("modifiers", "abstract")
    has_token = counted & F.col("_token").isNotNull()
    bridge = counted & contains_ci(F.coalesce("obsolete_message", F.lit("")), bridge_text)
    progress = (
        definitions.where(F.col("kind") == "method")
        .join(with_token, "symbol_id", "left")
        .groupBy("project")
        .agg(
            F.count_if(counted).alias("total_async"),
            F.count_if(has_token).alias("with_token"),
            F.count_if(counted & F.col("_token").isNull()).alias("without_token"),
            F.count_if(bridge).alias("bridge_wrappers"),
            F.count_if(is_void).alias("void_handlers"),
        )
    )
    pending = obsolete_calls.groupBy("project").agg(F.count("*").alias("pending_calls"))
    percent = F.round(F.col("with_token") / F.col("total_async") * 100, 1)
    return (
        progress.join(pending, "project", "left")
        .withColumn("pending_calls", F.coalesce("pending_calls", F.lit(0).cast("long")))
        .withColumn("token_pct", F.when(F.col("total_async") > 0, percent).otherwise(0.0))
    )


def score_bucket(score: Column) -> Column:
    bucket = None
    for name, upper in SCORE_BUCKETS:
        if upper is None:
            return bucket.otherwise(name)
        bucket = (F if bucket is None else bucket).when(score <= upper, name)
    return bucket


def score_summary(
    candidates: DataFrame, min_score: int | None = None, max_classes: int = 10
) -> DataFrame:
    """Summary rows (dimension, key, n): total, min and max score, per pattern, per score
    bucket (all five, also when empty) and the largest classes."""
    rows = candidates if min_score is None else candidates.where(F.col("score") >= min_score)
    score = F.col("score").cast("long")
    # One pass: counts per (pattern, class, project, bucket) carry everything below.
    base = rows.groupBy("pattern", "class_name", "project", score_bucket(F.col("score")).alias("bucket")).agg(
        F.count("*").alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")
    )

    def dimension(name, key, df, n):
        return df.select(F.lit(name).alias("dimension"), key.alias("key"), n.alias("n"))

    totals = base.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("lo").alias("min_score"), F.max("hi").alias("max_score")
    ).unpivot([], ["total", "min_score", "max_score"], "name", "n")
    patterns = base.groupBy("pattern").agg(F.sum("n").alias("n"))
    seen = base.groupBy("bucket").agg(F.sum("n").alias("n"))
    names = [name for name, _ in SCORE_BUCKETS]
    all_buckets = base.sparkSession.createDataFrame([(n,) for n in names], "bucket STRING")
    buckets = all_buckets.join(seen, "bucket", "left").na.fill(0, ["n"])
    classes = base.groupBy("class_name", "project").agg(F.sum("n").alias("n"))
    key = F.concat_ws("/", "project", "class_name")
    top = classes.orderBy(F.desc("n"), key).limit(max_classes)
    truncated = classes.agg((F.count("*") > max_classes).cast("long").alias("n"))
    return (
        dimension("summary", F.col("name"), totals, F.col("n"))
        .unionByName(dimension("pattern", F.col("pattern"), patterns, F.col("n")))
        .unionByName(dimension("bucket", F.col("bucket"), buckets, F.col("n")))
        .unionByName(dimension("class", key, top, F.col("n")))
        .unionByName(dimension("summary", F.lit("classes_truncated"), truncated, F.col("n")))
    )


def top_candidates(candidates: DataFrame, top_n: int = 5, order: Sequence[str] = ("member",)) -> DataFrame:
    """The best-scored candidates."""
    return candidates.orderBy(F.desc("score"), *order).limit(top_n)


# Weights of the signals that make a method worth converting.
CANDIDATE_WEIGHTS = {
    "blocking-calls": 40,
    "calls-CommonSearch": 30,
    "sql-access": 25,
    "service-class": 15,
    "static": 5,
    "virtual-override-penalty": -20,
    "event-handler": 40,
    "calls-obsolete-wrapper": 20,
}
SERVICE_SUFFIX = ["Service"]


def score_candidates(
    features: DataFrame,
    signals: Mapping[str, tuple[Column, int]],
    disqualifiers: Sequence[Column] = (),
    requires_one_of: Mapping[str, Sequence[str]] | None = None,
    min_score: int = 50,
) -> DataFrame:
    """Score rows by weighted signals.

    A row with any disqualifier is dropped. ``requires_one_of`` drops a row showing the
    named signal without any of the listed ones. ``flagged`` splits at ``min_score``.
    """
    rows = features if not disqualifiers else features.where(~any_of([F.coalesce(d, F.lit(False)) for d in disqualifiers]))
    found = {name: F.coalesce(condition, F.lit(False)) for name, (condition, _) in signals.items()}
    for name, helpers in (requires_one_of or {}).items():
        alone = found[name] & ~any_of([found[h] for h in helpers])
        rows = rows.where(~alone)
    score = sum((F.when(found[n], w).otherwise(0) for n, (_, w) in signals.items()), F.lit(0))
    reasons = [F.when(found[n], F.lit(f"{n}:{w}")) for n, (_, w) in signals.items()]
    return rows.withColumns({"score": score, "reason": F.concat_ws(" ", *reasons)}).withColumn(
        "flagged", F.col("score") >= min_score
    )


def method_signals(body: Column, class_name: Column) -> dict[str, tuple[Column, int]]:
    """The signals readable from a method's text and its class name."""
    blocking = any_of([
        body.contains(".GetAwaiter().GetResult()"),
        body.contains(".Wait("),
        body.contains(".Result") & ~body.contains("// "),
    ])
    sql = any_of([body.contains(w) for w in ("SqlCommand", "SqlConnection", "getDataContext", "DataContext")])
    conditions = {
        "blocking-calls": blocking,
        "calls-CommonSearch": body.contains("CommonSearch"),
        "sql-access": sql,
        "service-class": ends_with_any(class_name, SERVICE_SUFFIX),
    }
    return {name: (condition, CANDIDATE_WEIGHTS[name]) for name, condition in conditions.items()}
