"""Rule scans over lines and literals, and typed naming rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.functions.text import BACKTRACKING_SHAPES, any_of, contains_ci, preview, trimmed
from codescope.operators.rulepack import RULES, Rule

# Comment keywords, most severe first.
TODO_KEYWORDS = ["BUG", "FIXME", "HACK", "TODO", "REVIEW", "NOTE"]
# Parts of names that hold credentials.
SECRET_NAMES = [
    "password", "passwd", "secret", "apikey", "api_key", "token", "connectionstring", "privatekey", "authtoken",
    "clientsecret", "accesskey", "credential", "passphrase", "apisecret",
]
# Openings of well-known keys.
KEY_PREFIXES = ["sk-live-", "sk-test-", "sk-ant-", "ghp_", "gho_", "ghs_", "glpat-"]
# Marks of a secret in a comment.
COMMENT_SECRET = (
    r"(?i)(?:password|secret|apikey|api_key|token|bearer|sk-live-|sk-test-|"
    r"eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+)"
)
# The reasons told of a value, and the form of a password in a connection string.
REASONS = {
    "connection_password": "connection string with embedded password",
    "web_token": "JWT token",
    "known_key": "API key",
    "mixed_value": "high-entropy secret value",
}
CONNECTION_PASSWORD = r"(?i)(?:password|pwd)\s*=\s*[^;]{3,}"
# A comment on one line; where it starts inside a literal the rule errs.
LINE_COMMENT = r"(?://|/\*)(.*)$"
ASSIGNMENT = r"(?i)([\p{L}_][\p{L}\p{N}_]*)\s*=\s*\"([^\"]*)\""


def _rule_hit(rule: Rule, text: Column, path: Column) -> Column:
    hit = text.rlike(rule.regex)
    if rule.needs:
        hit = any_of([text.contains(n) for n in rule.needs]) & hit
    if rule.unless is not None:
        hit = hit & ~text.rlike(rule.unless)
    if rule.paths is not None:
        hit = hit & path.rlike(rule.paths)
    if rule.skip_paths is not None:
        hit = hit & ~path.rlike(rule.skip_paths)
    return hit


def _scan(rows: DataFrame, rules: Sequence[Rule], text: str, line: Column) -> DataFrame:
    body, path = F.col(text), F.col("path")
    found = [
        F.when(
            _rule_hit(rule, body, path),
            F.struct(
                F.lit(rule.id).alias("detector"),
                F.lit(rule.domain).alias("domain"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.message).alias("message"),
            ),
        )
        for rule in rules
    ]
    return (
        rows.select("project", "path", line.alias("line"), F.explode(F.array_compact(F.array(*found))).alias("_f"))
        .select("_f.detector", "_f.domain", "_f.severity", "project", "path", "line", "_f.message")
    )


def rule_scan(lines: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """One finding per (line, rule): all rules in one pass over the lines, without a shuffle."""
    return _scan(lines, [r for r in rules if not r.whole_file], "text", F.col("line_no"))


def file_scan(files: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """The rules that read whole files; their findings point at line 1."""
    return _scan(files, [r for r in rules if r.whole_file], "content", F.lit(1))


def todo_scan(
    lines: DataFrame, keywords: Sequence[str] = tuple(TODO_KEYWORDS), comments_only: bool = True
) -> DataFrame:
    """The first keyword, in the given priority, found as a whole word in a line's comment."""
    comment = F.regexp_substr("text", F.lit(LINE_COMMENT)) if comments_only else F.col("text")
    kind = F.coalesce(*(F.when(comment.rlike(rf"(?i)\b{k}\b"), k.upper()) for k in keywords))
    # A plain substring test first: most lines hold none of the words.
    mentioned = any_of([contains_ci(F.col("text"), k) for k in keywords])
    return (
        lines.where(mentioned)
        .select("path", "line_no", kind.alias("kind"), trimmed(comment).alias("comment"))
        .where(F.col("kind").isNotNull())
    )


def secret_scan(lines: DataFrame) -> DataFrame:
    """Possible secrets, one row per hit, with its class and reason.

    HardcodedSecret: a credential name assigned a literal of more than 3 characters.
    HardcodedSecretValue: a literal of 8 or more that is a connection string with a password,
    a signed web token, a known key, or a long mixed value assigned to such a name.
    SecretInComment: a comment with the mark of a secret.
    """
    credential = "(?i)" + "|".join(SECRET_NAMES)
    names = F.regexp_extract_all("text", F.lit(ASSIGNMENT), F.lit(1))
    values = F.regexp_extract_all("text", F.lit(ASSIGNMENT), F.lit(2))
    assigned = F.arrays_zip(names.alias("name"), values.alias("value"))
    literals = F.transform(
        F.regexp_extract_all("text", F.lit(r'"([^"]*)"'), F.lit(1)),
        lambda v: F.struct(F.lit(None).cast("string").alias("name"), v.alias("value")),
    )

    def hit(class_name: str, name: Column, reason: Column) -> Column:
        return F.struct(F.lit(class_name).alias("class"), name.alias("name"), reason.alias("reason"))

    def by_name(a: Column) -> Column:
        named = a["name"].rlike(credential) & (F.char_length(a["value"]) > 3)
        return F.when(named, hit("HardcodedSecret", a["name"], F.lit("credential name")))

    def known_form(v: Column) -> Column:
        """The reason by which a value is a secret whatever its name; else null."""
        dots = F.char_length(v) - F.char_length(F.replace(v, F.lit("."), F.lit("")))
        return (
            F.when(v.rlike(CONNECTION_PASSWORD) & ~v.contains("@"), REASONS["connection_password"])
            .when(v.startswith("eyJ") & (dots >= 2) & (F.char_length(v) > 50), REASONS["web_token"])
            .when(v.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"), REASONS["known_key"])
        )

    def by_value(a: Column) -> Column:
        reason = known_form(a["value"])
        return F.when((F.char_length(a["value"]) >= 8) & reason.isNotNull(), hit("HardcodedSecretValue", a["name"], reason))

    def by_mix(a: Column) -> Column:
        v = a["value"]
        mixed = v.rlike(r"\p{Lu}") & v.rlike(r"\p{Ll}") & v.rlike(r"\p{Nd}")
        plain = (F.char_length(v) > 30) & ~v.contains(" ") & mixed & a["name"].rlike(credential)
        return F.when(plain & known_form(v).isNull(), hit("HardcodedSecretValue", a["name"], F.lit(REASONS["mixed_value"])))

    comment = F.regexp_substr("text", F.lit(LINE_COMMENT))
    in_comment = F.when(
        comment.rlike(COMMENT_SECRET), hit("SecretInComment", F.lit(None).cast("string"), F.lit("mark of a secret"))
    )
    hits = F.array_compact(
        F.concat(
            F.transform(assigned, by_name),
            F.transform(literals, by_value),
            F.transform(assigned, by_mix),
            F.array(in_comment),
        )
    )
    worth_reading = F.col("text").contains('"') | comment.isNotNull()
    return (
        lines.where(worth_reading)
        .select("project", "path", "line_no", F.explode(hits).alias("_h"))
        .select("project", "path", "line_no", "_h.class", "_h.name", "_h.reason")
    )


def path_literals(literals: DataFrame, value: str = "value") -> DataFrame:
    """Literals that look like file system paths."""
    text = F.col(value)
    return literals.where(text.contains(":\\") | text.contains("/") | text.startswith("\\\\"))


def redos_scan(literals: DataFrame, value: str = "value") -> DataFrame:
    """Regex literals that can backtrack without bound, with the first shape that shows it."""
    text = F.col(value)
    signal = F.coalesce(*(F.when(text.rlike(regex), name) for name, regex in BACKTRACKING_SHAPES.items()))
    return literals.withColumn("signal", signal).where(F.col("signal").isNotNull()).withColumn(
        "shown", preview(text, 60)
    )


def naming_violations(
    definitions: DataFrame,
    parameters: DataFrame | None = None,
    field_pattern: str = r"^_[a-z]",
) -> DataFrame:
    """Names against convention: private instance fields without ``_camelCase``, non-private
    methods starting in lower case, and parameters starting in upper case."""
    kind, name = F.col("kind"), F.col("name")
    fixed = F.arrays_overlap("modifiers", F.array(F.lit("static"), F.lit("const")))
    generated = name.rlike("[<>]") | (name == "_")
    private_field = (kind == "field") & (F.col("accessibility") == "private") & ~fixed & ~generated
    open_method = (kind == "method") & F.col("accessibility").isin("public", "protected", "internal")
    rule = F.when(private_field & ~name.rlike(field_pattern), "private_field").when(
        open_method & name.rlike(r"^\p{Ll}"), "method"
    )
    found = definitions.select("symbol_id", "name", rule.alias("rule")).where(F.col("rule").isNotNull())
    if parameters is not None:
        upper = name.rlike(r"^\p{Lu}") & (F.col("modifier") != "this")
        found = found.unionByName(parameters.where(upper).select("symbol_id", "name", F.lit("parameter").alias("rule")))
    return found


def async_suffix_violations(definitions: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """Async methods without the Async ending, and others with it. Event handlers are exempt:
    names starting with On, and the methods listed in ``handlers`` (symbol_id)."""
    is_async = F.array_contains("modifiers", "async") | F.col("return_type").rlike("^(?:Value)?Task(?:<|$)")
    ends = F.endswith("name", F.lit("Async"))
    rule = F.when(is_async & ~ends, "missing_suffix").when(~is_async & ends, "needless_suffix")
    methods = definitions.where((F.col("kind") == "method") & ~F.startswith("name", F.lit("On")))
    if handlers is not None:
        methods = methods.join(handlers.select("symbol_id"), "symbol_id", "left_anti")
    return methods.withColumn("rule", rule).where(F.col("rule").isNotNull())


def event_handlers(parameters: DataFrame) -> DataFrame:
    """Members with exactly two parameters, the second of an event argument type."""
    second = (F.col("ord") == 2) & F.col("type").contains("EventArgs")
    return (
        parameters.groupBy("symbol_id")
        .agg(F.count("*").alias("_n"), F.bool_or(second).alias("_e"))
        .where("_n = 2 AND _e")
        .select("symbol_id")
    )


def dedupe_rank(findings: DataFrame, ranks: Sequence[str], key: Sequence[str] = ("kind", "line", "member")) -> DataFrame:
    """One finding per key, that with the worst risk; ``ranks`` lists the risks from worst to least."""
    order = F.array_position(F.array(*(F.lit(r) for r in ranks)), F.col("risk"))
    rest = [c for c in findings.columns if c not in key]
    return (
        findings.withColumn("_rank", F.when(order > 0, order).otherwise(len(ranks) + 1))
        .groupBy(*key)
        .agg(F.min(F.struct("_rank", *rest)).alias("_f"))
        .select(*key, *(F.col(f"_f.{c}").alias(c) for c in rest), F.col("_f._rank").alias("_rank"))
        .drop("_rank")
    )


def risk_counts(findings: DataFrame, ranks: Sequence[str], key: Sequence[str] = ("kind", "line", "member")) -> DataFrame:
    return dedupe_rank(findings, ranks, key).groupBy("risk").agg(F.count("*").alias("n_findings"))


