"""Queries over text rules, snapshots, outcomes and streams (T, D, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescope.operators import outcomes, rule_table, snapshots, text_rules
from codescope.operators.rulepack import RULES, Rule
from codescope.plans.catalog import query, utc
from codescope.session import scratch_path, shared_dir
from codescope.streaming import jobs, limits, rescan
from codescope.streaming.stateful import rocksdb

# Rules for prose, next to the shipped pack for source code.
PROSE_RULES = [
    Rule("mail_address", "privacy", "Warning", r"[a-z0-9.]+@[a-z0-9]+\.", "mail address", needs=("@",)),
    Rule("license", "legal", "Info", r"(?i)license", "license text", unless=r"(?i)mit license"),
    Rule("ip_address", "privacy", "Info", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "address", skip_paths=r"/de/"),
]

_RULE_SCAN = r"""SELECT 'mail_address' AS detector, 'privacy' AS domain, 'Warning' AS severity, project, path, line_no AS line, 'mail address' AS message
          FROM p_lines WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+\.')
        UNION ALL SELECT 'license', 'legal', 'Info', project, path, line_no, 'license text' FROM p_lines
          WHERE contains(lower(text), 'license') AND NOT contains(lower(text), 'mit license')
        UNION ALL SELECT 'ip_address', 'privacy', 'Info', project, path, line_no, 'address' FROM p_lines
          WHERE regexp_matches(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AND NOT contains(path, '/de/')"""


@query("T1_rule_scan", _RULE_SCAN)
def _(t):
    return text_rules.rule_scan(t.view("p_lines"), [*RULES, *PROSE_RULES])


@query(
    "T1_file_scan",
    r"""SELECT 'two_lines' AS detector, 'text' AS domain, 'Info' AS severity, project, path, CAST(1 AS BIGINT) AS line, 'line break' AS message
        FROM p_files WHERE regexp_matches(content, '[.]\s*\n[A-Z]')""",
)
def _(t):
    rule = Rule("two_lines", "text", "Info", r"[.]\s*\n[A-Z]", "line break", whole_file=True)
    return text_rules.file_scan(t.view("p_files"), [*RULES, rule])


_WORD_RULES = """SELECT DISTINCT concat(word, mark) AS rule, word, mark FROM
        (SELECT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS word FROM benchmark) CROSS JOIN (SELECT unnest([',', '.', ';']) AS mark)"""


@query(
    "T1_rule_table",
    f"""WITH rules AS ({_WORD_RULES}),
        found AS (SELECT DISTINCT project, path, line_no, unnest(regexp_extract_all(text, '[a-z]+[,.;]')) AS rule FROM p_lines)
        SELECT rule, path, count(*) AS n_lines FROM found JOIN rules USING (rule) GROUP BY rule, path""",
)
def _(t):
    # Three rules for each word of the benchmark: the word, whole, before a mark.
    words = t.table("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{3,})"), F.lit(1))).alias("word")).distinct()
    marked = words.select("word", F.explode(F.array(F.lit(","), F.lit("."), F.lit(";"))).alias("mark"))
    literal = F.concat("word", "mark")
    regex = F.concat(F.lit("(^|[^a-z])"), "word", F.lit("["), "mark", F.lit("]"))
    rules = marked.select(literal.alias("rule"), literal.alias("literal"), regex.alias("regex"))
    found = rule_table.rule_table_scan(t.view("p_lines"), rules)
    return found.groupBy("rule", "path").agg(F.count("*").alias("n_lines"))


@query(
    "T2_todo_scan",
    r"""WITH k AS (SELECT path, line_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS comment, regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+') AS w FROM p_lines)
        SELECT path, line_no, CASE WHEN list_contains(w, 'license') THEN 'LICENSE' WHEN list_contains(w, 'and') THEN 'AND' ELSE 'UND' END AS kind, comment
        FROM k WHERE list_contains(w, 'license') OR list_contains(w, 'and') OR list_contains(w, 'und')""",
)
def _(t):
    return text_rules.todo_scan(t.view("p_lines"), ["license", "and", "und"], comments_only=False)


@query(
    "T3_secret_scan",
    r"""WITH a AS (SELECT project, path, line_no, regexp_extract_all(text, '(?i)([\p{L}_][\p{L}\p{N}_]*)\s*=\s*"([^"]*)"') AS hits FROM p_lines WHERE contains(text, '"')),
        h AS (SELECT project, path, line_no, unnest(hits) AS hit FROM a),
        s AS (SELECT *, regexp_extract(hit, '^([\p{L}_][\p{L}\p{N}_]*)', 1) AS name, regexp_extract(hit, '"([^"]*)"', 1) AS v FROM h)
        SELECT project, path, line_no, 'HardcodedSecret' AS class, name, 'credential name' AS reason FROM s
          WHERE regexp_matches(name, '(?i)password|passwd|secret|api_?key|token|credential|passphrase') AND length(v) > 3
        UNION ALL SELECT project, path, line_no, 'HardcodedSecretValue', name, 'high-entropy secret value' FROM s
          WHERE regexp_matches(name, '(?i)token|secret') AND length(v) > 30 AND NOT contains(v, ' ') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
        UNION ALL SELECT project, path, line_no, 'SecretInComment', NULL, 'mark of a secret' FROM p_lines
          WHERE regexp_matches(text, '(?i)(//|/\*).*(password|secret|apikey|api_key|token|bearer|sk-live-|sk-test-)')""",
)
def _(t):
    return text_rules.secret_scan(t.view("p_lines"))


@query(
    "T4_path_literals",
    """SELECT page_id, value FROM (SELECT page_id, unnest(regexp_extract_all(html, '"([^"]*)"', 1)) AS value FROM p_page_links)
        WHERE contains(value, ':\\') OR contains(value, '/') OR starts_with(value, '\\\\')""".replace("\\\\", "\\"),
)
def _(t):
    return text_rules.path_literals(_page_literals(t))


def _page_literals(t):
    literals = F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))
    return t.view("p_page_links").select("page_id", F.explode(literals).alias("value"))


@query(
    "T5_redos_scan",
    r"""SELECT page_id, value, 'nested_quantifier' AS signal, value AS shown FROM (SELECT page_id, concat('(', split_part(url, '/', 3), '+)*') AS value FROM pages WHERE contains(url, '?'))
        UNION ALL SELECT page_id, value, 'adjacent_wildcards', value FROM (SELECT page_id, concat('.*.*', CAST(page_id AS VARCHAR)) AS value FROM pages WHERE NOT contains(url, '?') AND contains(url, 'https'))""",
)
def _(t):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    value = (
        F.when(F.contains("url", F.lit("?")), F.concat(F.lit("("), host, F.lit("+)*")))
        .when(F.contains("url", F.lit("https")), F.concat(F.lit(".*.*"), F.col("page_id").cast("string")))
        .otherwise(F.concat(F.lit("[a-z]+"), F.col("page_id").cast("string")))
    )
    return text_rules.redos_scan(t.table("pages").select("page_id", value.alias("value")))


@query(
    "T6_naming_violations",
    """SELECT symbol_id, name, CASE WHEN kind = 'field' THEN 'private_field' ELSE 'method' END AS rule FROM p_symbols WHERE
        (kind = 'field' AND accessibility = 'private' AND NOT list_contains(modifiers, 'static') AND NOT regexp_matches(name, '^_[a-z]'))
        OR (kind = 'method' AND accessibility IN ('public', 'internal') AND regexp_matches(name, '^[a-z]'))
        UNION ALL SELECT symbol_id, name, 'parameter' FROM p_params WHERE regexp_matches(name, '^[A-Z]')""",
)
def _(t):
    return text_rules.naming_violations(t.view("p_symbols"), t.view("p_params"))


@query(
    "T7_async_suffix_violations",
    """WITH h AS (SELECT symbol_id FROM p_params GROUP BY 1 HAVING count(*) = 2 AND bool_or(ord = 2 AND contains(type, 'EventArgs')))
        SELECT symbol_id, name, CASE WHEN a THEN 'missing_suffix' ELSE 'needless_suffix' END AS rule FROM (
          SELECT *, list_contains(modifiers, 'async') OR starts_with(return_type, 'Task<') AS a FROM p_symbols)
        WHERE kind = 'method' AND NOT starts_with(name, 'On') AND a <> (name LIKE '%Async') AND symbol_id NOT IN (SELECT symbol_id FROM h)""",
)
def _(t):
    handlers = text_rules.event_handlers(t.view("p_params"))
    return text_rules.async_suffix_violations(t.view("p_symbols"), handlers).select("symbol_id", "name", "rule")


_RANKS = ["Error", "Warning", "Info", "Hidden"]


@query(
    "T9_dedupe_rank",
    """SELECT project, detector AS kind, score AS line, member, risk, event_id FROM (
        SELECT *, severity AS risk, row_number() OVER (PARTITION BY detector, score, member ORDER BY event_id) AS rn FROM p_findings) WHERE rn = 1""",
)
def _(t):
    return text_rules.dedupe_rank(_risks(t), _RANKS).select("project", "kind", "line", "member", "risk", "event_id")


@query(
    "T9_risk_counts",
    """SELECT risk, count(*) AS n_findings FROM (SELECT DISTINCT detector, score, member, severity AS risk FROM p_findings) GROUP BY 1""",
)
def _(t):
    return text_rules.risk_counts(_risks(t), _RANKS)


def _risks(t):
    return t.view("p_findings").select(
        "event_id",
        "project",
        F.col("detector").alias("kind"),
        F.col("score").alias("line"),
        "member",
        F.col("severity").alias("risk"),
    )


# --- snapshots ----------------------------------------------------------------------


@query(
    "D1_breaking_changes",
    """WITH gone AS (SELECT b.* FROM p_api_base b LEFT JOIN p_api_cur c ON c.container = b.container AND c.signature = b.signature WHERE c.kind IS NULL),
        types AS (SELECT DISTINCT container FROM p_api_cur WHERE kind = 'Type')
        SELECT CASE WHEN kind = 'Type' AND t.container IS NULL THEN 'TypeRemoved' WHEN kind = 'Type' THEN 'TypeSignatureChanged' ELSE 'MemberRemovedOrRenamed' END AS change,
          gone.container, signature FROM gone LEFT JOIN types t ON t.container = gone.container WHERE kind = 'Type' OR t.container IS NOT NULL""",
)
def _(t):
    return snapshots.breaking_changes(t.view("p_api_base"), t.view("p_api_cur"))


_API_HISTORY = """
        s AS (SELECT DISTINCT container, signature, snapshot FROM p_api_snapshots),
        k AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS nth FROM (SELECT DISTINCT snapshot FROM s)),
        i AS (SELECT container, signature, s.snapshot, nth, nth - row_number() OVER (PARTITION BY container, signature ORDER BY nth) AS island
          FROM s JOIN k ON k.snapshot = s.snapshot),
        spans AS (SELECT container, signature, min(snapshot) AS valid_from, max(nth) AS last, count(*) AS n_snapshots FROM i GROUP BY container, signature, island),
        history AS (SELECT container, signature, valid_from, k.snapshot AS valid_to, n_snapshots FROM spans LEFT JOIN k ON k.nth = spans.last + 1)"""


@query("D1_api_history", f"WITH {_API_HISTORY.strip()} SELECT * FROM history")
def _(t):
    return snapshots.api_history(t.view("p_api_snapshots"))


@query(
    "D2_as_of",
    f"""WITH {_API_HISTORY.strip()}
        SELECT l_orderkey, l_linenumber, l_partkey, p.at, valid_from, valid_to, valid_from IS NOT NULL AND (valid_to IS NULL OR p.at < valid_to) AS is_valid
        FROM p_api_probes p ASOF LEFT JOIN history h ON p.container = h.container AND p.signature = h.signature AND p.at >= h.valid_from""",
)
def _(t):
    history = snapshots.api_history(t.view("p_api_snapshots")).drop("n_snapshots")
    found = snapshots.as_of(t.view("p_api_probes"), history)
    since, upto = F.col("found.valid_from"), F.col("found.valid_to")
    valid = since.isNotNull() & (upto.isNull() | (F.col("at") < upto))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "at", since.alias("valid_from"), upto.alias("valid_to"), valid.alias("is_valid"))


@query(
    "D2_content_drift",
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM p_snap_a a FULL JOIN p_snap_b b ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content""",
)
def _(t):
    return snapshots.content_drift(t.view("p_snap_a"), t.view("p_snap_b"))


@query(
    "D3_bulk_rewrite",
    r"""WITH m AS (SELECT path, content, concat(chr(1), regexp_replace(content, '([^\p{L}\p{N}_]+)', concat(chr(1), '\1', chr(1)), 'g'), chr(1)) AS x FROM p_files),
        r AS (SELECT path, content, (length(x) - length(replace(x, concat(chr(1), 'the', chr(1)), ''))) // 5 AS n1,
          replace(replace(x, concat(chr(1), 'the', chr(1)), concat(chr(1), 'THE', chr(1))), chr(1), '') AS y FROM m),
        s AS (SELECT path, n1, len(regexp_extract_all(y, '[0-9]+@')) AS n2, regexp_replace(y, '[0-9]+@', 'N@', 'g') AS z FROM r)
        SELECT path, n1 + n2 AS replacements, md5(z) AS digest, 'Succeeded' AS outcome FROM s WHERE n1 + n2 > 0""",
)
def _(t):
    rules = [("rename", "the", "THE"), ("regex", "[0-9]+@", "N@")]
    rewritten = snapshots.bulk_rewrite(t.view("p_files").drop("doc_id"), rules)
    return rewritten.select("path", "replacements", F.md5("new_content").alias("digest"), "outcome")


@query(
    "D3_dry_run_and_snapshot",
    r"""SELECT path, len(regexp_extract_all(content, '[0-9]+@')) AS replacements, CASE WHEN regexp_replace(content, '[0-9]+@', '7@', 'g') = content
          THEN 'AlreadySatisfied' ELSE 'Succeeded' END AS outcome, md5(regexp_replace(content, '[0-9]+@', '7@', 'g')) AS next_digest
        FROM p_files WHERE regexp_matches(content, '[0-9]+@')
        UNION ALL SELECT path, NULL, NULL, md5(content) FROM p_files WHERE NOT regexp_matches(content, '[0-9]+@')""",
)
def _(t):
    files = t.view("p_files").drop("doc_id")
    rules = [("regex", "[0-9]+@", "7@")]
    path = scratch_path(t.spark, "snapshot")
    snapshots.write_snapshot(snapshots.bulk_rewrite(files, rules), files, path)
    planned = snapshots.bulk_rewrite(files, rules, dry_run=True).select("path", "replacements", "outcome")
    written = t.spark.read.parquet(path).select("path", F.md5("content").alias("next_digest"))
    return written.join(planned, "path", "left")


@query(
    "D4_line_diff",
    """WITH a AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, unnest(string_split(content, chr(10))) AS removed FROM p_snap_a),
        b AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, unnest(string_split(content, chr(10))) AS added FROM p_snap_b)
        SELECT coalesce(a.path, b.path) AS path, coalesce(a.line_no, b.line_no) AS line_no, removed, added
        FROM a FULL JOIN b ON a.path = b.path AND a.line_no = b.line_no WHERE removed IS DISTINCT FROM added""",
)
def _(t):
    return snapshots.line_diff(t.view("p_snap_a"), t.view("p_snap_b"))


# --- outcomes -----------------------------------------------------------------------


@query(
    "O1_outcome_summary",
    """SELECT *, CASE WHEN attempted = 0 THEN 'NothingToDo' WHEN failed + blocked = 0 AND already_satisfied = 0 AND succeeded > 0 THEN 'CompletedFully'
          WHEN failed + blocked = 0 AND already_satisfied > 0 THEN 'CompletedWithNoOps' WHEN failed + blocked > 0 AND succeeded > 0 THEN 'PartialProgress'
          WHEN failed + blocked > 0 THEN 'NoProgress' ELSE 'NothingToDo' END AS outcome FROM (
        SELECT concat(change_id, '/', CAST(member AS VARCHAR)) AS change_id, count(CASE WHEN outcome = 'Succeeded' THEN 1 END) AS succeeded, count(CASE WHEN outcome = 'AlreadySatisfied' THEN 1 END) AS already_satisfied,
          count(CASE WHEN outcome = 'Skipped' THEN 1 END) AS skipped, count(CASE WHEN outcome = 'Failed' THEN 1 END) AS failed,
          count(CASE WHEN outcome = 'Blocked' THEN 1 END) AS blocked, count(*) AS attempted FROM p_outcomes GROUP BY 1)""",
)
def _(t):
    change = F.concat_ws("/", "change_id", F.col("member").cast("string"))
    return outcomes.outcome_summary(t.view("p_outcomes").withColumn("change_id", change))


@query(
    "O1_failure_sample",
    """SELECT change_id, event_id, reason, row_number() OVER (PARTITION BY change_id ORDER BY event_id) AS sample_no FROM p_outcomes
        WHERE outcome IN ('Failed', 'Blocked') QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY event_id) <= 10""",
)
def _(t):
    sample = outcomes.failure_sample(t.view("p_outcomes"), ["event_id"])
    return sample.select("change_id", "event_id", "reason", "sample_no")


@query(
    "O1_reason_counts",
    "SELECT change_id, reason, count(*) AS n_failures FROM p_outcomes WHERE outcome IN ('Failed', 'Blocked') GROUP BY 1, 2",
)
def _(t):
    return outcomes.reason_counts(t.view("p_outcomes"))


@query(
    "O2_ledger",
    """SELECT path, member, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS hits FROM p_outcomes
        GROUP BY 1, 2 HAVING count(*) > 1 AND bool_or(starts_with(reason, 'phase:bridge'))""",
)
def _(t):
    rows = t.view("p_outcomes").withColumn("phase", outcomes.phase_of(F.col("reason")))
    return outcomes.ledger(rows, phase="bridge", repeated_only=True)


@query(
    "O2_ledger_totals",
    """SELECT count(*) AS total_entries, CAST(sum(n) AS BIGINT) AS total_operations, count(CASE WHEN n > 1 THEN 1 END) AS repeated_keys FROM (
        SELECT count(*) AS n FROM p_outcomes GROUP BY path, member)""",
)
def _(t):
    return outcomes.ledger_totals(t.view("p_outcomes"))


@query(
    "O2_ledger_operations",
    """SELECT path, member, event_id, outcome, row_number() OVER (PARTITION BY path, member ORDER BY ts, event_id) AS operation_no FROM p_outcomes""",
)
def _(t):
    rows = outcomes.ledger_operations(t.view("p_outcomes"), order=("ts", "event_id"))
    return rows.select("path", "member", "event_id", "outcome", "operation_no")


@query(
    "O3_operation_detail",
    """SELECT event_id, member, path, outcome, count(*) OVER () AS total_items, count(*) OVER () > 20 AS has_more FROM p_outcomes
        WHERE change_id = '2024-01-05' AND outcome = 'Failed' ORDER BY path, member, event_id LIMIT 20""",
)
def _(t):
    rows = outcomes.operation_detail(t.view("p_outcomes"), "2024-01-05", "errors", 20, ("path", "member", "event_id"))
    return rows.select("event_id", "member", "path", "outcome", "total_items", "has_more")


@query(
    "O3_operations_of_file",
    """SELECT event_id, member, path, outcome, count(*) OVER () AS total_items, count(*) OVER () > 15 AS has_more FROM p_outcomes
        WHERE change_id = '2024-01-09' AND contains(path, 'src/3') ORDER BY path, member, event_id LIMIT 15""",
)
def _(t):
    rows = outcomes.operation_detail(t.view("p_outcomes"), "2024-01-09", "file:SRC/3", 15, ("path", "member", "event_id"))
    return rows.select("event_id", "member", "path", "outcome", "total_items", "has_more")


_BREAKER = """WITH a AS (SELECT *, sum(succeeded + failed + rolled_back + skipped) OVER w AS attempts, sum(failed + rolled_back) OVER w AS failures,
          sum(2 * rolled_back + failed) OVER w AS score, sum(CASE WHEN succeeded = 0 AND failed + rolled_back > 0 THEN 1 ELSE 0 END) OVER w AS f
          FROM p_batches WINDOW w AS (PARTITION BY session ORDER BY batch_no)),
        b AS (SELECT *, f - max(CASE WHEN succeeded > 0 THEN f ELSE 0 END) OVER (PARTITION BY session ORDER BY batch_no) AS streak, failures / attempts AS rate FROM a),
        c AS (SELECT *, bool_or(streak >= 8 OR (attempts >= 20 AND rate > 0.30) OR score > 20) OVER (PARTITION BY session ORDER BY batch_no) AS open FROM b)
        SELECT session, batch_no, succeeded, failed, rolled_back, skipped, CAST(attempts AS BIGINT) AS attempts, CAST(failures AS BIGINT) AS failures,
          CAST(score AS BIGINT) AS score, CAST(streak AS BIGINT) AS streak, round(rate * 100, 1) AS failure_rate_pct, open,
          CASE WHEN open THEN 'halt' WHEN streak >= 4 OR (attempts >= 10 AND rate >= 0.15) OR score >= 10 THEN 'caution' ELSE 'ok' END AS severity FROM c"""


@query("O4_breaker_status", _BREAKER)
def _(t):
    return outcomes.breaker_status(t.view("p_batches"))


_BREAKER_RESETS = """WITH e AS (SELECT *, sum(CASE WHEN rolled_back > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY batch_no) AS epoch FROM p_batches),
        a AS (SELECT *, sum(succeeded + failed + rolled_back + skipped) OVER w AS attempts, sum(failed + rolled_back) OVER w AS failures,
          sum(2 * rolled_back + failed) OVER w AS score, sum(CASE WHEN succeeded = 0 AND failed + rolled_back > 0 THEN 1 ELSE 0 END) OVER w AS f
          FROM e WINDOW w AS (PARTITION BY session, epoch ORDER BY batch_no)),
        b AS (SELECT *, f - max(CASE WHEN succeeded > 0 THEN f ELSE 0 END) OVER (PARTITION BY session, epoch ORDER BY batch_no) AS streak, failures / attempts AS rate FROM a),
        c AS (SELECT *, bool_or(streak >= 8 OR (attempts >= 20 AND rate > 0.30) OR score > 20) OVER (PARTITION BY session, epoch ORDER BY batch_no) AS open FROM b)
        SELECT session, batch_no, succeeded, failed, rolled_back, skipped, rolled_back > 1 AS reset, CAST(attempts AS BIGINT) AS attempts, CAST(failures AS BIGINT) AS failures,
          CAST(score AS BIGINT) AS score, CAST(streak AS BIGINT) AS streak, round(rate * 100, 1) AS failure_rate_pct, open,
          CASE WHEN open THEN 'halt' WHEN streak >= 4 OR (attempts >= 10 AND rate >= 0.15) OR score >= 10 THEN 'caution' ELSE 'ok' END AS severity FROM c"""


@query("O5_breaker_stream", _BREAKER_RESETS)
def _(t):
    """The batches arrive in two parts, and the stream is stopped between them: it goes on from
    the state it kept. Batches that roll back more than once are manual resets."""
    arrivals, out, progress = (scratch_path(t.spark, name) for name in ("arrivals", "breaker", "progress"))
    batches = t.view("p_batches").withColumn("reset", F.col("rolled_back") > 1)
    early = F.col("batch_no") < "2024-01-15"
    for part in (early, ~early):
        batches.where(part).write.mode("append").parquet(arrivals)
        stream = t.spark.readStream.schema(batches.schema).parquet(arrivals)
        jobs.breaker_stream(stream, out, progress).awaitTermination()
    return t.spark.read.parquet(out)


def _calls(t):
    return t.view("p_calls").withColumn("ts", utc(F.col("ts")))


@query(
    "O6_call_counts",
    """WITH c AS (SELECT *, epoch_us(ts) AS us FROM p_calls)
        SELECT tool, event_id, count(*) OVER (PARTITION BY tool ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - 1 AS calls_before,
          CAST(CASE tool WHEN 'error' THEN 2 ELSE 6 END AS BIGINT) AS "limit",
          count(*) OVER (PARTITION BY tool ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - 1 >= CASE tool WHEN 'error' THEN 2 ELSE 6 END AS over_limit FROM c""",
)
def _(t):
    counted = outcomes.call_counts(_calls(t), {"error": 2}, 6, 3600)
    return counted.select("tool", "event_id", "calls_before", "limit", "over_limit")


_ACCEPTED = """WITH c AS (SELECT tool, event_id, epoch_us(ts) AS us, CASE tool WHEN 'error' THEN 2 ELSE 6 END AS lim,
          row_number() OVER (PARTITION BY tool ORDER BY ts, event_id) AS rn FROM p_calls),
        r AS (SELECT tool, rn, event_id, true AS accepted, [us] AS seen FROM c WHERE rn = 1
          UNION ALL SELECT c.tool, c.rn, c.event_id, len(list_filter(r.seen, lambda x: x >= c.us - 3600000000)) < c.lim,
            CASE WHEN len(list_filter(r.seen, lambda x: x >= c.us - 3600000000)) < c.lim THEN list_append(list_filter(r.seen, lambda x: x >= c.us - 3600000000), c.us)
              ELSE list_filter(r.seen, lambda x: x >= c.us - 3600000000) END
          FROM r JOIN c ON c.tool = r.tool AND c.rn = r.rn + 1)
        SELECT tool, event_id, accepted FROM r"""


@query(
    "O6_rate_limit",
    _ACCEPTED,
)
def _(t):
    return outcomes.rate_limit(_calls(t), {"error": 2}, 6, 3600).select("tool", "event_id", "accepted")


@query("O6_rate_limit_stream", _ACCEPTED)
def _(t):
    """The calls arrive in three parts, and the stream is stopped after each: it goes on with the
    accepted calls that it kept."""
    arrivals, out, progress = (scratch_path(t.spark, name) for name in ("calls", "decided", "progress"))
    calls = _calls(t)
    day = F.to_date("ts")
    for part in (day < "2024-01-11", (day >= "2024-01-11") & (day < "2024-01-21"), day >= "2024-01-21"):
        calls.where(part).write.mode("append").parquet(arrivals)
        stream = t.spark.readStream.schema(calls.schema).parquet(arrivals)
        with rocksdb(t.spark):
            jobs.append_to_parquet(limits.rate_limit_stream(stream, {"error": 2}, 6, 3600), out, progress).awaitTermination()
    return t.spark.read.parquet(out).select("tool", "event_id", "accepted")


@query(
    "O7_debounce_changes",
    """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS batch FROM g)
        SELECT user_id, min(us) AS start, max(us) + 1800000000 AS "end", count(*) AS n_changes FROM s GROUP BY user_id, batch
        HAVING max(us) + 1800000000 <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 - 10000000 FROM events)""",
)
def _(t):
    stream = jobs.debounce_changes(
        _event_stream(t).withColumn("path", F.lit("src/a.cs")), "30 minutes", "10 seconds", ("user_id",)
    )
    return jobs.run_to_table(stream, "debounced")


def _event_stream(t):
    shared_dir(t.spark)
    events = t.stream("events")
    return events.withColumn("ts", utc(F.col("ts")))


@query(
    "O8_route_failures",
    """SELECT event_id, outcome, CASE outcome WHEN 'Failed' THEN 'slot' WHEN 'Blocked' THEN 'handle' WHEN 'Skipped' THEN 'orphan' END AS tag,
        CASE outcome WHEN 'Failed' THEN 'alpha' WHEN 'Blocked' THEN 'gamma' END AS suggested_tool FROM p_outcomes""",
)
def _(t):
    tags = t.spark.createDataFrame(
        [("Failed", "slot"), ("Blocked", "handle"), ("Skipped", "orphan")], "reason STRING, tag STRING"
    )
    producers = t.spark.createDataFrame(
        [("slot", "beta", 5), ("slot", "alpha", 5), ("slot", "zeta", 1), ("handle", "gamma", 9), ("handle", "alpha", 3)],
        "tag STRING, tool STRING, weight INT",
    )
    failures = t.view("p_outcomes").select("event_id", "outcome", F.col("outcome").alias("reason"))
    return outcomes.route_failures(failures, tags, producers).drop("reason")


@query(
    "O9_phase_breakdown",
    """SELECT regexp_extract(reason, '^phase:([a-z]+)', 1) AS phase,
          count(CASE WHEN outcome = 'Succeeded' THEN 1 END) AS "Succeeded", count(CASE WHEN outcome = 'AlreadySatisfied' THEN 1 END) AS "AlreadySatisfied",
          count(CASE WHEN outcome = 'Skipped' THEN 1 END) AS "Skipped", count(CASE WHEN outcome = 'Failed' THEN 1 END) AS "Failed",
          count(CASE WHEN outcome = 'Blocked' THEN 1 END) AS "Blocked", count(CASE WHEN outcome = 'RolledBack' THEN 1 END) AS "RolledBack",
          count(CASE WHEN outcome = 'NeedsManualReview' THEN 1 END) AS "NeedsManualReview",
          count(CASE WHEN contains(lower(reason), 'below minscore') THEN 1 END) AS below_threshold,
          count(CASE WHEN contains(lower(reason), 'already flagged') THEN 1 END) AS already_flagged,
          count(CASE WHEN contains(lower(reason), 'validation') THEN 1 END) AS compiler_error,
          count(CASE WHEN contains(lower(reason), 'event handler') THEN 1 END) AS event_handler FROM p_outcomes GROUP BY 1""",
)
def _(t):
    return outcomes.phase_breakdown(t.view("p_outcomes"))


@query(
    "O10_ledger_stream",
    """SELECT epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS window_start, user_id, count(*) AS hits, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen
        FROM events GROUP BY CAST(ts AS DATE), user_id
        HAVING epoch_us(CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP)) <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 - 3600000000 FROM events)""",
)
def _(t):
    return jobs.run_to_table(jobs.ledger_stream(_event_stream(t), ("user_id",)), "ledger")


@query("O11_rescan_changed_stream", _RULE_SCAN)
def _(t):
    shared_dir(t.spark)
    documents = t.stream("documents")
    # The columns of p_files, on the stream.
    ending = F.when(F.col("lang") == "de", "Tests").otherwise("")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ending, F.lit(".txt"))
    files = documents.select(F.col("source").alias("project"), path.alias("path"), F.col("text").alias("content"))
    return jobs.run_to_table(jobs.rescan_changed(files, [*RULES, *PROSE_RULES]), "rescan")


@query(
    "O11_replaced_findings",
    _RULE_SCAN.replace("FROM p_lines", "FROM (SELECT project, path, line_no, CASE WHEN contains(path, '/en/') THEN replace(text, '@', ' at ') WHEN contains(path, '/fr/') THEN concat(text, ' x@y.z') ELSE text END AS text FROM p_lines) AS changed"),
)
def _(t):
    """All files come, then come again with two languages changed, then once more unchanged: the
    findings are those of the last versions."""
    arrivals, store, progress = (scratch_path(t.spark, name) for name in ("versions", "findings-store", "progress"))
    files = t.view("p_files").select("project", "path", "content")
    lines = F.split("content", "\n", -1)
    marked = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit(" x@y.z"))), "\n")
    changed = F.when(F.contains("path", F.lit("/en/")), F.replace("content", F.lit("@"), F.lit(" at "))).when(F.contains("path", F.lit("/fr/")), marked)
    for version, content in enumerate([F.col("content"), *[F.coalesce(changed, "content")] * 2]):
        files.select("project", "path", content.alias("content"), F.lit(version).cast("long").alias("version")).write.mode("append").parquet(arrivals)
        stream = t.spark.readStream.schema(t.spark.read.parquet(arrivals).schema).parquet(arrivals)
        rescan.rescan_replaced(stream, store, progress, rescan.scan_versions([*RULES, *PROSE_RULES])).awaitTermination()
    return rescan.current_findings(t.spark, store)
