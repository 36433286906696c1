"""The queries over the driver's tables, one per operator, each a thin layer over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm import centroids, chat, decontam, html, minhash, packing, periodic, quality, simhash, tokencount, tokenfile, toxicity, warc
from codescope.llm.shared import table
from codescope.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), back=["doc_id"])
    return judged.select(
        "row.doc_id",
        *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
    )


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    tokenfile.write(tokenfile.encode(table(spark, sf_dir, "documents")), path)
    return tokenfile.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


HELD_OUT = "coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)"
TOXIC_FROM = 0.3


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(f"NOT {HELD_OUT}")
    scored = toxicity.assess(table(spark, sf_dir, "documents"), labels, back=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it, with the nearest passage."""
    found = decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), back=["doc_id"])
    each = found.select("row.doc_id", F.explode("matches").alias("m"))
    best = each.groupBy("doc_id", "m.item").agg(F.min(F.struct("m.edits", "m.start", "m.end")).alias("best"), F.count("*").alias("n_passages"))
    return best.select("doc_id", F.col("item").alias("item_id"), "best.start", "best.end", "best.edits", "n_passages")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(warc.records(table(spark, sf_dir, "pages")), path)
    captures = warc.assemble(warc.read(spark, path))
    fields = F.col("metadata.block")
    revisit = F.col("response.record_type") == "revisit"
    return captures.select(
        warc.field(fields, "page-id").cast("long").alias("page_id"),
        F.when(revisit, warc.field(fields, "payload-length").cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("response.payload_digest", ":", -1)).otherwise(F.col("response.payload_sha1")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        warc.field(fields, "refers-to-page").cast("long").alias("refers_to"),
        F.col("response.target_uri").alias("url"),
    )


ORACLES["op3_warc"] = """
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), k AS (
    SELECT html, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY html
), m AS (
    SELECT p.*, CASE WHEN page_id < kept THEN kept END AS refers_to FROM p LEFT JOIN k USING (html)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url
FROM m
"""


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "tokens.n_words", "tokens.n_pieces")


# How turns look in transcripts: {role}, {Role} and {text} are filled in. The last has no marker.
STYLES = ["{Role}: {text}", "### {Role}\n{text}\n", "**{Role}:** {text}\n", "[{role}] {text}", "<|im_start|>{role}\n{text}", "{text}\n"]


def as_transcript(turns: DataFrame) -> DataFrame:
    """``turns`` with ``line``: the turn as a transcript would show it, in a style by conversation."""
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (F.crc32(F.col("conv_id").cast("string")) % len(STYLES) + 1).cast("int"))
    shown = F.replace(F.replace(F.coalesce(style, F.lit(STYLES[0])), F.lit("{role}"), F.coalesce("role", F.lit(""))), F.lit("{Role}"), F.initcap(F.coalesce("role", F.lit(""))))
    return turns.withColumn("line", F.replace(shown, F.lit("{text}"), F.coalesce("text", F.lit(""))))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns recovered from every conversation's transcript; the model learns from the
    conversations whose crc32(conv_id as text) mod 4 is not 2."""
    shown = as_transcript(table(spark, sf_dir, "conversations"))
    taught = shown.where("coalesce(crc32(cast(conv_id AS string)) % 4 <> 2, false)")
    model = chat.fit(taught, "conv_id", "turn", F.col("line"), F.col("role"))
    turns = chat.parse(shown, model, "conv_id", "turn", F.col("line"))
    return turns.withColumn("conv_id", F.col("key").cast("long")).drop("key")


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(centroids.cluster(table(spark, sf_dir, "embeddings")))


_NUMBERS = """kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM kept
    QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16
)"""
# Squared distances to all centroids; the least pair (distance, number) is the assignment.
_NEAREST = """a{0} AS MATERIALIZED (
    SELECT vec_id, v, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c := c)) AS near
    FROM kept CROSS JOIN c{0} GROUP BY vec_id, v
)"""
_MEANS = """s{0} AS (
    SELECT near.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{0} CROSS JOIN range(1, 65) AS r(i) GROUP BY 1, 2
), c{1} AS MATERIALIZED (
    SELECT old.c, coalesce(new.m, old.m) AS m FROM c{0} AS old
    LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{0} GROUP BY c) AS new ON new.c = old.c
)"""
_ROUNDS = ",\n".join([_NUMBERS, *[_NEAREST.format(i) + ",\n" + _MEANS.format(i, i + 1) for i in range(3)], _NEAREST.format(3)])
ORACLES["op11_centroids"] = f"""
WITH {_ROUNDS}
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, near.d AS distance,
       CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = near.c
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic end in a tenth of the texts: where crc32(doc_id as text) = h ends
    in 0, the words from a on are the first p of them over and over; g = h div 10, n words,
    a = g mod n, p = 1 + (n - a) div (3 + g mod 8)."""
    chosen = docs.withColumns({"_h": F.crc32(F.col("doc_id").cast("string")), "_w": F.expr("CASE WHEN crc32(cast(doc_id AS string)) % 10 = 0 THEN filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '') END")})
    placed = chosen.withColumns({"_n": F.expr("nullif(size(_w), 0)"), "_g": F.expr("_h div 10")}).withColumn("_a", F.expr("cast(_g % _n AS int)"))
    sized = placed.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) AS int)"))
    again = "slice(flatten(array_repeat(slice(_w, _a + 1, _p), cast(ceil((_n - _a) / _p) AS int))), 1, _n - _a)"
    text = F.expr(f"CASE WHEN _n > 0 THEN array_join(concat(slice(_w, 1, _a), {again}), ' ') ELSE text END")
    return sized.withColumn("text", text).drop("_h", "_w", "_n", "_g", "_a", "_p")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.with_runs(planted).withColumn("best", periodic.greatest_run(F.col("runs")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.components(table(spark, sf_dir, "documents"), width=3, similarity=(85, 100))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept)


ORACLES["op12_minhash"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS MATERIALIZED (SELECT s.doc_id, hash(shingle) AS shingle, n FROM s JOIN n USING (doc_id)),
links AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y FROM sized AS a JOIN sized AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, y FROM reach JOIN links ON x = other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
