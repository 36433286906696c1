"""WARC archives and their transactions (operator 3).

Archives are written and read by Spark's text source with the record boundary as the line
separator: one archive a task, committed as a whole, compressed, and read record by record. A
block that holds the boundary itself is cut inside it into segments, as the format allows, so
reading back is exact.

``assemble`` joins request, response (or revisit) and metadata records through their
concurrent-to identifiers and gives one nested row per capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.shared import written

NL = "\r\n"
VERSION = "WARC/1.1"
END = NL * 2
BOUNDARY = f"{END}{VERSION}{NL}"
MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ["response", "revisit", "resource"]


# --- writing ------------------------------------------------------------------------


def _record_id(kind: str, *parts: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line breaks in a value are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(NL)), F.lit(""))


def _record(kind: Column | str, record_id: Column, block: Column, headers: dict[str, Column]) -> Column:
    """The record as text, without the boundary after it; several if the block holds one."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    cut = F.split(block, "(?<=\r\n\r\nWA)(?=RC/1\\.1\r\n)")
    segments = F.when(F.contains(block, F.lit(BOUNDARY)), cut).otherwise(F.array(block))
    lines = F.concat(*[_line(k, v) for k, v in headers.items()])

    def segment(part: Column, i: Column) -> Column:
        many = F.size(segments) > 1
        number = F.when(many, i + 1)
        first = i == 0
        own = F.when(first, record_id).otherwise(_record_id("segment", record_id, i))
        head = F.concat(
            F.lit(f"{VERSION}{NL}"),
            _line("WARC-Type", F.when(first, kind).otherwise(F.lit("continuation"))),
            _line("WARC-Record-ID", own),
            F.when(first, lines).otherwise(_line("WARC-Segment-Origin-ID", record_id)),
            _line("WARC-Segment-Number", number),
            _line("WARC-Segment-Total-Length", F.when(many & (i + 1 == F.size(segments)), F.octet_length(block))),
            _line("Content-Length", F.octet_length(part)),
        )
        return F.concat(head, F.lit(NL), part)

    return F.array_join(F.transform(segments, segment), END)


def with_revisits(pages: DataFrame, id_col: str, payload: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add digest, n_bytes and refers_to: of the rows with equal payloads of at least
    ``min_bytes``, the others refer to the largest id. Rows without an id refer to none and are
    referred to by none; rows that repeat the largest id are not revisits."""
    content = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    hashed = pages.withColumn("digest", F.sha1(content)).withColumn("n_bytes", F.octet_length(content).cast("long"))
    long = hashed.where(F.col("n_bytes") >= min_bytes)
    kept = long.groupBy("digest").agg(F.max(F.struct(id_col, "url")).alias("kept"), F.count(id_col).alias("n")).where("n > 1")
    # Written, so that a digest with many rows is a join's skewed side and can be split.
    kept = written(kept.select("digest", F.col(f"kept.{id_col}").alias("kept_id"), F.col("kept.url").alias("kept_url")), "payloads")
    out = hashed.join(kept, "digest", "left")
    older = (F.col("n_bytes") >= min_bytes) & (F.col(id_col) < F.col("kept_id"))
    return out.withColumn("refers_to", F.when(older, F.col("kept_id"))).withColumn("kept_url", F.when(older, F.col("kept_url"))).drop("kept_id")


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value): for every row of ``pages`` (page_id, url, html) its request, response or revisit,
    and metadata records as one text. Null html is an empty payload."""
    read = pages.select("page_id", "url", "html")
    marked = with_revisits(read, "page_id", "html")
    html = F.coalesce("html", F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    ident = lambda kind: _record_id(kind, F.col("page_id"), F.col("url"), F.col("digest"))
    marked = marked.withColumns({k: ident(k) for k in ("response", "request", "metadata")})
    common = {"WARC-Target-URI": F.col("url"), "WARC-Date": F.lit(date)}
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    host = F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://([^/\\s]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://[^/\\s]*(/\\S*)", 1), F.lit(""))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    request = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{NL}Host: "), host, F.lit(END))
    fields = F.concat(_line("page-id", F.col("page_id")), _line("payload-length", F.col("n_bytes")), _line("refers-to-page", F.col("refers_to")))
    reply_headers = common | {
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
        "WARC-Profile": F.when(revisit, F.lit(PROFILE)),
        "WARC-Refers-To": F.when(revisit, _record_id("response", F.col("refers_to"), F.col("kept_url"), F.col("digest"))),
        "WARC-Refers-To-Target-URI": F.col("kept_url"),
        "Content-Type": F.lit("application/http; msgtype=response"),
    }
    to_reply = common | {"WARC-Concurrent-To": F.col("response")}
    texts = [
        _record("request", F.col("request"), request, to_reply | {"Content-Type": F.lit("application/http; msgtype=request")}),
        _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.col("response"), F.when(revisit, http).otherwise(F.concat(http, html)), reply_headers),
        _record("metadata", F.col("metadata"), fields, to_reply | {"Content-Type": F.lit("application/warc-fields")}),
    ]
    return marked.select(F.concat_ws(END, *texts).alias("value"))


def write(texts: DataFrame, path: str) -> None:
    """Archives, one a task, gzipped."""
    texts.write.option("lineSep", END).option("compression", "gzip").text(path)


# --- reading ------------------------------------------------------------------------


def _header(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at ``path`` (plain or gzipped), segments put together:
    record_type, record_id, target_uri, date, concurrent_to (array), refers_to,
    content_type, block, and damaged: true if the block is not as long as its header says.
    For http responses, revisits and resources also payload, payload_bytes and payload_sha1;
    payload_digest as the header has it."""
    lines = spark.read.option("lineSep", BOUNDARY).text(path)
    parsed = lines.withColumn("head", F.substring_index("value", END, 1))
    body = F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, F.coalesce(_header("Content-Length").cast("int"), F.lit(0)))
    fields = {
        "record_type": F.lower(_header("WARC-Type")),
        "record_id": _header("WARC-Record-ID"),
        "target_uri": _header("WARC-Target-URI"),
        "date": _header("WARC-Date"),
        "concurrent_to": F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*([^\r\n]*)"), F.lit(1)),
        "refers_to": _header("WARC-Refers-To"),
        "payload_digest": _header("WARC-Payload-Digest"),
        "content_type": _header("Content-Type"),
        "origin": _header("WARC-Segment-Origin-ID"),
        "number": _header("WARC-Segment-Number").cast("int"),
        "size": _header("Content-Length").cast("long"),
    }
    parsed = parsed.select(*[c.alias(k) for k, c in fields.items()], body.alias("block")).where(F.col("record_type").isNotNull())
    tails = parsed.where("record_type = 'continuation'").groupBy("origin").agg(F.array_sort(F.collect_set(F.struct("number", "block", "size"))).alias("tails"))
    whole = parsed.where("record_type <> 'continuation'").drop("origin").join(tails, F.col("record_id") == F.col("origin"), "left")
    more = lambda what, start, add: F.aggregate(F.coalesce("tails", F.array().cast(tails.schema["tails"].dataType)), start, add)
    block = F.when(F.col("tails").isNull(), F.col("block")).otherwise(more("block", F.col("block"), lambda a, t: F.concat(a, t["block"])))
    size = more("size", F.col("size"), lambda a, t: a + t["size"])
    whole = whole.withColumn("block", block).withColumn("damaged", F.octet_length("block") != size).drop("origin", "number", "tails", "size")
    http = F.col("content_type").startswith("application/http")
    head = F.substring_index(F.col("block").cast("string"), END, 1)
    payload = F.when(http, F.substring(F.col("block"), F.octet_length(head) + 5, F.octet_length("block"))).otherwise(F.col("block"))
    whole = whole.withColumn("payload", F.when(F.col("record_type").isin(ANCHORS), payload))
    return whole.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})


# --- transactions -------------------------------------------------------------------


def captures_of(found: DataFrame) -> DataFrame:
    """(record_id, capture): for every request, metadata and other record the capture it belongs
    to, through any chain of concurrent-to identifiers in either direction.

    A capture is named by its response, revisit or resource record. Of records that reach none,
    requests name captures of their own, and then whatever is left does.
    """
    rest = written(found.where(~F.col("record_type").isin(ANCHORS)).select("record_id", "record_type", "concurrent_to"), "attached")
    names = found.where(F.col("record_type").isin(ANCHORS))
    # A link says that ``record_id`` belongs where ``target`` does.
    back = names.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    links = rest.select("record_id", F.explode("concurrent_to").alias("target"))
    links = links.unionByName(links.select(F.col("target").alias("record_id"), F.col("record_id").alias("target"))).where("record_id <> target")
    known = names.select("record_id", F.col("record_id").alias("capture"))
    settled = back.join(rest.select("record_id"), "record_id", "left_semi")
    step = links.join(known.withColumnRenamed("record_id", "target"), "target").select("record_id", "capture")
    placed = settled.unionByName(step).groupBy("record_id").agg(F.min("capture").alias("capture"))
    placed = written(placed.join(rest.select("record_id").distinct(), "record_id", "left_semi"), "placed")
    rounds, own = [placed], [["request"], None]
    left = written(rest.join(placed, "record_id", "left_anti"), "unplaced")
    while not left.isEmpty():
        step = links.join(placed.withColumnRenamed("record_id", "target"), "target").select("record_id", "capture")
        step = step.groupBy("record_id").agg(F.min("capture").alias("capture"))
        placed = written(step.join(left.select("record_id").distinct(), "record_id", "left_semi"), "placed")
        if placed.isEmpty():
            kinds = own.pop(0)
            named = left if kinds is None else left.where(F.col("record_type").isin(kinds))
            placed = written(named.select("record_id", F.col("record_id").alias("capture")).distinct(), "placed")
        rounds.append(placed)
        left = written(left.join(placed, "record_id", "left_anti"), "unplaced")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


RECORD = ["record_type", "record_id", "target_uri", "date", "content_type", "block"]


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request, response and metadata (structs), and
    n_requests, n_metadata.

    Of several requests or metadata records of a capture, that with the least identifier is
    nested; ``captures_of`` lists all. The response struct has the payload's fields; a capture
    without one has null there. A response record that occurs twice gives two rows.
    """
    others = found.where(~F.col("record_type").isin(ANCHORS)).join(captures_of(found), "record_id")
    kind = lambda k: F.col("record_type") == k
    first = lambda k: F.min_by(F.when(kind(k), F.struct(*RECORD)), F.when(kind(k), F.col("record_id")))
    attached = others.groupBy("capture").agg(
        first("request").alias("request"),
        first("metadata").alias("metadata"),
        F.count_if(kind("request")).alias("n_requests"),
        F.count_if(kind("metadata")).alias("n_metadata"),
    )
    own = [*RECORD, "refers_to", "payload_digest", "payload", "payload_bytes", "payload_sha1", "damaged"]
    replies = found.where(F.col("record_type").isin(ANCHORS)).select(*own)
    out = replies.join(attached, F.col("record_id") == F.col("capture"), "full")
    response = F.when(F.col("record_id").isNotNull(), F.struct(*own))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.coalesce("record_id", "capture").alias("capture"), "request", response.alias("response"), "metadata", zero("n_requests"), zero("n_metadata"))


def field(block: Column, name: str) -> Column:
    """A value of a metadata record's fields."""
    found = F.regexp_extract(block.cast("string"), rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)
