"""WARC archives through Spark's own text source and sink, so any file system Spark reaches will do.

Writing: one record per page. Of pages with equal payloads (SHA-1 and length) of `min_payload` bytes or more, the
one with the smallest id is a response and the others are revisits without payload. Files hold
`records_per_file` records and are gzipped by default.

Reading: the text source splits a file at every record magic, so each piece is a *candidate* record. Tasks turn
candidates into (offset, successor offset) pairs, the successor taken from Content-Length. Runs of candidates whose
successor is just the next candidate fold to one node; pointer jumping over the runs, from offset 0 of each file,
keeps what the chain reaches. A magic inside a payload is never reached, and its bytes stay in the payload.

Defined results: null html is an empty payload; pages without id are responses that nothing refers to; of rows that
repeat an id and a payload the first is the response and the others revisit it; line breaks in a URL are removed; a
file that does not begin with a record, or what follows a broken record, gives no rows; no pages give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallmark.llm.kernels import picked
from stallmark.llm.scratch import materialize, spread_join

#: The version that is written.
VERSION = "1.1"
MAGIC = f"WARC/{VERSION}\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The profile URI of WARC 1.1 and the alphabet of base32 (RFC 4648).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five bits a digit: ten hex digits make eight."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, records_per_file: int = 2000, compression: str = "gzip") -> None:
    """Writes the archives. Groups of equal payloads are found on (id, digest, size) alone, and pages learn what they revisit
    by id and payload, so that a hot payload is spread over tasks. A revisit record names the length of the payload."""
    rows = picked(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html")), "size": F.octet_length("html")})
    payload = ["digest", "size"]
    narrow = materialize(rows.where(F.col("size") >= min_payload).groupBy("id", *payload).agg(F.count("*").alias("n")), "warc-payloads")
    groups = narrow.groupBy(*payload).agg(F.min("id").alias("keeper"), F.sum("n").alias("copies")).where("copies > 1 and keeper is not null")
    groups = materialize(groups, "warc-groups")
    members = materialize(spread_join(narrow.where("id is not null"), groups, payload, "copies").where("id <> keeper or n > 1").select("id", *payload, "keeper", "n"), "warc-members")
    joined = rows.join(members, ["id", *payload], "left")
    again = F.row_number().over(Window.partitionBy("id", *payload).orderBy("url"))
    once = joined.where("n is null or n = 1").withColumn("again", F.lit(1))
    if not members.where("n > 1").isEmpty():  # rows that repeat an id and a payload: only these are put in order
        once = once.unionByName(joined.where("n > 1").withColumn("again", again))
    revisit = F.col("keeper").isNotNull() & ((F.col("id") != F.col("keeper")) | (F.col("again") > 1))
    joined = once.withColumn("revisit", revisit)
    body = F.concat(F.lit(HTTP), F.when(F.col("revisit"), "").otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.lit("<urn:page:>"))),
        F.lit("WARC-Date: 2020-01-01T00:00:00Z\r\n"),
        _field("WARC-Target-URI", F.translate("url", "\r\n", "")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("keeper")))),
        _field("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        _field("X-Payload-Length", F.when(F.col("revisit"), F.col("size").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    writer = joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
    writer.option("compression", compression).text(path)


def version_of(spark: SparkSession, path: str) -> str:
    """What the first line of an archive says; all archives of a path must say the same."""
    first = spark.read.text(path).first()
    found = re.match(r"WARC/(\d+\.\d+)\r?$", first.value) if first else None
    return found[1] if found else VERSION


def _pieces(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """Every piece between two magics: file, off (of its magic), succ (from its Content-Length; null without one),
    head and value. What comes from the value is taken before the window, so that a reader of offsets moves no payload."""
    read = spark.read.option("lineSep", magic).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    head = F.substring_index("value", "\r\n\r\n", 1)
    length = F.expr(r"try_cast(nullif(regexp_extract(head, '(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]+)', 1), '') as long)")
    whole = F.col("value").contains("\r\n\r\n")
    read = read.withColumn("head", head).withColumn("size", F.octet_length("value") + len(magic))
    read = read.withColumn("span", F.when(whole, F.octet_length("head") + len(magic) + 8 + length))
    order = Window.partitionBy("file").orderBy("block", "nth")
    begin = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = read.withColumn("off", begin - len(magic)).where("off >= 0")
    return pieces.select("file", "off", "head", "value", (F.col("off") + F.col("span")).alias("succ"))


def _reached(pieces: DataFrame) -> DataFrame:
    """(file, spans): the offsets [entry, last] that the chain from offset 0 of the file runs through."""
    order = Window.partitionBy("file").orderBy("off")
    met = pieces.select("file", "off", "succ").withColumn("next", F.lead("off").over(order))
    broken = F.lag(F.when(F.col("succ") == F.col("next"), 0).otherwise(1), 1, 0).over(order)
    met = materialize(met.withColumn("broken", broken).withColumn("run", F.sum("broken").over(order)).select("file", "off", "succ", "run"), "warc-candidates")
    runs = met.groupBy("file", "run").agg(F.min("off").alias("first"), F.max("off").alias("last"), F.max_by("succ", "off").alias("exit"))
    jump = runs.join(met.select("file", F.col("off").alias("exit"), F.col("run").alias("to")), ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry"))
    reach = runs.where("first = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    jump = materialize(jump, "warc-jumps")
    while not jump.isEmpty():
        step = reach.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reach = materialize(reach.unionByName(step).distinct(), "warc-reached")
        on = jump.select("file", F.col("to").alias("run"), F.col("run").alias("of"))
        jump = materialize(on.join(jump, ["file", "run"]).select("file", F.col("of").alias("run"), "to", "entry"), "warc-jumps")
    spans = reach.join(runs, ["file", "run"]).groupBy("file")
    return spans.agg(F.array_sort(F.collect_list(F.struct("entry", "last"))).alias("spans"))


def read_warc(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """One row per record that the chain reaches: file, offset, record_type, record_id, refers_to (both the page id
    as long), target_uri, payload_digest (from the header), payload_length (of the full payload: a revisit says it, null if it does
    not), payload (binary; after the HTTP head). `version` of the records, as 1.0, is that of the first line unless given."""
    magic = f"WARC/{version or version_of(spark, path)}\r\n"
    pieces = _pieces(spark, path, magic)
    linked = pieces.join(_reached(pieces), "file")
    order = Window.partitionBy("file").orderBy("off")
    hit = F.exists("spans", lambda s: (F.col("off") >= s["entry"]) & (F.col("off") <= s["last"]))
    of = F.max(F.when(F.col("hit"), F.col("off"))).over(order)
    parts = linked.withColumn("hit", hit).withColumn("of", of).where("of is not null").groupBy("file", "of")
    records = parts.agg(F.min_by("head", "off").alias("head"), F.min_by("succ", "off").alias("succ"), F.array_sort(F.collect_list(F.struct("off", F.col("value").cast("binary").alias("value")))).alias("parts"))
    glued = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, F.lit(magic.encode()), p["value"]))
    records = records.withColumn("bytes", glued).where((F.octet_length("bytes") >= F.col("succ") - F.col("of") - 4))
    start = len(magic) + F.octet_length("head") + 5
    block = F.expr("substring(bytes, start, succ - of - start - 3)")
    records = records.withColumn("start", start).withColumn("block", block)
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)) + 4
    payload = F.expr("substring(block, http + 1, greatest(octet_length(block) - http, 0))")
    get = lambda n, p="([^\r\n]*)": F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){n}:[ \t]*{p}", 1), F.lit(""))
    urn = lambda n: get(n, "<urn:page:(-?[0-9]+)>").cast("long")
    return records.withColumn("http", http).select("file", F.col("of").alias("offset"), get("WARC-Type").alias("record_type"), urn("WARC-Record-ID").alias("record_id"), urn("WARC-Refers-To").alias("refers_to"), get("WARC-Target-URI").alias("target_uri"), F.regexp_replace(get("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), F.when(get("WARC-Type") == "revisit", get("X-Payload-Length").cast("long")).otherwise(F.octet_length(payload).cast("long")).alias("payload_length"), payload.alias("payload"))
