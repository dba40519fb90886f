"""WARC archives: writing captures, reading records, and assembling transactions.

``write_captures`` writes for every page a response (or a revisit, if an equal payload is archived
as a response), a request and a metadata record. Records are strings of bytes ended by two empty
lines, so Spark's text sink writes them: to any store Spark knows, and committed task by task, so
lost executors leave no half archives. ``read_records`` parses whole archives by Content-Length
from the binary file source, piece by piece. ``assemble`` joins request, response and metadata
records through their concurrent-to identifiers, over any number of records between them, and emits
one nested row per capture. Archives are rolled at about ROLL_BYTES of payload.

Defined cases: a null payload is empty; a null url gives no url back; white space in a url is
percent-encoded; a null page id orders last and comes back null; rows repeated in id and payload
are captures of their own, and all responses if theirs is the smallest id of the payload (revisits
then name no response record); payloads below ``least_bytes`` are never revisited; an empty table gives no captures; other columns aren't
archived. Archives whose records break off raise an error.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, delete_path, join_groups, new_path, tidy

CRLF = "\r\n"
#: Payloads of fewer bytes are always archived whole.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
NO_URL = "urn:leafmill:no-url"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records handed on at once.
BATCH_BYTES = 4_000_000
#: Payload bytes after which an archive is rolled, by the mean payload; bytes inflated at a time.
ROLL_BYTES, STEP = 256_000_000, 1_000_000


def base32(digits: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: each five of them are four base32 digits."""
    quads = [F.lpad(F.conv(F.substring(digits, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(data: Column) -> Column:
    return base32(F.sha1(data))


def _dashed(name: Column) -> Column:
    """The first 31 of 32 hexadecimal digits, grouped as in a UUID."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 11))
    return F.concat_ws("-", *(F.substring(name, at, n) for at, n in cuts))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def _record(kind: Column, id_: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", kind), _line("WARC-Record-ID", id_), F.lit(f"WARC-Date: {DATE}{CRLF}"), *headers,
        F.lit(f"Content-Type: {content_type}{CRLF}"), _line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def _clean(url: Column) -> Column:
    for a, b in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20"), ("\0", "%00")):
        url = F.replace(url, F.lit(a), F.lit(b))
    return url


def _payload_groups(base: DataFrame, least_bytes: int) -> DataFrame:
    """One row per payload that is archived more than once: _sha, _first (its smallest id), _copies, and _single:
    whether one row only has that id, so that one response record holds the payload."""
    by_id = base.filter(F.col("_bytes") >= least_bytes).groupBy("_sha", "_id").agg(F.count("*").alias("_n"))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_n").alias("n")))
    groups = by_id.groupBy("_sha").agg(least.alias("_least"), F.sum("_n").alias("_copies")).filter("_copies > 1")
    return groups.select("_sha", F.col("_least.id").alias("_first"), (F.col("_least.n") == 1).alias("_single"), "_copies")


def write_captures(
    pages: DataFrame,
    path: str,
    scratch: Scratch,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> None:
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    base = base.withColumn("_sha", F.sha1(F.encode("_payload", "UTF-8"))).withColumn("_bytes", F.octet_length("_payload"))
    groups = scratch.save(_payload_groups(base.select("_id", "_sha", "_bytes"), least_bytes), "payloads")
    size = base.agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes")).first()
    met = join_groups(base, groups, "_sha", "_copies", size.n)
    again = F.col("_copies").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    # The one response of a repeated payload is named by the payload, so that its revisits can refer to it.
    salt = uuid.uuid4().hex
    named = F.md5(F.concat(F.lit(salt), F.col("_sha")))
    own = F.when(F.col("_single") & ~again, named).otherwise(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))
    met = met.withColumn("_kind", F.when(again, "revisit").otherwise("response")).withColumn("_name", own)
    # One identifier a capture; its last digit tells the records apart.
    urn = lambda name, part: F.concat(F.lit("<urn:uuid:"), _dashed(name), F.lit(part + ">"))
    uri = _line("WARC-Target-URI", F.coalesce(_clean(F.col("_url")), F.lit(NO_URL)))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_sha"))))
    is_revisit = F.col("_kind") == "revisit"
    profile = _line("WARC-Profile", F.when(is_revisit, PROFILE))
    to_first = _line("WARC-Refers-To", F.when(is_revisit & F.col("_single"), urn(named, "0")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("_payload")))
    name = F.col("_name")
    main = _record(F.col("_kind"), urn(name, "0"), [uri, digest, profile, to_first], "application/http;msgtype=response", block)
    place = F.coalesce(F.nullif(F.regexp_extract(_clean(F.col("_url")), r"^.*?://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce(_clean(F.col("_url")), F.lit("")), r"^.*?://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), place, F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF))
    beside = lambda part: [uri, _line("WARC-Concurrent-To", urn(name, part))]
    request = _record(F.lit("request"), urn(name, "1"), beside("0"), "application/http;msgtype=request", asked)
    about = F.concat(
        _line("page-id", F.col("_id").cast("string")),
        _line("payload-bytes", F.col("_bytes").cast("string")),
        _line("refers-to-page", F.when(is_revisit, F.col("_first")).cast("string")),
    )
    metadata = _record(F.lit("metadata"), urn(name, "2"), beside("1"), "application/warc-fields", about)
    records = met.select(F.explode(F.array(main, request, metadata)).alias("value"))
    mean = (size.bytes or 0) / max(1, size.n) / 3 + 500
    sink = records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    sink.option("maxRecordsPerFile", max(3, int(roll_bytes / mean))).text(path)


FIELDS = ("record_type", "record_id", "date", "target_uri", "payload_digest", "profile", "refers_to", "content_type")
HEADERS = {
    "warc-type": "record_type",
    "warc-record-id": "record_id",
    "warc-date": "date",
    "warc-target-uri": "target_uri",
    "warc-payload-digest": "payload_digest",
    "warc-profile": "profile",
    "warc-refers-to": "refers_to",
    "content-type": "content_type",
}
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", concurrent_to array<string>, http_head string, payload binary"


def inflate(data: bytes, step: int = STEP) -> Iterator[bytes]:
    """The content of an archive in pieces of at most ``step`` bytes: all members of a gzip stream, other bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield data[at : at + step]
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data) and not member.unconsumed_tail:
                raise ValueError("the compressed archive breaks off")
            given = member.unconsumed_tail or view[at : at + step]
            at += 0 if member.unconsumed_tail else len(given)
            if piece := member.decompress(given, step):
                yield piece
        at -= len(member.unused_data)


def parse(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive given in pieces; no more than a record and a piece stand in memory."""
    pieces, held, at = iter(pieces), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        if at > STEP:
            del held[:at]
            at = 0
        while held[at : at + 2] == CRLF.encode() or (len(held) - at < 2 and more()):
            if held[at : at + 2] == CRLF.encode():
                at += 2
        if at >= len(held):
            return
        while (head := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                break
        if head < 0 or not held.startswith(b"WARC/", at):
            raise ValueError("no WARC record where one should start")
        record = dict.fromkeys(FIELDS) | {"concurrent_to": [], "http_head": None}
        length = None
        for line in held[at:head].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "content-length":
                length = int(value)
            elif name == "warc-concurrent-to":
                record["concurrent_to"].append(value)
            elif name in HEADERS:
                record[HEADERS[name]] = value
        start = head + 4
        while length is not None and len(held) < start + length and more():
            pass
        if length is None or len(held) < start + length:
            raise ValueError("a WARC record breaks off")
        block = bytes(held[start : start + length])
        if (record["content_type"] or "").startswith("application/http"):
            top, end, rest = block.partition(b"\r\n\r\n")
            record["http_head"], block = (top + end).decode("utf-8", "replace"), rest
        yield record | {"payload": block}
        at = start + length


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [(f, pa.string()) for f in FIELDS] + [("concurrent_to", pa.list_(pa.string())), ("http_head", pa.string()), ("payload", pa.binary())]
    schema = pa.schema(kinds)
    for batch in batches:
        for k in range(batch.num_rows):
            rows, size = [], 0
            for record in parse(inflate(batch.column(0)[k].as_py())):
                rows.append(record)
                size += len(record["payload"]) + 500
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
    tidy()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``; a task holds an archive's compressed bytes and a few records.

    The frame parses the archives whenever it is evaluated; save it before several plans read it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("content").mapInArrow(_parse_files, SCHEMA)


MAIN = ("response", "revisit", "resource")


def capture_of(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns record_id, main: each request and metadata record with the main records it belongs to.

    Concurrent-to names a record of the same capture, in either direction and over any number of
    records between, but not through another main record. Each round follows one more step; pairs
    met before aren't followed again, so circles end.
    """
    is_main = F.col("record_type").isin(*MAIN)
    kinds = records.filter("record_id is not null").groupBy("record_id").agg(F.max(is_main).alias("_main"))
    links = records.filter("record_id is not null").select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    if not (links := scratch.save(links.distinct(), "links")).limit(1).count():
        return links.select(F.col("a").alias("record_id"), F.col("b").alias("main")).limit(0)
    typed = links.join(kinds.withColumnsRenamed({"record_id": "a", "_main": "am"}), "a").join(kinds.withColumnsRenamed({"record_id": "b", "_main": "bm"}), "b")
    both = typed.select("a", "b", "am", "bm").unionByName(typed.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("bm").alias("am"), F.col("am").alias("bm")))
    both = scratch.save(both.filter("not bm").distinct().select("a", "b", "am"), "steps")
    scratch.drop(links)
    reached = step = scratch.save(both.filter("am").select(F.col("b").alias("record_id"), F.col("a").alias("main")), "reached")
    between = both.filter("not am").select(F.col("a").alias("record_id"), "b")
    while step.limit(1).count():
        step = step.join(between, "record_id").select(F.col("b").alias("record_id"), "main").distinct()
        step = scratch.save(step.join(reached, ["record_id", "main"], "left_anti"), "reached")
        reached = reached.unionByName(step)
    return reached


def assemble(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One nested row per capture: record_id, record_type, url, payload, payload_bytes, payload_sha1 (of what was read),
    payload_digest (as recorded), refers_to (record id, of revisits), http_head, request struct, metadata array of structs.

    ``records`` is read several times: give a saved table. Payloads move once, in the last join, and not at all where
    their column isn't asked for.
    """
    side = records.filter("record_type in ('request', 'metadata')")
    side = side.select("record_id", "record_type", "http_head", F.decode("payload", "UTF-8").alias("text"))
    told = capture_of(records.select("record_id", "record_type", "concurrent_to"), scratch).join(side, "record_id").groupBy(F.col("main").alias("record_id")).agg(
        F.min(F.when(F.col("record_type") == "request", F.struct("record_id", "http_head"))).alias("request"),
        F.sort_array(F.collect_list(F.when(F.col("record_type") == "metadata", F.struct("record_id", "text")))).alias("metadata"),
    )
    base = records.filter(F.col("record_type").isin(*MAIN)).select(
        "record_id",
        "record_type",
        F.nullif("target_uri", F.lit(NO_URL)).alias("url"),
        "date",
        "refers_to",
        "http_head",
        "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_sha1"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
    )
    return base.join(told, "record_id", "left")


def field(metadata: Column, name: str) -> Column:
    """A field of a capture's metadata records, or null."""
    text = F.array_join(F.transform(metadata, lambda m: m["text"]), CRLF)
    return F.nullif(F.regexp_extract(text, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = new_path(spark, "archives")
    write_captures(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path, scratch)
    records = scratch.save(read_records(spark, path), "records")
    delete_path(spark, path)
    captures = assemble(records, scratch)
    revisit = F.col("record_type") == "revisit"
    return captures.select(
        field(F.col("metadata"), "page-id").cast("bigint").alias("page_id"),
        F.when(revisit, field(F.col("metadata"), "payload-bytes").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        field(F.col("metadata"), "refers-to-page").cast("bigint").alias("refers_to"),
    )


#: base32 of a SHA-1: each of its 32 digits is five bits of its 160.
SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (CAST('0x' || substr(h, 1 + (k // 4) * 5, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1) FOR k IN range(32)], '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM f
"""

QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": SQL}
