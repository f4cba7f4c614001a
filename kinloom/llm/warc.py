"""WARC archives: captures written as transactions of records, read back and put together again.

write() makes three records of each page, a request, a response (or a revisit of an equal payload) and a metadata record, the first and last
with WARC-Concurrent-To, as expressions on the JVM; a file is WARC/1.1, compressed as a whole. Equal payloads are found by SHA-256: the first page of
each is a small minimum that is combined before the shuffle; only pages of repeated payloads meet others, by their names, and of their payloads only the first one's moves.
read() parses archives as streams, compressed by record, as a whole or not at all, a record in memory at a time. assemble() writes what is
read of them once and joins requests and
metadata to their responses by WARC-Concurrent-To in either direction, also over other requests and metadata, and gives one nested row a capture.

Null payloads are empty; equal ones of at least dedup_from bytes are kept once. The response is the one with the smallest page_id (null last), then the smallest
hash of url and payload. Of wholly equal rows one can be the response, and each other one is a revisit of it. Null URLs have no WARC-Target-URI; blanks and control characters in one are
written as %20, with the URL itself in the metadata. Other columns are dropped, and an empty table gives no archive rows.
A broken or cut archive gives a row with a problem at the place from which it can't be read. Requests and metadata whose response is missing make a capture
without one. A record that is there twice (same WARC-Record-ID) is taken once; one that belongs to several responses is in each of their captures.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, checkpoint, flagged, release

CRLF = "\r\n"
#: Fixed values of the format: the profile of revisits, and the alphabet of base32.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAIN, SIDE = ("response", "revisit", "resource"), ("request", "metadata")
SCHEMA = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string())]
    + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("verified", pa.bool_()), ("block", pa.binary()), ("problem", pa.string())]
)
DDL = "archive string, offset long, record_type string, record_id string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, verified boolean, block binary, problem string"


def base32(hex_digits: Column, n: int = 40) -> Column:
    """n hexadecimal digits, a multiple of ten, in base32."""
    part = lambda k: F.lpad(F.conv(F.substring(hex_digits, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(k) for k in range(n // 10)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(name: Column, copy: Column, what: str) -> Column:
    h = F.sha2(F.concat(name, F.lit("/"), copy.cast("string"), F.lit(f"/{what}")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def described(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, bytes, digest, sha, name): the payload's size, base32 SHA-1 and SHA-256, and a name of the page and its payload."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("sha", F.sha2(F.col("payload").cast("binary"), 256))
    url = F.coalesce(F.concat(F.octet_length("url").cast("string"), F.lit(":"), "url"), F.lit("-"))
    return p.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32(F.sha1(F.col("payload").cast("binary"))), "name": F.sha2(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), url, "sha"), 256)})


def captures(pages: DataFrame, dedup_from: int = 0) -> DataFrame:
    """(page_id, url, payload, bytes, digest, name, copy, first): what to write of each page; first names the response that a revisit refers to, whose payload is null."""
    whole = described(pages)
    kept = ["page_id", "url", "bytes", "digest", "name"]
    # without payloads: what finds the repeated ones
    slim = checkpoint(whole.drop("payload"))
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "name"))["name"]
    repeated = checkpoint(slim.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.when(F.max("bytes") >= dedup_from, first).alias("first")).filter("n > 1").drop("n"))
    hashes = repeated.select(F.xxhash64("sha").alias("key"))
    one = {"copy": F.lit(0), "first": F.lit(None).cast("string")}

    several = flagged(slim, F.xxhash64("sha"), hashes, "maybe").filter("maybe").groupBy(*kept, "sha").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    several = checkpoint(several.join(repeated, "sha", "left"))
    again = several.filter("first IS NOT NULL").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    again = again.filter("name <> first OR copy < copies").select(*kept, F.lit(None).cast("string").alias("payload"), "copy", "first")

    told = flagged(whole, F.xxhash64("sha"), hashes, "maybe")
    alone = told.filter("NOT maybe").select(*kept, "payload").withColumns(one)
    # the first ones of repeated payloads; what is too small for that, or what the filter has let through in vain, as often as it is there
    heads = several.filter("first IS NULL OR name = first").select("name", F.when(F.col("first").isNull(), F.col("copies")).otherwise(1).alias("times"))
    moved = flagged(told.filter("maybe").drop("maybe"), F.xxhash64("name"), heads.select(F.xxhash64("name").alias("key")), "head").filter("head").select(*kept, "payload")
    moved = moved.dropDuplicates(["name"]).join(heads, "name").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")
    return alone.unionByName(moved.withColumn("first", F.lit(None).cast("string"))).unionByName(again)


def record(kind: str, own_id: Column, fields: list[tuple[str, Column]], content: str, block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), own_id, F.lit(CRLF)]
    for label, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{label}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(f"Content-Type: {content}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def transaction(date: str) -> Column:
    """The records of one row of captures(), without the two line ends after the last."""
    c = F.col
    rid = lambda what: record_id(c("name"), c("copy"), what)
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    host = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("*")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), c("bytes").cast("string"), F.lit(CRLF * 2))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest")))
    to_main = ("WARC-Concurrent-To", rid("main"))
    refers = [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id(c("first"), F.lit(0), "main"))]
    main = F.when(c("first").isNull(), record("response", rid("main"), [*common, digest], "application/http;msgtype=response", F.concat(head, "payload"))).otherwise(
        record("revisit", rid("main"), [*common, digest, *refers], "application/http;msgtype=response", head)
    )
    about = F.to_json(F.struct("page_id", "url"))
    return F.concat_ws(CRLF * 2, record("request", rid("request"), [*common, to_main], "application/http;msgtype=request", asked), main, record("metadata", rid("metadata"), [*common, to_main], "application/json", about))


def write(pages: DataFrame, folder: str, dedup_from: int = 0, date: str = "2000-01-01T00:00:00Z", compression: str = "gzip", file_pages: int = 20_000) -> None:
    """Archives of pages (page_id, url, html) in a folder of any file system that Spark writes to, with file_pages pages a file at most."""
    rows = captures(pages, dedup_from).select(transaction(date).alias("value"))
    rows.write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", file_pages).text(folder)


def inflated(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of an archive, a part at a time; compressed members follow each other."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[a : a + step] for a in range(0, len(data), step))
        return
    at, left, one = 0, b"", zlib.decompressobj(31)
    while at < len(data) or left:
        if not left:
            left, at = data[at : at + step], at + step
        if one.eof:
            one = zlib.decompressobj(31)
        yield one.decompress(left, 4 * step)
        left = one.unused_data if one.eof else one.unconsumed_tail
    while not one.eof and (more := one.decompress(b"", 4 * step)):
        yield more
    if not one.eof:
        raise ValueError("the compressed data end early")


def parsed(parts: Iterable[bytes]) -> Iterator[tuple[int, dict, list[str], bytes]]:
    """(offset, fields, concurrent ids, block) of each record; what can't be read is an error that says where it is."""
    buffer, base, parts = bytearray(), 0, iter(parts)

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            buffer.extend(part)
        return part is not None

    while True:
        while len(buffer) < 4 and more():
            pass
        blank = len(buffer) - len(buffer.lstrip(b"\r\n"))
        if blank:
            del buffer[:blank]
            base += blank
            continue
        if not buffer:
            return
        start = 0
        while (end := buffer.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(buffer) - 3)
            if not more():
                raise ValueError(f"at {base}: a record's head has no end")
        version, *lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"at {base}: no record begins here")
        fields, concurrent, label = {}, [], ""
        for line in lines:
            if line[:1] in (" ", "\t"):  # goes on
                fields[label] = f"{fields.get(label, '')} {line.strip()}"
                continue
            label, _, value = line.partition(":")
            label, value = label.strip().lower(), value.strip()
            fields[label] = value
            if label == "warc-concurrent-to":
                concurrent.append(value)
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"at {base}: a record without a length")
        stop = end + 4 + int(fields["content-length"])
        while len(buffer) < stop:
            if not more():
                raise ValueError(f"at {base}: a record is cut off")
        yield base, fields, concurrent, bytes(buffer[end + 4 : stop])
        del buffer[:stop]
        base += stop


def payload(fields: dict, block: bytes) -> tuple[str | None, int | None, bool | None]:
    """Digest and size of a record's payload, and whether the digest is what its head says. A revisit's are those of what it refers to."""
    said, kind = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("warc-type")
    http = fields.get("content-type", "").startswith("application/http")
    head, found, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    if kind == "revisit":
        lengths = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return said, int(lengths[0]) if lengths and lengths[0].isdigit() else None, None
    if kind not in MAIN:
        return None, None, None
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return digest, len(body), None if said is None else said == digest


def read(spark: SparkSession, folder: str, blocks: tuple[str, ...] = (*MAIN, *SIDE)) -> DataFrame:
    """Records of the archives in a folder (see DDL); only those of the types in blocks keep their block."""

    def run(it):
        def rows():
            for batch in it:
                for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    try:
                        for at, fields, concurrent, block in parsed(inflated(data.as_py())):
                            kind = fields.get("warc-type")
                            yield path, at, kind, fields.get("warc-record-id"), concurrent, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"), *payload(fields, block), block if kind in blocks else None, None
                    except (ValueError, zlib.error) as e:
                        yield path, None, None, None, [], None, None, None, None, None, None, None, str(e)

        yield from batches(rows(), SCHEMA, 64)
        release()

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, DDL)


def assemble(records: DataFrame) -> DataFrame:
    """A row for each capture: capture_id, record_type, target_uri, date, refers_to, payload_digest, payload_bytes, verified, block, requests and metadata
    (arrays of record_id and block, by record_id)."""
    good = checkpoint(records).filter("problem IS NULL AND record_id IS NOT NULL")
    main = good.filter(F.col("record_type").isin(*MAIN)).dropDuplicates(["record_id"])
    side = good.filter(F.col("record_type").isin(*SIDE)).dropDuplicates(["record_id"]).select("record_id", "record_type", "concurrent_to", "block")
    names = main.select(F.col("record_id").alias("other"), F.col("record_id").alias("capture_id"))
    links = side.select("record_id", F.explode("concurrent_to").alias("other"))
    back = main.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    # links between requests and metadata go both ways
    between = links.join(side.select(F.col("record_id").alias("other")), "other", "left_semi")
    between = between.union(between.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    belongs = checkpoint(links.join(names, "other").select("record_id", "capture_id").union(back.join(side.select("record_id"), "record_id", "left_semi").select("record_id", "capture_id")).distinct())
    new = belongs
    while not between.isEmpty():  # what is reached over others, a step a round
        new = checkpoint(between.join(new.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture_id").distinct().join(belongs, ["record_id", "capture_id"], "left_anti"))
        if new.isEmpty():
            break
        belongs = checkpoint(belongs.union(new))
    sides = side.join(belongs, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", F.get("concurrent_to", F.lit(0)), "record_id"))
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("record_type") == kind, F.struct("record_id", "block"))))
    grouped = sides.groupBy("capture_id").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    own = main.select(F.col("record_id").alias("capture_id"), "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "verified", "block")
    return own.join(grouped, "capture_id", "full")


def pages_of(captures_: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures that write() made: page_id from the metadata, revisits resolved."""
    page = captures_.filter("record_type IS NOT NULL").select("capture_id", F.get_json_object(F.get("metadata", F.lit(0))["block"].cast("string"), "$.page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").alias("other"))
    page = checkpoint(page)
    first = page.filter("record_type = 'response'").select(F.col("capture_id").alias("other"), F.col("page_id").alias("refers_to"))
    again = page.filter("record_type = 'revisit'").join(first, "other", "left").drop("other")
    return page.filter("record_type <> 'revisit'").drop("other").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again).drop("capture_id")
