"""WARC archives: writing, and a reader that salvages damaged ones (operator 1).

Archives are plain WARC 1.1 files that Spark's text writer makes, the two line ends that close a record being its line
separator; they can lie in any store that Spark reaches. The reader takes whole files, plain or gzip by member, checks
version line, length, closing line ends and block digest of each record, and after a failed check searches for the
next valid member or version line. What lies between is logged as a gap, never lost in silence.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bloom
from ledgerlake.llm.common import bounded_batches, lookup, scratch_path, staged, table

CRLF, END = "\r\n", "\r\n\r\n"
#: Payloads from this size on are stored once; mean bytes of a file.
REVISIT_BYTES, FILE_BYTES = 1000, 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a gzip member that are unpacked at once.
PIECE = 1 << 14
MAGIC, VERSION, GZIP = b"WARC/1.", (b"WARC/1.0", b"WARC/1.1"), b"\x1f\x8b\x08"


def _header(name: str, value: Column) -> Column:
    """The header line, or nothing for a null value; line breaks in it would end the line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(CRLF)), F.lit(""))


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of REVISIT_BYTES and more, that with the largest page_id is the response; the others revisit it.
    A null html is an empty payload. A null page_id is never revisited unless all are null, then all are responses;
    rows that repeat the response's page_id are responses too. Only rows whose digest may repeat are shuffled.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    rows = rows.withColumn("h", F.xxhash64("payload_digest"))
    keys = staged(rows.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "payload_digest", "h"), "warc-keys")
    blocks = bloom.blocks_for(keys.count())
    again = staged(bloom.repeated_filter(keys, "h", blocks), "warc-bloom")
    first = bloom.probe(keys, "h", again, blocks, "maybe").where("maybe").groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    probed = bloom.probe(rows, "h", again, blocks, "maybe").withColumn("maybe", F.col("maybe") & (F.col("payload_bytes") >= REVISIT_BYTES))
    alone = probed.where("not maybe").withColumn("first", F.lit(None).cast("long"))
    met = lookup(probed.where("maybe"), staged(first, "warc-first"), ["payload_digest"], "n")
    rows = alone.unionByName(met)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per row of pages(page_id, url, html), as files of about FILE_BYTES under path."""
    rows = with_revisits(pages)
    revisit = F.col("record_type") == "revisit"
    payload = F.when(revisit, "").otherwise(F.coalesce("html", F.lit("")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    rows = rows.withColumn("block", F.concat(head, payload))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.format_string("<urn:page:%s:%s>", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.substring("payload_digest", 1, 12))),
        _header("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Page-ID", F.col("page_id")),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("WARC-Refers-To-Page-ID", F.col("refers_to")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("block").cast("binary")))),
        _header("WARC-Payload-Length", F.col("payload_bytes")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length("block")),
        F.lit(CRLF),
        F.col("block"),
    )
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(FILE_BYTES // (size + 600)))).text(path)


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int] | str:
    """The record that starts at ``at``: headers, block and where it ends; or the check that failed."""
    if not data.startswith(VERSION, at):
        return "version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "header end"
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "content length"
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "record end"
    block = data[stop + 4 : end]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and len(want) == 45 and hashlib.sha1(block).hexdigest() != want[5:].lower():
        return "block digest"
    return headers, block, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """The gzip member that starts at ``at``: unpacked, as far as it goes; where it ends, None if it is damaged; why."""
    unpack, view, out, k = zlib.decompressobj(31), memoryview(data), [], at
    while k < len(data) and not unpack.eof:
        before = unpack.copy()
        try:
            out.append(unpack.decompress(view[k : k + PIECE]))
        except zlib.error:
            try:
                for i in range(k, min(len(data), k + PIECE)):  # what the damaged piece holds before the damage
                    out.append(before.decompress(view[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), None, "gzip member"
        k += PIECE
    if not unpack.eof:
        return b"".join(out), None, "gzip member end"
    return b"".join(out), min(k, len(data)) - len(unpack.unused_data), ""


def _next(data: bytes, at: int, packed: bool) -> int:
    """Where the next version line, or gzip member, may begin."""
    found = [data.find(MAGIC, at), *([data.find(GZIP, at)] if packed else [])]
    return min((x for x in found if x >= 0), default=len(data))


def salvage(data: bytes, packed: bool = True) -> Iterator[tuple]:
    """(offset, length, headers, block, reason, inner) of each record, reason None, and of each gap, headers and block
    None. Offsets are those in the file, which records and gaps together cover, but for members that hold nothing.

    What comes from a gzip member has the member's range, and as inner its own (offset, length) in the unpacked bytes;
    these cover what could be unpacked. Of a damaged member the records before the damage are kept. Gzip within a member
    isn't unpacked again.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        rows, end = [], None
        if packed and data.startswith(GZIP, at):
            unpacked, end, why_not = _member(data, at)
            rows = [(*x[2:5], (x[0], x[1])) for x in salvage(unpacked, False)]
            if end is None and any(x[2] is None for x in rows):  # what follows its last record is lost
                end = _next(data, at + 1, packed)
                last = rows[-1][3]
                rows = [*rows[:-1], (None, None, why_not, last)] if rows[-1][2] else [*rows, (None, None, why_not, (sum(last), 0))]
        else:
            got = _parse(data, at)
            if isinstance(got, str):
                why_not = got
            else:
                rows, end = [(got[0], got[1], None, None)], got[2]
        if end is None:
            gap, why = (at, why_not) if gap is None else (gap, why)
            at = _next(data, at + 1, packed)
            continue
        if gap is not None:
            yield gap, at - gap, None, None, why, None
            gap = None
        for x in rows:
            yield at, end - at, *x
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, None, why, None


RECORDS = "path string, offset long, length long, inner_offset long, inner_length long, reason string, headers map<string,string>, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner_offset", pa.int64()), ("inner_length", pa.int64()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows, held = [], 0
            for offset, length, headers, block, reason, inner in salvage(content.as_py() or b""):
                if block is not None and headers.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                rows.append((path.as_py(), offset, length, *(inner or (None, None)), reason, list(headers.items()) if headers is not None else None, block))
                held += len(block or b"")
                if held > 4 << 20:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record or gap of the files under path: path, offset, length, inner_offset and inner_length (as in salvage), reason (null: a sound record; else the
    check that failed, and the row is a quarantined gap), headers (lower-case names), payload (without HTTP headers).
    An empty file gives no rows."""
    bounded_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path).where("reason is null")
    head = lambda name: F.col("headers")[name]
    revisit = head("warc-type") == "revisit"
    return read.select(
        head("warc-page-id").cast("long").alias("page_id"),
        F.when(revisit, head("warc-payload-length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring(head("warc-payload-digest"), 6, 40)).otherwise(F.sha1("payload")).alias("payload_digest"),
        head("warc-type").alias("record_type"),
        head("warc-refers-to-page-id").cast("long").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS resp FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = resp THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = resp THEN NULL ELSE resp END AS refers_to
FROM r
"""
