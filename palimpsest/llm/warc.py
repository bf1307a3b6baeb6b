"""WARC archives as a table of record chunks.

A page becomes one record; a payload above ``CHUNK`` bytes becomes a response segment and continuation segments
(WARC-Segment-Number, WARC-Segment-Origin-ID), a row each. One pass over a payload cuts it and carries its digest from
chunk to chunk: a chunk is a slice of the payload's own buffer, and no more than a few megabytes of rows are held beside
it, so no task builds a whole record or archive. Rows are written as WARC text by Spark's own writer and read by Spark's
own reader, which cuts at the version line. The version's text never lies in a chunk: a payload that holds it is cut
inside it. Both work in any store that Spark reaches. Archives end after about ``FILE``
bytes of records.

On reading, digests are carried again: chunks are dealt by record and sorted, and a running SHA-256 sees one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

CHUNK, LEAST_REVISIT, FILE = 1 << 18, 100, 256 << 20
VERSION, EOL = "WARC/1.1\r\n", "\r\n"
#: What no chunk may hold, since a line end behind it would make the version line.
OPEN = VERSION.removesuffix(EOL).encode()
#: The date that all records carry, so that reruns write equal archives.
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of rows that a task gathers before it hands them on.
_HELD = 4 << 20


def cuts(payload: memoryview, size: int = CHUNK) -> Iterator[memoryview]:
    """Slices of the UTF-8 payload, one at least, of ``size`` bytes at most (a character's bytes stay together), none of
    which holds the version."""
    n, at = len(payload), 0
    marks = (m.start() + 4 for m in re.finditer(re.escape(OPEN), payload))
    mark = next(marks, n)
    while at < n or not n:
        end = min(at + size, n)
        while at < end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        if end <= at:  # a character longer than a chunk
            end = at + 1
            while end < n and payload[end] & 0xC0 == 0x80:
                end += 1
        while mark <= at and mark < n:
            mark = next(marks, n)
        end = min(end, mark) if mark > at else end
        yield payload[at:end]
        at = end
        if not n:
            return


def plan_records(pages: DataFrame, path: str) -> tuple[DataFrame, int]:
    """page_id, payload_digest and refers_to of the pages that revisit another's payload, and the mean payload's bytes."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    thin = pages.select(common.order_id("page_id").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    thin = common.materialise(thin, f"{path}/digests")
    mean = int(thin.agg(F.avg("n")).first()[0] or 0)
    thin = thin.where(F.col("n") >= LEAST_REVISIT).drop("n")
    first = thin.groupBy("digest").agg(F.min("id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    met = common.salted_lookup(thin, common.materialise(first, f"{path}/first"), "digest", f"{path}/by-digest", by="id")
    return met.where("id <> response").distinct(), mean


def record_chunks(pages: DataFrame, revisits: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows page_id, copy (tells repeated rows apart), chunk_no from 1, digest (of the payload up to here, in hexadecimal),
    and value: the segment as WARC text."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(common.order_id("page_id").alias("id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).repartition(common.partitions_for(pages), "id", "digest")
    rows = own.join(revisits, ["id", "digest"], "left").select("id", "page_id", "url", "digest", "response", F.col("payload").cast("binary").alias("payload"))
    kinds = [("page_id", pa.int64()), ("copy", pa.int64()), ("chunk_no", pa.int32()), ("digest", pa.string()), ("value", pa.string())]
    schema = pa.schema(kinds)

    def header(fields: list[tuple[str, object]]) -> bytes:
        return (VERSION + "".join(f"{k}: {v}{EOL}" for k, v in fields if v is not None) + EOL).encode("utf-8", "surrogatepass")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy, held, size_held = TaskContext.get().partitionId() << 33, [], 0

        def batch() -> pa.RecordBatch:
            *plain, values = zip(*held, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(plain, schema, strict=False)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(values, pa.binary()).view(pa.string())], schema=schema)

        for part in parts:
            for id_, page, url, digest, response, cell in zip(*part.columns, strict=True):
                id_, page, url, response = (x.as_py() for x in (id_, page, url, response))
                body = memoryview(cell.as_buffer()).cast("B") if response is None else memoryview(b"")
                url = url and url.replace("\r", "%0D").replace("\n", "%0A").replace("WARC/1.1", "WARC/1%2E1")
                state, seen = hashlib.sha256(), 0
                for number, chunk in enumerate(cuts(body, size), 1):
                    state.update(chunk)
                    seen += len(chunk)
                    first, last = number == 1, seen == len(body)
                    http = _HTTP.encode() if first else b""
                    fields = [
                        ("WARC-Type", "continuation" if not first else "revisit" if response is not None else "response"),
                        ("WARC-Record-ID", f"<urn:page:{id_}>" if first else f"<urn:page:{id_}:{number}>"),
                        ("WARC-Date", DATE),
                        ("WARC-Target-URI", url if first else None),
                        ("WARC-Payload-Digest", f"sha256:{digest}" if first else None),
                        ("WARC-Profile", _PROFILE if first and response is not None else None),
                        ("WARC-Refers-To", f"<urn:page:{response}>" if first and response is not None else None),
                        ("WARC-Segment-Number", number if not (first and last) else None),
                        ("WARC-Segment-Origin-ID", None if first else f"<urn:page:{id_}>"),
                        ("WARC-Segment-Total-Length", len(body) + len(_HTTP) if last and not first else None),
                        ("Content-Type", "application/http; msgtype=response" if first else None),
                        ("X-Copy", copy),
                        ("X-Page", page),
                        ("Content-Length", len(http) + len(chunk)),
                    ]
                    value = b"".join([header(fields), http, chunk, EOL.encode()])  # the writer adds the last line end
                    held.append((page, copy, number, state.hexdigest(), value))
                    size_held += len(value)
                    if size_held >= _HELD:
                        yield batch()
                        held, size_held = [], 0
                if response is None and state.hexdigest() != digest.as_py():
                    raise ValueError(f"page {page}: the digest carried from chunk to chunk is not the payload's")
                copy += 1
        if held:
            yield batch()

    return rows.mapInArrow(write, "page_id long, copy long, chunk_no int, digest string, value string")


def write_archives(pages: DataFrame, path: str, size: int = CHUNK) -> str:
    """Writes one record a page (page_id, url, html) to gzipped WARC files under ``path``/archives."""
    revisits, mean = plan_records(pages, path)
    to, records = f"{path}/archives", max(1, FILE // (mean + 1024))
    rows = record_chunks(pages, revisits, size).select("value")
    rows.write.mode("overwrite").option("lineSep", EOL).option("compression", "gzip").option("maxRecordsPerFile", records).text(to)
    return to


def read_segments(spark: SparkSession, archives: str) -> DataFrame:
    """One row for each segment: page_id, copy, record_type, refers_to, declared (digest), chunk_no, total, payload."""
    text = spark.read.option("lineSep", VERSION).text(archives).where("value <> ''")
    head = F.substring_index("value", EOL + EOL, 1)
    rows = text.select(F.expr(r"str_to_map(substring_index(value, '\r\n\r\n', 1), '\r\n', ': ')").alias("h"), F.substr("value", F.length(head) + 5).alias("rest"))
    rows = rows.select("h", F.expr("left(rest, length(rest) - 4)").alias("block"))
    sound = F.octet_length("block") == F.col("h")["Content-Length"].cast("int")
    block = F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("a record's length is not as declared: "), F.col("h")["WARC-Record-ID"])))
    http = F.substring_index("block", EOL + EOL, 1)
    payload = F.when(F.col("h")["WARC-Type"] == "continuation", F.col("block")).otherwise(F.substr("block", F.length(http) + 5))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)", 1).cast("long")
    return rows.withColumn("block", block).select(
        F.col("h")["X-Page"].cast("long").alias("page_id"),
        F.col("h")["X-Copy"].cast("long").alias("copy"),
        F.col("h")["WARC-Type"].alias("record_type"),
        number(F.col("h")["WARC-Refers-To"]).alias("refers_to"),
        F.substring_index(F.col("h")["WARC-Payload-Digest"], ":", -1).alias("declared"),
        F.coalesce(F.col("h")["WARC-Segment-Number"].cast("int"), F.lit(0)).alias("chunk_no"),
        F.col("h")["WARC-Segment-Total-Length"].cast("long").alias("total"),
        payload.alias("payload"),
    )


def segmented_digests(segments: DataFrame) -> DataFrame:
    """page_id, copy, bytes and digest of payloads in several segments, whose chunks pass one at a time."""

    def carry(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, want = None, None, 0, 0
        out: list[tuple] = []

        def close() -> None:
            if now is not None:
                out.append((now[0], now[1], n, state.hexdigest()))

        for part in parts:
            page, copy, number, payload = (part.column(i) for i in range(4))
            for i in range(part.num_rows):
                key = (page[i].as_py(), copy[i].as_py())
                if key != now:
                    close()
                    now, state, n, want = key, hashlib.sha256(), 0, 1
                if number[i].as_py() != want:
                    raise ValueError(f"page {key[0]}: segment {want} is missing")
                chunk = payload[i].as_py()
                state.update(chunk)
                n, want = n + len(chunk), want + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page_id", "copy", "bytes", "digest"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page_id", "copy", "bytes", "digest"])

    rows = segments.where("chunk_no > 0").select("page_id", "copy", "chunk_no", F.col("payload").cast("binary").alias("payload"))
    dealt = rows.repartition(common.partitions_for(segments), "page_id", "copy").sortWithinPartitions("page_id", "copy", "chunk_no")
    return dealt.mapInArrow(carry, "page_id long, copy long, bytes long, digest string")


def read_archives(spark: SparkSession, archives: str, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, digests as computed on reading."""
    segments = read_segments(spark, archives)
    thin = segments.where("chunk_no <= 1").select("page_id", "copy", "record_type", "refers_to", "declared", "chunk_no", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    thin = common.materialise(thin, f"{path}/records")
    long_ = common.materialise(segmented_digests(segments), f"{path}/segmented")
    whole = thin.where("record_type = 'response' AND chunk_no = 0").select("page_id", "declared", "bytes", "digest")
    parted = thin.where("record_type = 'response' AND chunk_no = 1").drop("bytes", "digest").join(long_, ["copy"]).select(thin.page_id, "declared", "bytes", "digest")
    responses = whole.unionByName(parted)
    sound = F.when(F.col("declared") == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a payload's digest is not as declared: "), F.col("declared"))))
    responses = responses.select("page_id", "bytes", sound.alias("digest"))
    revisits = thin.where("record_type = 'revisit'").select("page_id", "refers_to", F.concat_ws(":", F.col("refers_to").cast("string"), "declared").alias("key"))
    known = responses.groupBy(F.concat_ws(":", F.coalesce("page_id", F.lit(common.LAST_ID)).cast("string"), "digest").alias("key")).agg(F.first("bytes").alias("bytes"), F.first("digest").alias("digest"))
    met = common.salted_lookup(revisits, known, "key", f"{path}/by-response", by="page_id")
    return responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        met.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    )


def op4_warc(spark, sf_dir: str, size: int = CHUNK) -> DataFrame:
    """Null html counts as empty; a null page_id comes last, so it is a response only where no other has its payload.

    Repeated rows are records of their own, all of the kind of their page_id. An empty table gives no rows.
    """
    path = common.shared_dir(spark)
    return read_archives(spark, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, size), path)


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS response FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND response <> page_id THEN response END AS refers_to
FROM f
"""
