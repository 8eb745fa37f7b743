"""WARC archives as a table of record chunks: written, deduplicated by payload and read back."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.llm.common import partitions, written
from tabsift.operators.joins import keyed_join
from tabsift.session import scratch_path

CHUNK_BYTES = 1 << 20
CRLF = "\r\n"

CHUNKS = pa.schema([
    ("uid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int64()),
    ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
    ("data", pa.binary()),
])
SEGMENTS = pa.schema([
    ("record", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("refers", pa.string()), ("declared", pa.string()), ("segment", pa.int64()),
    ("total", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()),
    ("data", pa.binary()),
])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of each page's html, at most ``chunk_bytes`` long each.

    Every row carries the record's number, its own number, and the SHA-1 of the payload up to its
    end, so the last one holds the digest of the whole; the digest is taken chunk by chunk over
    views of the column's buffer. A null or empty payload is one empty chunk.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, part, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for page, url, html in zip(ids, urls, batch.column(2)):
                view = memoryview(html.as_buffer())
                digest, number, start = hashlib.sha1(), 0, 0
                while True:
                    piece = view[start:start + chunk_bytes]
                    start += len(piece)
                    digest.update(piece)
                    last = start >= len(view)
                    part.append((uid, page, url, number, last, start, base32(digest.digest()),
                                 bytes(piece)))
                    held += len(piece)
                    number += 1
                    if held >= 8 * chunk_bytes or len(part) >= 4096:
                        yield _batch(part, CHUNKS)
                        part, held = [], 0
                    if last:
                        break
                uid += 1
        if part:
            yield _batch(part, CHUNKS)

    return rows.mapInArrow(cut, _ddl(CHUNKS))


def revisits(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``uid, origin, origin_page`` of the records that only point at an equal payload.

    Of equal payloads of at least ``min_bytes`` the record with the smallest page id (null ids
    last, then the smallest record number) keeps its payload. The first record per digest is a
    combining aggregate, so a payload that a third of the pages share never meets in one task.
    """
    whole = chunks.filter("last").select("uid", "page_id", "bytes_so_far", "digest_so_far")
    whole = whole.filter(F.col("bytes_so_far") >= min_bytes)
    firsts = whole.groupBy(F.col("digest_so_far").alias("_digest")).agg(
        F.min(F.struct(F.col("page_id").isNull(), "page_id", "uid")).alias("_f"),
        F.count("*").alias("_n"),
    ).filter("_n > 1")
    joined = keyed_join(whole, firsts, {"digest_so_far": "_digest"})
    return joined.filter(F.col("uid") != F.col("_f.uid")).select(
        "uid", F.col("_f.uid").alias("origin"), F.col("_f.page_id").alias("origin_page"),
    )


def write_archive(
    pages: DataFrame, path: str, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one record per page below ``path`` as gzipped WARC 1.1 files.

    A payload longer than ``chunk_bytes`` becomes a first segment and ``continuation`` records, the
    standard's own form for it, so a row is never longer than a chunk and segments may lie in
    different files. Files are written by Spark's committer: a lost executor's files are redone.
    """
    chunks = written(chunk_rows(pages, chunk_bytes), "records", "zstd")
    again = written(revisits(chunks, min_revisit_bytes), "revisits")
    ends = chunks.filter("last and chunk > 0").select(
        "uid", F.lit(None).cast("long").alias("origin"), F.col("bytes_so_far").alias("_total"),
        F.col("digest_so_far").alias("_digest"), F.col("chunk").alias("_lastchunk"))
    pointers = again.select("uid", "origin").withColumns({
        "_total": F.lit(None).cast("long"), "_digest": F.lit(None).cast("string"),
        "_lastchunk": F.lit(None).cast("long")})
    side = ends.unionByName(pointers).groupBy(F.col("uid").alias("_uid")).agg(
        *[F.max(c).alias(c) for c in ("origin", "_total", "_digest", "_lastchunk")])
    rows = keyed_join(chunks, side, {"uid": "_uid"}, "left").filter("origin is null or chunk = 0")
    lines = rows.select(_record(date).alias("value"))
    lines.write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def _record(date: str) -> Column:
    """One WARC record as text; the writer's line end is the second of the two that close it."""
    uid, total = F.col("uid"), F.coalesce("_total", "bytes_so_far")
    digest = F.coalesce("_digest", "digest_so_far")
    revisit, first = F.col("origin").isNotNull(), F.col("chunk") == 0
    segmented = F.col("_lastchunk").isNotNull() & ~revisit
    name = lambda number: F.concat(F.lit("<urn:record:"), number.cast("string"), F.lit(">"))

    def field(key: str, value: Column, when: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit(CRLF))
        given = value.isNotNull() if when is None else when & value.isNotNull()
        return F.when(given, line).otherwise("")

    http = F.when(first, F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        total.cast("string"), F.lit(CRLF + CRLF))).otherwise("")
    body = F.when(revisit, F.lit("")).otherwise(F.col("data").cast("string"))
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    own = F.when(first, name(uid)).otherwise(
        F.concat(F.lit("<urn:record:"), uid.cast("string"), F.lit("."), F.col("chunk").cast("string"), F.lit(">")))
    length = F.octet_length(http) + F.octet_length(body)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", kind), field("WARC-Record-ID", own),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        field("X-Page-ID", F.col("page_id")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest), first),
        field("WARC-Refers-To", name(F.col("origin"))),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        field("WARC-Segment-Number", F.col("chunk") + 1, segmented),
        field("WARC-Segment-Origin-ID", name(uid), segmented & ~first),
        field("WARC-Segment-Total-Length", total, segmented & (F.col("chunk") == F.col("_lastchunk"))),
        field("Content-Type", F.lit("application/http; msgtype=response"), first),
        field("Content-Length", length), F.lit(CRLF), http, body, F.lit(CRLF),
    )


def read_segments(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per WARC record below ``path``, segments apart.

    Lines reach Python in bounded batches and a record is cut out by its Content-Length, whatever
    its block holds. ``digest`` and ``payload_bytes`` are taken from the bytes read. Without
    ``payloads`` only segments of longer payloads keep their data.
    """
    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("value").cast("binary"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        head: dict[str, str] = {}
        need, got, block, in_block, trailer = 0, 0, [], False, False
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if trailer:
                    if line:
                        raise ValueError("a WARC record does not end where its length says")
                    trailer = False
                elif in_block:
                    block.append(line)
                    got += len(line)
                    if got < need:
                        block.append(b"\r\n")
                        got += 2
                    elif got > need:
                        raise ValueError("a WARC record is longer than its length says")
                    else:
                        row = _segment(head, b"".join(block), payloads)
                        held += len(row[-1] or b"")
                        out.append(row)
                        head, block, in_block, trailer = {}, [], False, True
                        if held >= 8 * CHUNK_BYTES or len(out) >= 4096:
                            yield _batch(out, SEGMENTS)
                            out, held = [], 0
                elif line:
                    key, _, value = line.decode("utf-8", "replace").partition(": ")
                    head[key] = value
                else:
                    need, got, in_block = int(head["Content-Length"]), 0, True
        if in_block or head:
            raise ValueError("a WARC file ends inside a record")
        if out:
            yield _batch(out, SEGMENTS)

    return lines.mapInArrow(parse, _ddl(SEGMENTS))


def _segment(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = head["WARC-Type"]
    data = block if kind == "continuation" else block[block.index(b"\r\n\r\n") + 4:]
    number = int(head["WARC-Segment-Number"]) if "WARC-Segment-Number" in head else None
    total = head.get("WARC-Segment-Total-Length")
    page = head.get("X-Page-ID")
    return (
        head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), kind,
        None if page is None else int(page), head.get("WARC-Target-URI"),
        head.get("WARC-Refers-To"), head.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
        number, None if total is None else int(total), len(data),
        base32(hashlib.sha1(data).digest()) if number is None else None,
        data if payloads or number is not None else None,
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record.

    Digests and lengths are those of the bytes read. Segments of a longer payload are brought
    together by record, sorted, and digested one after the other, one segment in memory at a time.
    A revisit takes both from the record it points at. A record whose bytes do not give the digest
    it declares fails the job.
    """
    segments = written(read_segments(spark, path, payloads=False), "segments")
    single = segments.filter("segment is null").drop("data")
    longer = segments.filter("segment is not null").repartition(partitions(spark), "record")
    longer = longer.sortWithinPartitions("record", "segment")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, digest, size, expected = None, None, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["segment"] == 1:
                    first, digest, size, expected = row, hashlib.sha1(), 0, 1
                if first is None or row["segment"] != expected or row["record"] != first["record"]:
                    raise ValueError(f"segment {expected} of {row['record']} is missing")
                digest.update(row["data"])
                size += len(row["data"])
                expected += 1
                if row["total"] is not None:
                    if size != row["total"]:
                        raise ValueError(f"{row['record']} is not as long as it says")
                    done = first | {"digest": base32(digest.digest()), "payload_bytes": size}
                    out.append(tuple(done[c] for c in SEGMENTS.names[:-1]))
                    first = None
            if out:
                yield _batch(out, pa.schema(list(SEGMENTS)[:-1]))

    whole = single.unionByName(longer.mapInArrow(join, _ddl(pa.schema(list(SEGMENTS)[:-1]))))
    responses = whole.filter("type = 'response'").select(
        F.col("record").alias("_record"), F.col("page_id").alias("_page"),
        F.col("payload_bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    same = lambda digest: F.when(
        F.col("declared") == digest, digest
    ).otherwise(F.raise_error(F.concat(F.lit("the payload differs from its digest: "), "record")))
    kept = whole.filter("type = 'response'").select(
        "page_id", "payload_bytes", same(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    pointing = keyed_join(whole.filter("type = 'revisit'"), responses, {"refers": "_record"}, "left")
    pointed = pointing.select(
        "page_id", F.col("_bytes").alias("payload_bytes"),
        same(F.coalesce("_digest", F.lit("none"))).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("_page").alias("refers_to"))
    return kept.unionByName(pointed)


def archive(pages: DataFrame, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back.

    ``page_id``, ``url`` and ``html`` are used, other columns are not read. Null html is an empty
    payload; a null url or page id is left out of its record. Repeated rows are records of their
    own: one response, the others revisit it. An empty table gives an empty table.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_revisit_bytes, chunk_bytes)
    return read_records(pages.sparkSession, path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)
