"""Operator 1: WARC archives with repeated payloads as revisits, and the normaliser for whole-file gzip archives.

Writers that compress an archive as one gzip stream leave it without entry points. The normaliser inflates such a stream
once, writes every record as a gzip member of its own and a sidecar index of (offset, length) per record, so that any
record can then be read by itself.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import scratch_path, table, written

_RECORD_ID = "urn:quillstone:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: The base32 alphabet of RFC 4648.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


#: Up to this many revisits are sent to all tasks; more are joined by a shuffle of the pages.
BROADCAST_REVISITS = 500_000


def base32(digest: Column) -> Column:
    """Upper-case base32 of a hex SHA-1: four letters for every five hex digits."""
    letters = []
    for k in range(8):
        v = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, digest, refers_to)`` of each distinct page and payload that is a revisit.

    Of equal payloads of at least ``least_bytes`` the largest page_id is the response. Only ids and digests are moved.
    """
    small = written(pages.select("page_id", F.sha1("html").alias("digest"), (F.octet_length("html") >= least_bytes).alias("large")).distinct(), "payloads")
    last = small.groupBy("digest").agg(F.max("page_id").alias("last"))
    joined = small.join(last.hint("merge"), "digest")
    again = F.col("large") & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.filter(again).select("page_id", "digest", F.col("last").alias("refers_to"))


def record_text(date: str) -> Column:
    """A WARC 1.1 record without its last line feed, which the text writer adds."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    size = F.octet_length("html")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(_HTTP), size.cast("string"), F.lit("\r\n\r\n"))
    url = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20"), F.lit("\r\n"))).otherwise("")
    refers = F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{_RECORD_ID}"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise("")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{_RECORD_ID}"),
        page,
        F.lit(f">\r\nWARC-Date: {date}\r\n"),
        url,
        refers,
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "),
        size.cast("string"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit("\r\n\r\n"),
        http,
        body,
        F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, records_per_file: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages(page_id, url, html, …)`` as whole-file gzip WARC files with Spark's own text writer."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    plan = written(revisits(own, least_bytes), "revisits")
    keyed = own.withColumn("digest", F.sha1("html"))
    on = keyed["page_id"].eqNullSafe(plan["page_id"]) & (keyed["digest"] == plan["digest"])
    small = plan.count() <= BROADCAST_REVISITS
    records = keyed.join(plan.hint("broadcast" if small else "shuffle_hash"), on, "left").select(keyed["page_id"], "url", "html", keyed["digest"], "refers_to")
    records = records.withColumn("digest", base32(F.col("digest")))
    # these archives are read once, by the normaliser: they are written at the fastest level
    out = records.select(record_text(date).alias("value")).write.option("maxRecordsPerFile", records_per_file)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


def inflate(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or many members."""
    engine = zlib.decompressobj(31)
    while raw := stream.read(chunk):
        while raw:
            data = engine.decompress(raw)
            if data:
                yield data
            raw = b""
            if engine.eof:
                raw, engine = engine.unused_data, zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, header bytes, block) of each record of an inflated archive; only one record is held at a time."""
    held, at = bytearray(), 0

    def fill() -> bool:
        nonlocal held, at
        more = next(chunks, None)
        if more is None:
            return False
        if at:
            del held[:at]
            at = 0
        held += more
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not fill():
                if held[at:].strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        head = bytes(held[at:end])
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(headers["content-length"])
        begin = end + 4 - at
        while len(held) - at < begin + size + 4:
            if not fill():
                raise ValueError("an archive ends inside a record")
        block = bytes(held[at + begin : at + begin + size])
        if held[at + begin + size : at + begin + size + 4] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        at += begin + size + 4
        yield headers, head, block


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrite every ``*.gz`` archive of ``source`` with a member per record and a ``.idx`` sidecar (JSON lines).

    A task streams one archive at a time. Returns ``(archive, records, bytes)``. No archive: an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                name = path.rpartition("/")[2].split(".")[0]
                target, index = f"{folder}/{name}.warc.gz", []

                def members(path: str = path, index: list = index) -> Iterator[bytes]:
                    at = 0
                    with files.stream(_uri(path)) as f:
                        for headers, head, block in records(inflate(f)):
                            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = deflate.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()
                            index.append(json.dumps({"offset": at, "length": len(member), "type": headers.get("warc-type"), "id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri")}))
                            at += len(member)
                            yield member

                size = files.put(target, members())
                files.put(f"{folder}/{name}.idx", ["\n".join(index).encode()])
                out.append((target, len(index), size))
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "bytes"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    n = max(1, min(found.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return written(found.repartition(n).mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read each record through the sidecar index, by itself, and check its payload against its digest.

    Returns ``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` and, if asked for, the payload (null for
    revisits).
    """

    def page(value: str | None) -> int | None:
        text = (value or "").strip("<>").removeprefix(_RECORD_ID)
        return None if text in ("", "null") else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], [name for name, _ in kinds])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.stream(path.removesuffix(".warc.gz") + ".idx") as f:
                    index = [json.loads(line) for line in f.read().decode().split("\n") if line]
                rows = []
                with files.at(path) as f:
                    for entry in index:
                        f.seek(entry["offset"])
                        headers, _, block = next(records(iter([zlib.decompress(f.read(entry["length"]), 31)])))
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        size, payload = int(headers["warc-payload-length"]), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size = len(payload)
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{path}: a payload differs from its digest")
                        rows.append((page(headers["warc-record-id"]), size, digest, kind, page(headers.get("warc-refers-to"))) + ((payload,) if with_payload else ()))
                        if len(rows) >= 1000:
                            yield make(rows)
                            rows = []
                if rows:
                    yield make(rows)

    spark = archives.sparkSession
    n = max(1, min(archives.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("archive").repartition(n).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back ``pages(page_id, url, html, …)``; one row per input row.

    Null html is an empty payload, a null url has no target header. A null page_id never is what others refer to unless
    all of the payload's ids are null. Repeated rows give a record each; those of the largest id are all responses. An
    empty table gives no rows. Other columns are ignored.
    """
    write_archives(pages, f"{folder}/raw", least_bytes)
    return read_archives(normalise(pages.sparkSession, f"{folder}/raw", f"{folder}/warc"))


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS last FROM d GROUP BY hex),
b AS (SELECT d.*, m.last, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(d.hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1)) AS letters
      FROM d JOIN m USING (hex))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM b
"""
