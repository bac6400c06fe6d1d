"""WARC archives: written from a table, read back record by record.

Writing: every task streams its rows into one archive in the shared folder, one
gzip member for each record.  Of records with equal payloads one is a response;
the others are revisits that refer to it and carry the HTTP header alone.

Reading: :func:`read_records` is a sequential reader that never holds more than
one record: it inflates a member at a time, frames the block by Content-Length
and verifies the block's and the payload's digests.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, lean, materialise, new_path

#: Payloads with fewer bytes are always stored in full.
LEAST_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
READ = 1 << 16
#: Revisits up to this many (16 bytes each) may be broadcast to their pages; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


class WarcError(ValueError):
    """An archive that is cut off or that fails a digest."""


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(m[1]) if m else None


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with a response, or with a revisit where ``payload`` is None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if payload is None else http + payload
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of ``stream``, inflated piece by piece."""
    rest = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            data = rest or stream.read(READ)
            rest = b""
            if not data:
                if parts:
                    raise WarcError("the last record is cut off")
                return
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
        rest = inflate.unused_data
        yield b"".join(parts)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, digests verified."""
    for data in members(stream):
        end = data.find(b"\r\n\r\n")
        lines = data[: max(end, 0)].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise WarcError("a record without a header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block, tail = data[end + 4 : end + 4 + length], data[end + 4 + length :]
        if len(block) != length or tail != b"\r\n\r\n":
            raise WarcError(f"{fields.get('warc-record-id')}: its length isn't its Content-Length")
        if fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise WarcError(f"{fields.get('warc-record-id')}: block digest")
        yield fields, block


def split_http(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """(payload, its length); the payload's digest is verified, and None for a revisit."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^Content-Length: *(\d+)", head)[1])
    if fields["warc-type"] == "revisit":
        return None, length
    if len(payload) != length or fields["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise WarcError(f"{fields.get('warc-record-id')}: payload digest")
    return payload, length


def write_warc(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Writes archives and returns their list: path, records, bytes.

    Payloads are compared by SHA-256 and length.  Only (page_id, digest) is
    shuffled to find the repeats, with partial aggregation, so a payload that a
    third of all pages share is no hot spot; the html itself stays where it is
    read unless the revisits are too many to broadcast.  Null html is an empty
    payload; a null page_id counts as the largest; rows alike in page_id and
    payload are all responses when theirs is the smallest.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    keys = rows.select("page_id", F.octet_length("html").cast("long").alias("length"), F.sha2("html", 256).alias("digest")).filter(F.col("length") >= least)
    first = keys.groupBy("digest", "length").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    first = materialise(first, "firsts")  # written, so that the join of a payload that very many pages share is plain and can be split
    again = materialise(keys.join(first, ["digest", "length"]).filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct(), "revisits")
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    digest = F.sha2("html", 256)
    rows = rows.withColumn("digest", digest).join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), F.octet_length("html").cast("long").alias("length"), "digest", "first")
    to = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(to)
        name, out, records, size = f"{folder}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                page, url, html, length, digest, first = (x.as_py() for x in row)
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                data = encode_record(page, url, None if html is None else html.encode(), length, digest, first)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:  # a file counts only once its task has returned its name
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]})

    return materialise(rows.mapInArrow(lean(run), "path string, records long, bytes long"), "archives")


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload (null: revisit), payload_bytes, payload_digest and refers_to of each record of the archives listed in ``path``."""
    to = new_path(archives.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(to)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        rows, held = [], 0
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            with fs.open_input_stream(path, compression=None) as stream:
                for fields, block in read_records(stream):
                    payload, length = split_http(fields, block)
                    rows.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], payload, length, fields["warc-payload-digest"].removeprefix("sha256:"), page_of(fields.get("warc-refers-to"))))
                    held += len(block)
                    if held > 4_000_000 or len(rows) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    listing = archives.select("path").repartition(max(1, min(archives.count(), 10_000)))
    return listing.mapInArrow(lean(run), "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """What the archives of ``pages`` say when they are read back, without the payloads."""
    return read_warc(write_warc(pages, **options)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for the rows of :func:`round_trip` over ``pages``.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM k)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM m"""
