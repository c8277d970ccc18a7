"""WARC archives: writing, and reading record by record.

An archive is a run of records, each in a gzip member of its own. The reader inflates the stream in
pieces, member by member, cuts header and block out by Content-Length, and holds the block and payload
digests against the bytes it read. It keeps one record in memory at a time, however long the archive.

Pages become HTTP response records. Of pages with equal payloads of at least REVISIT_BYTES, the one with
the smallest id is a response and the others are revisit records, which carry the HTTP header (with the
payload's full length) and the payload's digest, but not the payload.

Defined cases: a null html is an empty payload; smaller payloads are always responses; rows that repeat
the smallest page id of their payload are responses all; a null page id is written as "null", and a group
of equal payloads that has no other id is all responses; a null url leaves the page's urn as target; line
ends in a url are percent-encoded; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import TaskFile, arrow_rows, open_file, stored, table, work_dir

REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 28
READ_BYTES = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that breaks the format or whose bytes don't match its digest."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header."""
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int:
        """Length of the full payload, which a revisit's HTTP header states."""
        if self.kind != "revisit":
            return len(self.payload)
        for line in self.block.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                return int(line.split(b":")[1])
        raise WarcError("a revisit without its payload's length")

    @property
    def payload_digest(self) -> str:
        return self.headers["warc-payload-digest"].removeprefix("sha256:")


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _page(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last == "null" else int(last)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None,
                  date: str = DATE) -> bytes:
    """One gzip member: a response, or a revisit of the page ``refers_to``."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http if refers_to is not None else http + payload
    target = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url) if url else _urn(page_id)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<{_urn(page_id)}>"), ("WARC-Date", date), ("WARC-Target-URI", target)]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_urn(refers_to)}>")]
    head += [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
             ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The inflated bytes of each gzip member of ``stream``, read ``size`` bytes at a time."""
    left = b""
    while True:
        left = left or stream.read(size)
        if not left:
            return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            out.append(z.decompress(left))
            left = z.unused_data
            if not z.eof:
                left = stream.read(size)
                if not left:
                    raise WarcError("the archive ends within a record")
        yield b"".join(out)


def parse_record(raw: bytes) -> Record:
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise WarcError(f"not a WARC record: {raw[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"{headers.get('warc-record-id')}: Content-Length {n} doesn't match the record")
    record = Record(headers, block)
    if headers.get("warc-block-digest", "") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError(f"{headers.get('warc-record-id')}: block digest")
    if record.kind == "response" and record.payload_digest != hashlib.sha256(record.payload).hexdigest():
        raise WarcError(f"{headers.get('warc-record-id')}: payload digest")
    return record


def read_records(stream) -> Iterator[Record]:
    """The records of an archive in order, digests verified."""
    return map(parse_record, members(stream))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; (file, records) of each."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # stored, so that the join deals both sides anew and can split a payload that many pages share
    rows = rows.join(stored(again, "firsts"), "digest", "left").withColumn(
        "refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    made = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, f, n, size = TaskContext.get().partitionId(), 0, None, 0, 0
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f is None:
                    f, n, size = TaskFile(folder, f"pages-{part:06d}-{k:04d}", ".warc.gz"), 0, 0
                raw = encode_record(page_id, url, payload, refers_to)
                f.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    yield arrow_rows(made, [(f.commit(), n)])
                    f, k = None, k + 1
        if f is not None:
            yield arrow_rows(made, [(f.commit(), n)])

    files = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "file string, records long")
    return stored(files, "archives")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target of every record."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("target", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with open_file(folder, name) as stream:
                    for r in read_records(stream):
                        to = r.headers.get("warc-refers-to")
                        rows.append((_page(r.headers["warc-record-id"]), r.payload_bytes, r.payload_digest, r.kind,
                                     _page(to) if to else None, r.headers["warc-target-uri"]))
                        if len(rows) >= 4096:
                            yield arrow_rows(schema, rows)
                            rows = []
                yield arrow_rows(schema, rows)

    spread = files.select("file").repartition(max(1, files.count()))
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                   "refers_to long, target string")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES}
                     THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url AS target FROM f
"""
