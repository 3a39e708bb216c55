"""WARC archives with segmented records.

The writer gives every page a response record, or a revisit record where a later page has the same payload.
Response bodies use chunked transfer coding; blocks above a size are cut into a first record and continuation
records, which may land in any archive. The reader parses archives one by one, groups segments by the identifier
of their origin record, orders them by number, verifies that none is missing and that the total length is the
stated one, and decodes the chunked framing.

Each record is a gzip member of its own, so one can be read alone. Archives are written by Spark's own committing
text writer (a row is bytes; the separator is the last byte of a member, 0 in all below 16 MB), so they can live in
any store and a lost executor leaves no half of an archive. An archive holds a bounded number of records, and a record
a bounded block. The reader takes plain archives as well and holds one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm._common import new_path, small_batches, written

#: Bytes of a record's block and of a chunk, at most; records of an archive, at most.
SEGMENT, CHUNK, RECORDS = 16 * 1024, 4 * 1024, 4096
CRLF, GZIP = b"\r\n", b"\x1f\x8b"


#: DuckDB SQL of the query's rows: base 32 is spelt from five hexadecimal digits at a time.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), h AS (SELECT *, sha1(body) AS x, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM h"""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            break
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk ends early")
        at += size + 2
    while not body.startswith(CRLF, at):
        at = body.index(CRLF, at) + 2
    return b"".join(out)


def record(fields: dict[str, str], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields.items()), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    """A gzip member without its last byte if that is 0; otherwise whole (a reader skips the zero that follows)."""
    packed = gzip.compress(data, 6, mtime=0)
    return packed[:-1] if packed.endswith(b"\0") else packed


def records(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of a stream's records, one after another."""
    while version := data.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        fields: dict[str, str] = {}
        while (line := data.readline()) != CRLF:
            if not line.endswith(CRLF):
                raise ValueError("a record ends early")
            name, _, value = line.partition(b":")
            fields[name.lower().decode()] = value.strip().decode()
        size = int(fields["content-length"])
        block = data.read(size)
        if len(block) != size or data.read(4) != CRLF + CRLF:
            raise ValueError("a record ends early")
        yield fields, block


def opened(archive: bytes) -> io.BufferedIOBase:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive))) if archive.startswith(GZIP) else io.BytesIO(archive)


def segments(fields: dict[str, str], block: bytes, size: int = SEGMENT) -> list[bytes]:
    """The record, or its segments if the block is above size."""
    if len(block) <= size:
        return [record(fields, block)]
    parts = [block[k : k + size] for k in range(0, len(block), size)]
    origin, out = fields["WARC-Record-ID"], [record(fields | {"WARC-Segment-Number": "1"}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{origin[:-1]}:{n}>", "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": str(n)}
        if n == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        out.append(record(more, part))
    return out


def assemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length, part) in any order; raises if a segment is missing or a length is wrong."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[2] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing or repeated")
    if len(parts) > 1 and parts[-1][1] != len(block):
        raise ValueError("the total length is not the stated one")
    return block


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT, archives: int | None = None, most: int = RECORDS) -> None:
    """Write a record for every row of pages (page_id, url, html) into archives under path.

    Rows with payloads equal to another's, of ``least`` bytes or more, are revisits of the row with the largest
    page_id (of repeated ids, the last read). A null html is an empty payload, a null url leaves the target out,
    a null page_id counts below all others. Other columns are ignored; without rows no record is written. With a
    number of archives, records (segments among them) are dealt out to so many tasks; an archive has ``most`` records
    at most.
    """
    spark = pages.sparkSession
    small_batches(spark, 256)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.monotonically_increasing_id().alias("rid"))
    heads = written(rows.groupBy("sha1").agg(F.max(F.struct("page_id", "rid")).alias("head")), "heads")
    joined = rows.join(heads, "sha1").select("page_id", "url", "html", "rid", F.col("head.page_id").alias("head_page"), F.col("head.rid").alias("head_rid"))

    def uri(page: object, rid: int) -> str:
        return f"<urn:x-granary:page:{'' if page is None else page}:{rid}>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload = r["html"].encode("utf-8")
                fields = {"WARC-Type": "response", "WARC-Record-ID": uri(r["page_id"], r["rid"]), "WARC-Date": date}
                if r["url"] is not None:
                    fields["WARC-Target-URI"] = quote(r["url"], safe="%/:=&?~#+!$,;'@()*[]")
                fields |= {"WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "Content-Type": "application/http; msgtype=response"}
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if len(payload) >= least and r["rid"] != r["head_rid"]:
                    fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": uri(r["head_page"], r["head_rid"])}
                    out.append(record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload)))
                else:
                    out += segments(fields, head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload), segment)
            yield pa.RecordBatch.from_arrays([pa.array(map(member, out), pa.binary())], ["record"])

    made = joined.mapInArrow(build, "record binary")
    if archives:
        made = made.repartition(archives, F.xxhash64("record"))
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", most).text(path)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives under path, reassembled: page_id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri and payload (null for revisits, or without with_payload).

    A record without segments is decoded and verified where it is read; only segments are shuffled with their blocks.
    """

    def decoded(kind: str, digest: str, block: bytes, origin: str) -> tuple[bytes | None, int]:
        """(payload, its size) of a whole block; raises if the digest is another."""
        head, _, body = block.partition(CRLF + CRLF)
        http = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
        if kind == "revisit":
            return None, int(http[b"content-length"])
        payload = dechunked(body) if http.get(b"transfer-encoding") == b"chunked" else body
        if payload_digest(payload) != digest.removeprefix("sha1:"):
            raise ValueError(f"the payload of {origin} has another digest")
        return payload, len(payload)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for f, block in records(opened(content.as_buffer().to_pybytes())):
                    number, total, size = f.get("warc-segment-number"), f.get("warc-segment-total-length"), None
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    if number is None:
                        payload, size = decoded(f["warc-type"], f["warc-payload-digest"], block, origin)
                        block = payload if with_payload else None
                    out.append({"origin": origin, "number": int(number or 1), "total": total and int(total), "kind": f["warc-type"], "digest": f.get("warc-payload-digest"),
                                "refers": f.get("warc-refers-to"), "uri": f.get("warc-target-uri"), "block": block, "size": size})
                yield pa.RecordBatch.from_pylist(out, schema=part)

    part = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("uri", pa.string()), ("block", pa.binary()), ("size", pa.int64())])
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parts = found.mapInArrow(parse, "origin string, number int, total long, kind string, digest string, refers string, uri string, block binary, size long")
    grouped = parts.groupBy("origin").agg(F.collect_list(F.struct("number", "total", "kind", "digest", "refers", "uri", "block", "size")).alias("parts"))

    def page_of(uri: str | None) -> int | None:
        name = uri and uri.split(":")[3]
        return int(name) if name else None

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, got in zip(batch["origin"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                first = min(got, key=lambda p: p["number"])
                if first["size"] is None:
                    payload, size = decoded(first["kind"], first["digest"], assemble([(p["number"], p["total"], p["block"]) for p in got]), origin)
                elif len(got) == 1:
                    payload, size = first["block"], first["size"]
                else:
                    raise ValueError(f"{origin} is repeated")
                digest = first["digest"].removeprefix("sha1:")
                out.append({"page_id": page_of(origin), "payload_bytes": size, "payload_digest": digest, "record_type": first["kind"], "refers_to": page_of(first["refers"]), "target_uri": first["uri"], "payload": payload if with_payload else None})
            yield pa.RecordBatch.from_pylist(out, schema=whole)

    whole = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])
    return grouped.mapInArrow(join, _READ)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back, a row a page; no rows give none."""
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, with_payload=False).drop("payload")
