"""WARC archives: writing, normalising monolithic gzip, an offset index, and reading back.

Archives are first written as one gzip stream each, as many tools leave them. The
normaliser inflates such a stream once, piece by piece, and writes every record as a gzip
member of its own, with a sidecar index of offsets; then any record can be read alone.
Memory is bounded by one record.

Payloads that occur more than once are stored once: the record of the largest page_id is
the response, the others revisit it by its digest (rows that repeat the largest page_id
are responses too). Control characters of a url are left out of its header. A null html is an empty payload; a null page_id is written as `-` and
read back as null, and such rows are never revisited by others unless all are null; a null
url is an empty target. An empty table gives no archive and no rows; other columns aren't
read. A payload, and the index of one archive, is held whole. Files lie in the folder that the cluster shares, under names of
their own for each attempt; only the attempt whose row arrives counts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, keep, place
from .workers import by_batch

#: Bytes of records after which an archive is closed.
ARCHIVE = 64 << 20
#: Parts that a hot payload is dealt into.
SALT = 32


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """A response, or with `refers` a revisit without body, which names the response and the payload's size."""
    name = "-" if page is None else str(page)
    target = "".join(c for c in url or "" if c >= " ")
    lines = [
        "WARC/1.0", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Payload-Length: {len(payload)}"]
        payload = b""
    return ("\r\n".join([*lines, f"Content-Length: {len(payload)}"]) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _open(path: str, mode: str):
    system, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_file(at) if mode == "seek" else system.open_input_stream(at, compression=None)


def _write(folder: str):
    """Rows of page_id, url, html, refers to archives, each one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = press = path = None
        size = count = 0

        def close() -> pa.RecordBatch:
            out.write(press.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers")), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, press, size, count = _open(path, "w"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(page, url, (html or "").encode(), refers)
                out.write(press.compress(data))
                size += len(data)
                count += 1
                if size >= ARCHIVE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def inflate(stream, step: int = 1 << 18) -> Iterator[bytes]:
    """The content of gzip data, whatever its number of members."""
    press = zlib.decompressobj(31)
    while data := stream.read(step):
        while data:
            yield press.decompress(data)
            data = press.unused_data
            if press.eof:
                press = zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of inflated data, by their Content-Length."""
    held = bytearray()
    need = 0  # bytes of the record at the start of held, once known
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                length = next(line for line in bytes(held[:head]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
                need = head + 4 + int(length.split(b":")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("an archive ends inside a record")


def normalise(source: str, target: str) -> int:
    """Rewrite an archive with one gzip member for each record; its index goes to target + ".idx", a JSON line each."""
    offset = count = 0
    with _open(source, "r") as stream, _open(target, "w") as out, _open(target + ".idx", "w") as index:
        for data in records(inflate(stream)):
            press = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = press.compress(data) + press.flush()
            out.write(member)
            headers, _ = parse(data)
            entry = {"offset": offset, "length": len(member), "id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "uri": headers["WARC-Target-URI"], "digest": headers["WARC-Payload-Digest"]}
            index.write(json.dumps(entry).encode() + b"\n")
            offset += len(member)
            count += 1
    return count


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, count in zip(*(batch.column(c).to_pylist() for c in ("path", "records")), strict=True):
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                if normalise(source, target) != count:
                    raise ValueError(f"{source} lost records")
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([count], pa.int64())], ["path", "records"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda s: None if s is None or s == "<urn:page:->" else int(s[10:-1])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _open(path + ".idx", "r") as index:
                entries = [json.loads(line) for line in index.read().splitlines()]
            rows, size = [], 0
            with _open(path, "seek") as stream:
                for entry in entries:
                    stream.seek(entry["offset"])
                    headers, body = parse(zlib.decompress(stream.read(entry["length"]), 31))
                    kind = headers["WARC-Type"]
                    if kind == "response" and f"sha1:{digest(body)}" != headers["WARC-Payload-Digest"]:
                        raise ValueError(f"a payload of {path} is damaged")
                    length = len(body) if kind == "response" else int(headers["WARC-Payload-Length"])
                    rows.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], body.decode() if kind == "response" else None, length, headers["WARC-Payload-Digest"][5:], kind, number(headers.get("WARC-Refers-To"))))
                    size += length
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def write(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic archives; returns their paths and numbers of records.

    Payloads travel only if a repeated one has to be found by a shuffle join; a hot one is salted.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = source.withColumn("sum", F.sha2("html", 256))
    several = marked.groupBy("sum").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 and latest is not null")
    several = keep(several.select("sum", "latest"), "payloads").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = marked.withColumn("part", F.pmod(F.hash("page_id", "url"), F.lit(SALT)))
    told = dealt.join(several, ["sum", "part"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers"))
    return keep(by_batch(told, _write(place(spark, "warc")), "path string, records long"), "archives")


def normalised(archives: DataFrame) -> DataFrame:
    """Paths of archives with one member for each record, and an index beside each."""
    spark = archives.sparkSession
    spread = archives.repartition(max(1, archives.count()))
    return keep(by_batch(spread, _normalise(place(spark, "warc-members")), "path string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives: page_id, url, payload (of responses), payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return by_batch(archives.repartition(max(1, archives.count())), _read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """pages through archives and back; the monolithic archives are deleted once they are normalised."""
    first = write(pages)
    members = normalised(first)
    for row in first.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect():  # one folder
        discard(pages.sparkSession, row.folder)
    return read(members)
