"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame per record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, new_path, table

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
#: Payloads from this size on are stored once.
LEAST_REVISITED = 100
#: An archive is closed at this size, so one is never a task's whole memory.
ARCHIVE_BYTES = 64 << 20
#: Pages from which the dictionary is trained and characters of each (a bounded sample), and its size.
DICTIONARY_PAGES, DICTIONARY_CHARS, DICTIONARY_BYTES = 400, 16 << 10, 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A frame or record that does not conform."""


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit that names the response it repeats and carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%!#$&()*+,/:;=?@[]~' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        if out.setdefault(name.strip().decode().lower(), value.strip().decode()) != value.strip().decode():
            raise WarcError(f"two values of {name!r}")
    return out


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise WarcError(f"unknown record id {urn!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def parse_record(frame: bytes) -> dict:
    """Fields of the one record in a frame; raises WarcError on a bad version, header, length or digest."""
    head, sep, rest = frame.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not sep or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"bad version line {first[:40]!r}")
    h = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"no {name}")
    if not h["content-length"].isdigit() or len(rest) != (n := int(h["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"content-length {h['content-length']}, {len(rest)} bytes follow")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not sep or not status.startswith(b"HTTP/"):
        raise WarcError("no HTTP message")
    length = _headers(lines).get("content-length", "")
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    refers = h.get("warc-refers-to")
    if h["warc-type"] == "response":
        if not length.isdigit() or int(length) != len(payload):
            raise WarcError(f"HTTP content-length {length}, payload of {len(payload)} bytes")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("payload digest differs")
    elif h["warc-type"] != "revisit" or not refers or payload or not length.isdigit():
        raise WarcError(f"bad {h['warc-type']} record")
    return {
        "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload": payload, "payload_bytes": int(length),
        "payload_digest": digest, "record_type": h["warc-type"], "refers_to": _page(refers) if refers else None,
    }


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; a record's constant parts as raw content where the samples are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return build_record(0, "https://www.", b"<!DOCTYPE html><html><head><title></title></head><body><p></p></body></html>", "0" * 64, 0)


class ArchiveWriter:
    def __init__(self, sink, dictionary: bytes) -> None:  # noqa: ANN001
        self.sink = sink
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
        self.sink.write(head)
        self.size, self.records = len(head), 0

    def write(self, record: bytes) -> None:
        frame = self.codec.compress(record)
        self.sink.write(frame)
        self.size += len(frame)
        self.records += 1


def read_archive(source, step: int = 1 << 16) -> Iterator[bytes]:  # noqa: ANN001
    """The decoded frames of an archive in turn, one record each."""
    head = source.read(8)
    if len(head) < 8 or (magic := struct.unpack("<II", head))[0] != DICTIONARY_MAGIC:
        raise WarcError("the archive does not begin with a dictionary frame")
    packed = source.read(magic[1])
    if len(packed) != magic[1]:
        raise WarcError("the dictionary frame is cut off")
    plain = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == struct.pack("<I", ZSTD_MAGIC) else packed
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
    data = source.read(step)
    while data:
        frame, parts = codec.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if frame.eof:
                break
            data = source.read(step)
            if not data:
                raise WarcError("the last frame is cut off")
        data = frame.unused_data or source.read(step)
        yield b"".join(parts)


def resolve(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``digest`` and ``refers_to``: the least page of an equal payload of at least 100 bytes.

    The responses that anything repeats are a pre-aggregated, written table, so a payload that a third of the pages
    share is one row of it, and the join reads plain exchanges that adaptive execution can split.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    first = own.where(F.octet_length("html") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = table(first.where("n > 1").select("digest", "first"), "responses")
    joined = own.join(first, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per page and return the manifest (archive, records, bytes) of the archives that count.

    Rows that repeat the least page_id of equal payloads are all responses, as a revisit names its response by that id.
    A task that is run again writes archives of new names; only those of the attempt that succeeded are in the manifest.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 256)
    folder = folder or new_path(spark, "warc")
    sample = pages.select(F.substring("html", 1, DICTIONARY_CHARS).alias("html")).where("html is not null").limit(DICTIONARY_PAGES).toArrow().column("html").to_pylist()
    dictionary = spark.sparkContext.broadcast(train_dictionary([x.encode("utf-8", "replace") for x in sample]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, names, sink = None, [], None
        store.create_dir(base, recursive=True)

        def close() -> None:
            sink.close()
            names[-1] += (out.records, out.size)

        for b in batches:
            for page, url, html, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out is not None:
                        close()
                    names.append((f"part-{uuid.uuid4().hex}.warc.zst",))
                    sink = store.open_output_stream(f"{base}/{names[-1][0]}")
                    out = ArchiveWriter(sink, dictionary.value)
                out.write(build_record(page, url, html.encode(), digest, refers))
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(f"{folder}/{n}", r, s) for n, r, s in names])], ["archive", "records", "bytes"])

    return table(resolve(pages).mapInArrow(rows, "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives listed in ``archive``; the payload only if asked for. A bad archive raises."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kind = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("archive").to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                held, size = [], 0
                with store.open_input_stream(path) as source:
                    for frame in read_archive(source):
                        held.append(parse_record(frame))
                        size += len(held[-1]["payload"]) if payloads else 1 << 9
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=kind)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)

    names = manifest.select("archive")
    spread = names.repartition(max(1, min(10_000, names.count())), "archive")
    return spread.mapInArrow(rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)
