"""Zstandard web archives: written by Spark, read back record by record.

An archive is a file that begins with a skippable frame (magic 0x184D2A5D) holding the dictionary of
its records; then comes one Zstandard frame per record. Spark's text writer puts the rows down as
they are and its line separator is an empty skippable frame, so that the file stays a valid
sequence of frames, wherever Hadoop can write. Readers skip frames that they don't know.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
``page_id`` is a response and the others revisit it.

Defined cases: null html is an empty payload; rows with a null ``page_id`` are records without a
page number, and revisit if another page has the same payload, else they are responses; rows that
repeat the smallest ``page_id`` are responses all; the address is escaped so that it cannot break a header; other
columns are not looked at; no rows give no archive and an empty result. A damaged archive fails the job.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seapoint.llm.staging import new_path, staged

MIN_REVISIT = 100
DICTIONARY_BYTES = 16 << 10
# Fixed values of the formats.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadArchive(ValueError):
    """The bytes are not an archive of this kind."""


def _name(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _number(name: bytes) -> int | None:
    text = name.decode("ascii")
    if not (text.startswith("<urn:page:") and text.endswith(">")):
        raise BadArchive(f"unknown record name {text!r}")
    return None if text == "<urn:page:none>" else int(text[len("<urn:page:") : -1])


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit has the HTTP head of the response but not its payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", urllib.parse.quote(url or "urn:unknown", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[bytes, bytes]:
    found: dict[bytes, bytes] = {}
    for line in lines:
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise BadArchive(f"bad header line {line[:60]!r}")
        if key.strip().lower() in found:
            raise BadArchive(f"repeated header {key[:60]!r}")
        found[key.strip().lower()] = value.strip()
    return found


def _length(headers: dict[bytes, bytes]) -> int:
    value = headers.get(b"content-length", b"")
    if not value.isdigit():
        raise BadArchive(f"bad length {value[:40]!r}")
    return int(value)


def parse_record(record: bytes) -> dict:
    """The fields of one record, its headers, lengths and digest checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", VERSION):
        raise BadArchive("no WARC header")
    headers = _headers(lines)
    for need in (b"warc-type", b"warc-record-id", b"warc-date", b"warc-payload-digest", b"content-length"):
        if need not in headers:
            raise BadArchive(f"missing {need.decode()}")
    size = _length(headers)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive("record length and content differ")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header")
    inner = _length(_headers(http.split(b"\r\n")[1:]))
    kind = headers[b"warc-type"].decode("ascii")
    method, _, digest = headers[b"warc-payload-digest"].decode("ascii").partition(":")
    if method != "sha256" or len(digest) != 64:
        raise BadArchive("unknown payload digest")
    refers_to = None
    if kind == "response":
        if len(payload) != inner or hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("payload differs from its length or digest")
    elif kind == "revisit":
        if payload or b"warc-refers-to" not in headers:
            raise BadArchive("a revisit has a reference and no payload")
        refers_to = _number(headers[b"warc-refers-to"])
    else:
        raise BadArchive(f"unknown record type {kind!r}")
    return {
        "page_id": _number(headers[b"warc-record-id"]),
        "url": urllib.parse.unquote(headers.get(b"warc-target-uri", b"").decode("ascii")),
        "payload_bytes": inner,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers_to,
        "payload": payload,
    }


def _skippable(data: memoryview, at: int) -> int:
    """Where the skippable frame at ``at`` ends."""
    if at + 8 > len(data):
        raise BadArchive("cut skippable frame")
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        raise BadArchive("cut skippable frame")
    return end


def _is_skippable(magic: bytes) -> bool:
    return len(magic) == 4 and magic[1:] == b"\x2a\x4d\x18" and 0x50 <= magic[0] <= 0x5F


def read_records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each. A dictionary frame may itself be compressed."""
    data, at, dictionary = memoryview(archive), 0, None
    if bytes(data[:4]) == DICTIONARY_MAGIC:
        at = _skippable(data, 0)
        raw = bytes(data[8:at])
        if raw[:4] == ZSTD_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        magic = bytes(data[at : at + 4])
        if _is_skippable(magic):
            at = _skippable(data, at)
        elif magic == ZSTD_MAGIC:
            frame = reader.decompressobj()
            parts, step = [], 64 << 10
            while not frame.eof:
                if at >= len(data):
                    raise BadArchive("cut frame")
                chunk = data[at : at + step]
                parts.append(frame.decompress(chunk))
                at += len(chunk) - len(frame.unused_data)
            yield b"".join(parts)
        else:
            raise BadArchive(f"no frame at byte {at}")


def _dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on the archive's first records; the first bytes of them where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"\r\n" * 8)


def _with_references(pages: DataFrame) -> DataFrame:
    """Pages with ``payload``, ``digest`` and the ``refers_to`` of revisits."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = staged(
        rows.filter(F.length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select("digest", "first"),
        "payloads",
    )
    return rows.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )


def write_archives(pages: DataFrame, path: str, sample_records: int = 400) -> None:
    """One archive per partition under ``path``; each has a dictionary trained on its own first records."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = None
        for batch in batches:
            refers = [None if pd.isna(x) else int(x) for x in batch["refers_to"]]
            numbers = [None if pd.isna(x) else int(x) for x in batch["page_id"]]
            records = [
                warc_record(n, u, bytes(p), d, r)
                for n, u, p, d, r in zip(numbers, batch["url"], batch["payload"], batch["digest"], refers, strict=True)
            ]
            rows = []
            if packer is None and records:
                dictionary = _dictionary(records[:sample_records], DICTIONARY_BYTES)
                raw = dictionary.as_bytes()
                rows.append(DICTIONARY_MAGIC + struct.pack("<I", len(raw)) + raw)
                packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
            rows += [packer.compress(r) for r in records]
            yield pd.DataFrame({"frame": rows})

    frames = _with_references(pages).select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to")
    )
    # The bytes go through as they are: a cast of binary to string checks and changes nothing.
    frames.mapInPandas(pack, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", EMPTY_FRAME
    ).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of every record."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["content"]:
                rows = []
                for record in read_records(bytes(archive)):
                    fields = parse_record(record)
                    del fields["payload"]
                    rows.append(fields)
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and return what reading them gives."""
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
