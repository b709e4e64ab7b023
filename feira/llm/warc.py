"""WARC archives in Zstandard: a writer, and a reader that loads the dictionary
from the leading skippable frame, decodes one frame per record and validates
headers and lengths.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed; each record is one frame that uses it. Payloads
that are equal and long enough are stored once: the smallest page_id is the
response, the others are revisit records without a payload that name it.

Which page revisits which is settled by partial aggregates of digests, so a group
with a third of all pages is folded before the shuffle. Archives go to the shared
folder through pyarrow's file systems; each has a name of its own, so a repeated
task never touches another's file, and only archives whose task ended well are
listed in the (written) manifest from which they are read back.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, with_columns

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal column: each 5 digits give 4 letters."""
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, 1) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_digest, record_type, refers_to of each page."""
    p = with_columns(pages, {"page_id": "long", "url": "string", "html": "string"})
    p = p.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.unhex(F.sha1("html")))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    slim = p.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "digest", "payload_bytes")
    groups = slim.groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).filter("k > 1")
    again = (slim.join(groups, ["digest", "payload_bytes"]).filter("page_id > first or (page_id is null and first is not null)")
             .select("page_id", "digest", F.col("first").alias("refers_to")).distinct())
    again = materialize(again, "revisits").alias("r")
    out = p.alias("p").join(again, F.expr("p.page_id <=> r.page_id and p.digest = r.digest"), "left")
    return out.select("p.page_id", "url", "html", base32(F.hex("p.digest")).alias("payload_digest"),
                      F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload but its length and its original."""
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id),
            b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
            b"WARC-Payload-Digest: sha1:" + digest.encode(), b"WARC-Payload-Length: %d" % len(payload)]
    if kind == "revisit":
        head.append(b"WARC-Refers-To: <urn:page:%d>" % refers_to)
        payload = b""
    head.append(b"Content-Length: %d" % len(payload))
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


class BadArchive(ValueError):
    """An archive that does not keep to the format."""


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises BadArchive on any mismatch."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise BadArchive("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.lower().decode() in fields:
            raise BadArchive("a header is malformed or repeated")
        fields[name.lower().decode()] = value.strip().decode()
    try:
        n, full = int(fields["content-length"]), int(fields["warc-payload-length"])
        kind, digest = fields["warc-type"], fields["warc-payload-digest"]
    except (KeyError, ValueError) as e:
        raise BadArchive("a header is missing") from e
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("the length does not match")
    payload = rest[:n]
    if kind == "response":
        if n != full or digest != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise BadArchive("the payload does not match its digest")
    elif kind != "revisit" or n or "warc-refers-to" not in fields:
        raise BadArchive("the record type does not fit")
    return fields, payload


def write_archive(out: io.RawIOBase, records: Iterator[bytes], dictionary: bytes, level: int = 3) -> int:
    """Dictionary frame, then a frame for each record; returns their number."""
    packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    n = 0
    for r in records:
        out.write(c.compress(r))
        n += 1
    return n


def read_archive(src, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame each, read piece by piece."""
    head = src.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_MAGIC:
        raise BadArchive("no dictionary frame")
    size = struct.unpack("<II", head)[1]
    packed = src.read(size)
    if len(packed) != size:
        raise BadArchive("the dictionary frame is cut off")
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == struct.pack("<I", FRAME_MAGIC) else bytes(packed)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    frame, data, parts = d.decompressobj(), src.read(chunk), []
    while data:
        try:
            parts.append(frame.decompress(data))
        except zstandard.ZstdError as e:
            raise BadArchive(f"a frame can't be decoded: {e}") from e
        if frame.eof:
            yield b"".join(parts)
            data, frame, parts = frame.unused_data or src.read(chunk), d.decompressobj(), []
        else:
            data = src.read(chunk)
            if not data:
                raise BadArchive("the last frame is cut off")


def train_dictionary(pages: DataFrame, samples: int = 200, size: int = 32_768) -> bytes:
    """A dictionary trained on a bounded sample of whole pages, those first by a hash
    of id and html, so reruns agree. Too few or too short pages to train on serve as
    they are."""
    html = with_columns(pages, {"page_id": "long", "html": "string"}).filter("html <> ''")
    rows = [r[0].encode() for r in html.orderBy(F.xxhash64("page_id", "html"), "html").select("html").limit(samples).collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(rows)[-size:] or VERSION


def write_warc(pages: DataFrame, dictionary: bytes, least_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write all pages and return the manifest: path, records. An archive is closed
    once its payloads reach archive_bytes."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to"))))
        left = next(rows, None)
        while left is not None:
            path, size = f"{root}/{uuid.uuid4().hex}.warc.zst", 0

            def records() -> Iterator[bytes]:
                nonlocal left, size
                while left is not None and size < archive_bytes:
                    page, url, html, digest, kind, refers = left
                    payload = html.encode()
                    size += len(payload)
                    yield record(page, url, payload, digest, kind, refers)
                    left = next(rows, None)

            with fs.open_output_stream(path) as out:
                n = write_archive(out, records(), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    manifest = plan_records(pages, least_bytes).mapInArrow(run, "path string, records long")
    return materialize(manifest.withColumn("folder", F.lit(folder)), "manifest")


_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the listed archives, with html if asked for. An archive whose
    records are fewer or more than listed, or any bad record, fails the read."""
    schema = _FIELDS + ", html string" * payload

    def page(ref: str) -> int | None:
        number = ref.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path, listed in zip(*(batch.column(c).to_pylist() for c in ("folder", "path", "records"))):
                fs, _ = pafs.FileSystem.from_uri(folder)
                seen, rows, held = 0, [], 0
                with fs.open_input_stream(path) as src:
                    for data in read_archive(src):
                        f, body = parse_record(data)
                        row = [page(f["warc-record-id"]), f["warc-target-uri"], int(f["warc-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"),
                               f["warc-type"], page(f["warc-refers-to"]) if "warc-refers-to" in f else None]
                        rows.append(row + [body.decode()] * payload)
                        seen, held = seen + 1, held + len(body) * payload
                        if len(rows) >= 10_000 or held > 1 << 24:
                            yield table(rows)
                            rows, held = [], 0
                if seen != listed:
                    raise BadArchive(f"{path} has {seen} records, not {listed}")
                if rows:
                    yield table(rows)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record per page, read the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    A null html is an empty payload; all payloads of at least `least_bytes` take
    part in revisits. Of equal ones, rows of the smallest page_id are responses
    (all of them, if that id is repeated); a null page_id is never the smallest
    unless all are null. Extra columns are ignored; an empty table gives no rows.
    """
    manifest = write_warc(pages, train_dictionary(pages), least_bytes)
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
