"""WARC archives in Zstandard: a writer, and a reader that takes one frame per record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of its frames, and
then has a frame for each record.  Archives are written by Spark's text sink, so they go to any store that
Spark can write to: a row is a frame, and the sink's row separator is an empty skippable frame, which
every Zstandard reader passes over.  They are read back with the binaryFile source.  The writer deals
pages to so many tasks that an archive holds about ``ARCHIVE_BYTES`` of payload.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page id is a
response and the others revisit it; digests are aggregated before they are joined, and only digests
that occur twice are.  A revisit keeps the HTTP header of its page, which says how long the payload was.

Defined cases: a null html is an empty payload; a null url is left out; a null page id is written as
``null``, comes back as null and is larger than any id; rows that repeat the smallest id of a payload are all
responses; control characters and spaces in a url are percent-encoded in the header and decoded back.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, session_of, shared_dir

REVISIT_BYTES = 100
ARCHIVE_BYTES = 24_000_000
#: Digests that repeat: up to so many are broadcast (about 100 bytes each).
BROADCAST_DIGESTS = 100_000
#: Fixed values of the file formats.
DICTIONARY_FRAME, FIRST_SKIPPABLE, ZSTD_FRAME, DICTIONARY = 0x184D2A5D, 0x184D2A50, 0xFD2FB528, 0xEC30A437
EMPTY_FRAME = struct.pack("<II", FIRST_SKIPPABLE, 0).decode("ascii")
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
#: The dictionary of an archive is trained on its first records, at most these.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 200, 2_000_000, 32_768


class WarcError(ValueError):
    """An archive that doesn't hold what its headers say."""


def _urn(page_id: str | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"null" if page_id is None else b"id=" + _quoted(str(page_id)))


def _page(urn: bytes) -> str | None:
    m = re.fullmatch(rb"<urn:x-page:(?:null|id=([^<>]*))>", urn)
    if not m:
        raise WarcError(f"no record id: {urn!r}")
    return None if m[1] is None else _unquoted(m[1])


def _quoted(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20%<>\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())


def _unquoted(url: bytes) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url).decode()


def record(page_id: str | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + (payload or b"")
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: " + DATE]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _quoted(url))
    lines += [b"WARC-Payload-Digest: sha256:" + digest.encode()]
    if revisit:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _urn(refers_to)]
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record, with every length and digest checked."""
    head, end, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not end or version != b"WARC/1.1":
        raise WarcError(f"not a WARC/1.1 record: {version[:40]!r}")
    fields: dict[bytes, bytes] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or name.lower() in fields:
            raise WarcError(f"bad or repeated header: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length", b"warc-payload-digest"):
        if name not in fields:
            raise WarcError(f"without {name.decode()}")
    size = fields[b"content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {size!r}, the block has {len(rest) - 4} bytes")
    http, end, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http)
    if not end or not http.startswith(b"HTTP/1.1 ") or not length:
        raise WarcError("no HTTP header")
    kind, digest = fields[b"warc-type"], fields[b"warc-payload-digest"]
    if not digest.startswith(b"sha256:"):
        raise WarcError(f"unknown digest: {digest[:20]!r}")
    if kind == b"response":
        if len(payload) != int(length[1]) or hashlib.sha256(payload).hexdigest().encode() != digest[7:]:
            raise WarcError(f"the payload of {fields[b'warc-record-id']!r} isn't the one described")
    elif kind != b"revisit" or payload or fields.get(b"warc-profile") != PROFILE or b"warc-refers-to" not in fields:
        raise WarcError(f"bad record of type {kind!r}")
    uri = fields.get(b"warc-target-uri")
    return {
        "page_id": _page(fields[b"warc-record-id"]),
        "url": None if uri is None else _unquoted(uri),
        "payload_bytes": int(length[1]),
        "payload_digest": digest[7:].decode(),
        "record_type": kind.decode(),
        "refers_to": _page(fields[b"warc-refers-to"]) if kind == b"revisit" else None,
        "payload": payload if kind == b"response" else None,
    }


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict]:
    """The leading frame and the dictionary in it: trained, or the samples themselves where they are too few."""
    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=0)
    except (zstandard.ZstdError, ValueError):
        made = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data = made.as_bytes()
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data, made


def write_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The rows of an archive: the dictionary, then a frame for each record."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if len(first) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
            break
    if not first:
        return
    head, trained = dictionary_frame(first)
    yield head
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    for group in (first, records):
        for r in group:
            yield packer.compress(r)


def read_frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each; the dictionary is loaded from the leading skippable frame."""
    view, at, trained, opened = memoryview(data), 0, None, None
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError(f"{len(view) - at} odd bytes at the end")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == FIRST_SKIPPABLE:
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) != size:
                raise WarcError("a skippable frame is cut short")
            if magic == DICTIONARY_FRAME:
                if at:
                    raise WarcError("the dictionary doesn't lead")
                if body[:4] == struct.pack("<I", ZSTD_FRAME):
                    body = zstandard.ZstdDecompressor().decompress(body)
                kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == struct.pack("<I", DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
                trained = zstandard.ZstdCompressionDict(body, dict_type=kind)
            at += 8 + size
            continue
        if magic != ZSTD_FRAME:
            raise WarcError(f"no frame at byte {at}")
        opened = opened or zstandard.ZstdDecompressor(dict_data=trained)
        one = opened.decompressobj()
        out, step = [], 1 << 16
        while not one.eof and at < len(view):
            piece = view[at : at + step]
            out.append(one.decompress(piece))
            at += len(piece)
        if not one.eof:
            raise WarcError("a frame is cut short")
        at -= len(one.unused_data)
        yield b"".join(out)


def planned(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", broadcast_digests=BROADCAST_DIGESTS) -> DataFrame:
    """pages as records: page_id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to, revisit."""
    session_of(pages)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    # a null id is the largest: max() over (no id, -id) would need it first, min() over (no id, id) has it last
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    again = saved(
        rows.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
        .filter("n > 1")
        .select(F.col("payload_digest").alias("digest"), F.col("first.id").alias("refers_to"))
    )
    if again.count() <= broadcast_digests:
        again = F.broadcast(again)
    joined = rows.join(again, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    joined = joined.withColumn("revisit", revisit)
    return joined.select("page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"), "revisit")


def write_warc(pages: DataFrame, path: str, id_col="page_id", url_col="url", html_col="html", archive_bytes=ARCHIVE_BYTES, broadcast_digests=BROADCAST_DIGESTS) -> None:
    """Writes a record for each row to archives in the folder `path`."""
    records = planned(pages, id_col, url_col, html_col, broadcast_digests)
    total = pages.agg(F.coalesce(F.sum(F.octet_length(html_col) + 500), F.lit(0))).first()[0]

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for r in batch.to_pylist():
                    yield record(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["revisit"])

        some, size = [], 0
        for frame in write_frames(each()):
            some.append(frame)
            size += len(frame)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["frame"])
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["frame"])

    texts = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    dealt = texts.repartition(max(1, -(-total // archive_bytes)))
    out = dealt.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)


_RECORDS = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def read_warc(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "bigint") -> DataFrame:
    """The records of the archives in a folder, ids as id_type; with payloads, their bytes too. A damaged archive fails the query."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORDS.split(", ")] + ["payload"] * payloads
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            for data in batch.column(0):
                some, size = [], 0
                for r in map(parse_record, read_frames(data.as_buffer())):
                    some.append({n: r[n] for n in names})
                    size += 200 + (len(r["payload"] or b"") if payloads else 0)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, size = [], 0
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    session_of(files)
    found = files.mapInArrow(records, _RECORDS + ", payload binary" * payloads)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def warc_round_trip(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col, url_col, html_col)
    return read_warc(pages.sparkSession, path, id_type=pages.schema[id_col].dataType.simpleString())
