"""WARC archives with a Zstandard dictionary, written and read.

An archive is a sequence of Zstandard frames: first a skippable frame (magic 0x184D2A5D) with the dictionary,
then one frame for each record, compressed with it. The dictionary is trained on the archive's own
records: a piece of each at a place of its own, so that all of them count and the sample stays bounded; where they are too few
or too alike to train on, the pieces are the dictionary. Archives are rows (archive, content) of a table in the shared folder, as not every store lets
workers open files; save_archives writes them as .warc.zst files where it does.

Of records with equal payloads the one with the least id is a response; the others are revisits of it, with its
id and the payload's digest and length but no payload. Payloads are told apart by SHA-256 and length.

Defined results: a null payload is empty. Rows with a null id are written with an empty record id and are revisits
if an equal payload has an id, else responses; rows repeated with one id are all written, in one kind. Columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialised, new_folder, partitions, record_batch, slices

#: Payload bytes of an archive (unless one record is larger), the dictionary's size, what it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 8 << 20, 16 << 10, 1 << 20
LEAST_PIECE, LEVEL = 256, 3
#: Repeated payloads (100 bytes each) that are sent to all tasks at most; more are joined by their digest.
MAX_BROADCAST = 200_000
#: Fixed value: the skippable frame that holds a dictionary in WARC files.
DICTIONARY_MAGIC = 0x184D2A5D
#: Fixed date, so that writing again gives the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_uri(record_id: int | None) -> str:
    return "<urn:page:>" if record_id is None else f"<urn:page:{record_id}>"


def record_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def record_bytes(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A whole record; refers_to: the response that a revisit stands for, else None."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_uri(record_id)), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    if refers_to is not None:
        head += [("WARC-Refers-To", record_uri(refers_to)), ("WARC-Profile", PROFILE), ("X-Payload-Length", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """Of each record a piece of equal size, of very many records evenly spread ones; where in the record follows from its number."""
    step = -(-len(records) * LEAST_PIECE // SAMPLE_BYTES) or 1
    chosen = records[::step]
    share = SAMPLE_BYTES // max(1, len(chosen))
    at = (k * 0x9E3779B1 % max(1, len(r) - share + 1) for k, r in enumerate(chosen))
    sample = [r[a : a + share] for a, r in zip(at, chosen, strict=True)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


def write_archive(records: list[bytes]) -> bytes:
    content = build_dictionary(records)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content + b"".join(compressor.compress(r) for r in records)


def read_archive(content: bytes, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, decompressed in chunks."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with its dictionary")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    held, at = bytearray(), 0

    with decompressor.stream_reader(memoryview(content)[8 + size :], read_across_frames=True) as stream:

        def more() -> bool:
            got = stream.read(chunk)
            held.extend(got)
            return bool(got)

        while True:
            while (end := held.find(b"\r\n\r\n", at)) < 0:
                if not more():
                    if held[at:]:
                        raise ValueError("the archive ends within a record")
                    return
            lines = held[at:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"no record begins with {lines[0]!r}")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            length = int(headers["Content-Length"])
            at = end + 4
            while len(held) - at < length + 4:
                if not more():
                    raise ValueError("the archive ends within a record")
            yield headers, bytes(held[at : at + length])
            at += length + 4
            if at >= chunk:
                del held[:at]
                at = 0


def _write(archive_bytes: int):
    def work(batches: Iterable[pa.RecordBatch]):
        part, nth, records, size = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            return record_batch(archive=[f"{part:06d}-{nth:05d}.warc.zst"], content=[write_archive(records)])

        for batch in slices(batches, "html"):
            for page, url, html, first, copy in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "copy")), strict=True):
                record = record_bytes(page, url, html.encode("utf-8", "surrogatepass"), first if copy else None)
                records.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield archive()
                    nth, records, size = nth + 1, [], 0
        if records:
            yield archive()

    return work


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None) -> DataFrame:
    """Writes a record for each row and returns the archives: archive, content."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keys = rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("size"))
    # Only payloads that come again, written first so that their number is known: as long as they are few, no html is shuffled for them.
    firsts = keys.groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "first_id")
    firsts = materialised(firsts)
    if firsts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        firsts = F.broadcast(firsts)
    keyed = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    joined = keyed.join(firsts, ["digest", "size"], "left")
    marked = joined.withColumn("copy", F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)))
    folder = folder or new_folder(spark, "warc")
    arrow_map(marked.select("page_id", "url", "html", "first_id", "copy"), _write(archive_bytes), "archive string, content binary").write.option("compression", "none").parquet(folder)
    return spark.read.parquet(folder)


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def columns(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for content in batch.column("content"):
            out: list[tuple] = []
            for headers, block in read_archive(content.as_py()):
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                kind = headers["WARC-Type"]
                length = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                digest = payload_digest(payload) if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:")
                out.append((record_of(headers["WARC-Record-ID"]), length, digest, kind, record_of(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), payload if kind == "response" else None))
                if len(out) >= 256:
                    yield columns(out)
                    out = []
            if out:
                yield columns(out)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record; payload is null for revisits, whose length and digest are the response's."""
    return arrow_map(archives.select("content"), _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def save_archives(archives: DataFrame, folder: str) -> None:
    """The archives as files of a folder that all workers can open."""

    def save(rows):
        from pathlib import Path

        Path(folder).mkdir(parents=True, exist_ok=True)
        for row in rows:
            (Path(folder) / row.archive).write_bytes(row.content)

    archives.repartition(partitions(archives, 64 << 20), "archive").foreachPartition(save)
