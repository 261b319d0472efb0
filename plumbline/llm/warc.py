"""WARC archives of Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Writers and readers stream: a task holds one record at a time. Archives are written next to their final name and renamed,
and readers follow the manifest that the writing job returned, so a task that ran twice leaves a file nobody reads.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.session import checkpoint_dir

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY = 1_000, 20_000, 32_768  # bounds of the sample a dictionary is trained on
LEAST_REVISIT = 1_000  # bytes; smaller payloads are stored each time
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16

_MANIFEST = "path string, n_records bigint, n_bytes bigint"
_RECORDS = (
    "path string, n bigint, record_id string, record_type string, uri string, refers_to string, payload_digest string, "
    "payload_bytes bigint, payload binary, problem string"
)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that executors share, and the path in it."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payload beginnings; empty when there is too little to learn from."""
    rows = pages.filter(F.length("html") > 0).select(F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(SAMPLE_PAGES).collect()
    samples = [r.html.encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record_bytes(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: the HTTP message with its payload, or only its head where another record holds the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[-2:-2] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def write_archives(pages: DataFrame, folder: str, dictionary: bytes = b"", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page, url, html, digest, refers_to) below ``folder``; returns the manifest (path, n_records, n_bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        system.create_dir(top, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        done, out, name, n = [], None, "", 0

        def close():
            size = out.tell()
            out.close()
            system.move(f"{top}/.{name}", f"{top}/{name}")
            done.append((f"{folder}/{name}", n, size))

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = system.open_output_stream(f"{top}/.{name}", compression=None)
                    if dictionary:
                        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                out.write(packer.compress(record_bytes(page.as_py() or "", url.as_py() or "", payload, digest.as_py(), refers.as_py())))
                n += 1
                if out.tell() >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["path", "n_records", "n_bytes"],
        )

    rows = pages.select(*[F.col(c).cast("string") for c in ("page", "url", "html", "digest", "refers_to")])
    return rows.mapInArrow(work, _MANIFEST)


def _frames(read) -> Iterator[bytes | str]:
    """The content of every frame of a stream; a last text item says what is wrong with the rest."""
    data, dictionary = read(CHUNK), None
    while len(data) < 8 and (more := read(CHUNK)):
        data += more
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            if not (more := read(CHUNK)):
                yield "truncated dictionary"
                return
            data += more
        body, data = data[8 : 8 + size], data[8 + size :]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == ZSTD else body)
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data := data or read(CHUNK):
        frame, parts = unpacker.decompressobj(), []
        try:
            while not frame.eof:
                parts.append(frame.decompress(data))
                data = b"" if frame.eof else read(CHUNK)
                if not frame.eof and not data:
                    yield "truncated frame"
                    return
        except zstandard.ZstdError as error:
            yield f"bad frame: {error}"
            return
        data = frame.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``problem`` names the first check it fails."""
    out = dict.fromkeys(c.split()[0] for c in _RECORDS.split(", "))
    head, mark, rest = raw.partition(END)
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", VERSION):
        return out | {"problem": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return out | {"problem": "bad header line"}
        fields[key.strip().lower()] = value.strip()
    page = lambda v: re.sub(r"^<urn:page:|>$", "", v) if v else None
    out |= {
        "record_id": page(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"),
        "refers_to": page(fields.get("warc-refers-to")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
    }
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(rest) != int(length) + len(END) or not rest.endswith(END):
        return out | {"problem": "length differs"}
    http, mark, payload = rest[: -len(END)].partition(END)
    found = re.search(rb"(?im)^content-length: (\d+)\r?$", http)
    if not mark or not found:
        return out | {"problem": "no HTTP head"}
    out["payload_bytes"] = int(found[1])
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"]:
            return out | {"problem": "payload length differs"}
        if hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
            return out | {"problem": "digest differs"}
        out["payload"] = payload
    return out


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path), in file order ``n``; failed checks are told in ``problem``.

    A damaged or cut-off frame ends its file with one row that has a problem and no record. ``payloads=False`` checks the
    payloads but leaves them out.
    """
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("n", "payload_bytes") else pa.string()) for n in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _open(path)
                rows, size = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for n, raw in enumerate(_frames(stream.read)):
                        row = {"problem": raw} if isinstance(raw, str) else parse_record(raw)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row | {"path": path, "n": n})
                        size += len(row.get("payload") or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2))
    return spread.mapInArrow(work, _RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html; more columns are ignored) and return the manifest.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest page_id keeps the payload;
    the others become revisits of it. Null and empty html are empty payloads; a null url is empty. Repeated rows of that
    largest page_id are each a response. A null page_id is below all others and never referred to: without a page_id among
    equal payloads, each is a response.
    """
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/archives"
    rows = pages.select(F.col("page_id").cast("bigint").alias("page"), "url", "html")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("digest", F.sha1(body)).withColumn("bytes", F.octet_length(body))
    # a digest's largest page; only digests that occur twice can have revisits
    first = (
        rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy(F.col("digest").alias("same"))
        .agg(F.max("page").alias("last"), F.count("*").alias("n")).filter("n > 1 AND last IS NOT NULL").drop("n")
    )
    marked = rows.join(first, (F.col("digest") == F.col("same")) & (F.col("bytes") >= LEAST_REVISIT), "left")
    marked = marked.withColumn("refers_to", F.when(F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last")), F.col("last")))
    return stored(write_archives(marked, folder, train_dictionary(pages)), "manifest")


def page_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``op8_warc``: archive the pages, read the archives back, one row per record. Any failed check raises."""
    records = read_archives(archive_pages(spark, pages), payloads=False)
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "problem"))).otherwise(F.col("record_type"))
    return records.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        sound.cast("string").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"),
    )
