"""WARC archives in Zstandard: one frame per record, the dictionary in the leading skippable frame.

Pages become records, identical payloads point to the first page that holds them. Every task writes
the rows of its partition to archives of bounded size in a shared folder, under names of its attempt, and
returns their paths; only the paths of attempts that succeeded are read. The reader loads the dictionary,
walks the frames by their block headers, decodes one record at a time and checks headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import stored

ZSTD_MAGIC, DICT_FRAME, DICT_MAGIC = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
#: Pages whose first bytes train the dictionary; its size; size at which an archive is closed.
DICT_PAGES, DICT_BYTES, ARCHIVE_BYTES = 256, 65_536, 8_000_000
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "payload binary")


class ArchiveError(ValueError):
    """An archive that breaks the format."""


# --- records ---

def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ArchiveError(f"record id {urn!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, is_revisit: bool, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        safe = "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if is_revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or name.lower() in out:
            raise ArchiveError(f"header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def decode_record(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, digest, type, refers_to, payload or None) of one record, checked."""
    from urllib.parse import unquote

    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError(f"version line {version[:40]!r}")
    h = _headers(lines)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - h.keys()
    if missing:
        raise ArchiveError(f"no {sorted(missing)}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {len(rest) - 4} bytes, Content-Length {size}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/1."):
        raise ArchiveError(f"status line {status[:40]!r}")
    length = int(_headers(lines).get("content-length", -1))
    method, _, digest = h["warc-payload-digest"].partition(":")
    kind, refers = h["warc-type"], None
    if method != "sha256" or len(digest) != 64:
        raise ArchiveError(f"digest {h['warc-payload-digest'][:80]!r}")
    if kind == "response":
        if length != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError("payload does not match its length or digest")
    elif kind == "revisit":
        if payload or length < 0 or "warc-refers-to" not in h:
            raise ArchiveError("revisit with a payload or without its target")
        payload, refers = None, _page_of(h["warc-refers-to"])
    else:
        raise ArchiveError(f"record type {kind!r}")
    url = h.get("warc-target-uri")
    return (_page_of(h["warc-record-id"]), None if url is None else unquote(url, errors="surrogatepass"),
            length, digest, kind, refers, payload)


# --- frames ---

def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its block headers."""
    try:
        magic, = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic != ZSTD_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        else:
            flags = data[at + 4]
            single = flags >> 5 & 1
            size_bytes = (1 if single else 0, 2, 4, 8)[flags >> 6]
            end = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + size_bytes
            last = False
            while not last:
                block = data[end] | data[end + 1] << 8 | data[end + 2] << 16
                last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
                if kind == 3:
                    raise ArchiveError(f"reserved block in the frame at byte {at}")
                end += 3 + (1 if kind == 1 else size)
            end += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError):
        raise ArchiveError(f"frame at byte {at} is cut off") from None
    if end > len(data):
        raise ArchiveError(f"frame at byte {at} is cut off")
    return end


def read_archive(content: bytes) -> Iterator[tuple]:
    """The records of an archive, one frame at a time."""
    data, at, options = memoryview(content), 0, {}
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME:
        at = frame_end(data, 0)
        words = bytes(data[8:at])
        if words[:4] == struct.pack("<I", ZSTD_MAGIC):
            words = zstandard.ZstdDecompressor().decompress(words)
        if words:
            options = {"dict_data": zstandard.ZstdCompressionDict(words)}
    reader = zstandard.ZstdDecompressor(**options)
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] == ZSTD_MAGIC:
            frame = bytes(data[at:end])
            size = zstandard.frame_content_size(frame)
            try:
                record = reader.decompress(frame) if size >= 0 else reader.decompressobj().decompress(frame)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame at byte {at}: {e}") from None
            if 0 <= size != len(record):
                raise ArchiveError(f"frame at byte {at} has {len(record)} bytes instead of {size}")
            yield decode_record(record)
        at = end


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; the samples themselves where there are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _uri(folder: str) -> str:
    return "file://" + folder if folder.startswith("/") else re.sub("^file:/(?!/)", "file:///", folder)


def _writer(folder: str, dictionary: bytes, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, **options)
        words = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
        lead = struct.pack("<II", DICT_FRAME, len(words)) + words
        made, records, size, parts = 0, 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal made, records, size, parts
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{made:05d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(lead + b"".join(parts))
            batch = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size + len(lead)])],
                                               names=["path", "records", "bytes"])
            made, records, size, parts = made + 1, 0, 0, []
            return batch

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                parts.append(packer.compress(encode_record(*(v.as_py() for v in row))))
                records, size = records + 1, size + len(parts[-1])
                if size >= archive_bytes:
                    yield close()
        if parts:
            yield close()
    return run


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all ``pages`` (page_id, url, html) in ``folder``; the manifest path, records, bytes as a stored table.

    A NULL html is an empty payload. Of equal payloads of at least ``REVISIT_BYTES`` bytes the smallest page_id is
    the response, the others revisit it; rows that repeat that page_id with the same payload are responses, too. A
    NULL page_id is never the smallest unless there is no other. An empty table makes no archive.
    """
    spark = pages.sparkSession
    folder = _uri(folder or scratch_path(spark, "warc"))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    payloads = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = payloads.withColumn("digest", F.sha2("payload", 256))
    samples = payloads.select("payload").limit(DICT_PAGES).collect()  # bounded: DICT_PAGES rows
    dictionary = train_dictionary([bytes(r["payload"][:65_536]) for r in samples])
    # ids and digests only: which pages repeat an earlier one
    firsts = (keyed.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    firsts = stored(firsts, "warc-firsts")
    again = (keyed.select("page_id", "digest").join(firsts, "digest")
             .filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
             .select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first").distinct())
    rows = keyed.join(again.hint("shuffle_hash"), keyed["page_id"].eqNullSafe(again["again_id"])
                      & (keyed["digest"] == again["again_digest"]), "left").select(
        "page_id", "url", "payload", "digest", F.col("first").isNotNull().alias("is_revisit"), F.col("first").alias("refers_to"))
    return stored(rows.mapInArrow(_writer(folder, dictionary, archive_bytes), MANIFEST), "warc-manifest")


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as source:
                    content = source.read()
                rows: list[tuple] = []
                try:
                    for record in read_archive(content):
                        rows.append(record if with_payload else (*record[:-1], None))
                except ArchiveError as e:
                    raise ArchiveError(f"{path}, record {len(rows)}: {e}") from None
                if expected is not None and len(rows) != expected:
                    raise ArchiveError(f"{path}: {len(rows)} records instead of {expected}")
                for lo in range(0, len(rows), 1000):
                    cols = zip(*rows[lo:lo + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all archives in ``manifest`` (path, records; NULL records: not checked), columns as in RECORD.

    ``payload`` is NULL for revisits, their bytes are those of the page in ``refers_to``; payload_bytes and
    payload_digest are of the full payload. A broken archive fails with ArchiveError.
    """
    paths = manifest.select("path", "records")
    n = max(1, paths.sparkSession.sparkContext.defaultParallelism)
    return paths.repartition(n).mapInArrow(_reader(with_payload), RECORD)
