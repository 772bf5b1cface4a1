"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Writer tasks each write one archive to a folder that all executors share, under a temporary name that is renamed at the end, so a
task that runs again replaces its own file. Readers take whole archives and hold one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import id_filter, join_counted, new_shared_path, shared_table, small_batches

# Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: What a task's dictionary is trained on: its first records, within these bounds.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 64, 2_000_000, 16_384
#: Bytes from which a task closes its archive and opens the next.
ARCHIVE_BYTES = 1_000_000_000
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive or record that is not as it says."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_shared(uri: str, mode: str):
    """A file of the shared folder: local or mounted paths directly, other stores through Arrow's file systems."""
    if uri.startswith("file:") or "://" not in uri:
        path = re.sub("^file:/*", "/", uri)
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_stream(path)


def rename_shared(old: str, new: str) -> None:
    if old.startswith("file:") or "://" not in old:
        os.replace(re.sub("^file:/*", "/", old), re.sub("^file:/*", "/", new))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(old)
    store.move(path, fs.FileSystem.from_uri(new)[1])


def clean_header(value: str) -> str:
    """A header value on one line: control characters and % are percent-encoded, in UTF-8."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit that has the payload's digest and length only."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean_header(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]):
    """Trained on the samples; where they are too few or too alike to train on, their own bytes."""
    import zstandard as z

    try:
        return z.train_dictionary(DICT_BYTES, samples)
    except z.ZstdError:
        return z.ZstdCompressionDict((b"".join(samples)[-DICT_BYTES:] + b" " * 8)[:DICT_BYTES], dict_type=z.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    def __init__(self, out, samples: list[bytes]):
        import zstandard as z

        made = make_dictionary(samples)
        body = z.ZstdCompressor(level=9).compress(made.as_bytes())
        out.write(struct.pack("<II", DICT_MAGIC, len(body)) + body)
        self.out, self.size = out, 8 + len(body)
        self.compress = z.ZstdCompressor(level=3, dict_data=made, write_checksum=True, write_content_size=True).compress

    def write(self, record: bytes) -> None:
        frame = self.compress(record)
        self.out.write(frame)
        self.size += len(frame)


def read_frames(src, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one decoded frame each."""
    import zstandard as z

    head = src.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICT_MAGIC:
        raise WarcError("no dictionary frame at the start")
    size = struct.unpack("<II", head)[1]
    body = src.read(size)
    if len(body) != size:
        raise WarcError("the dictionary frame is cut short")
    if body[:4] == struct.pack("<I", FRAME_MAGIC):
        body = z.ZstdDecompressor().decompress(body)
    decode = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(body))
    left = src.read(chunk)
    while left:
        while len(left) < 4 and (more := src.read(chunk)):
            left += more
        if left[:4] != struct.pack("<I", FRAME_MAGIC):
            raise WarcError("no Zstandard frame where a record should start")
        one, parts = decode.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(left))
            except z.ZstdError as e:
                raise WarcError(f"a frame does not decode: {e}") from e
            if one.eof:
                break
            left = src.read(chunk)
            if not left:
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)
        left = one.unused_data or src.read(chunk)


def _headers(raw: bytes, first: str) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"{lines[0][:40]!r} where {first} should be")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name.lower() in out:
            raise WarcError(f"bad or repeated header {line[:60]!r}")
        out[name.lower()] = value
    return out


def _number(headers: dict[str, str], name: str) -> int:
    if not re.fullmatch("[0-9]+", value := headers.get(name, "")):
        raise WarcError(f"{name} is {value[:40]!r}")
    return int(value)


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(null|-?[0-9]+)>", uri or "")
    if not m:
        raise WarcError(f"{uri!r} is no page's id")
    return None if m[1] == "null" else int(m[1])


def parse_record(record: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload), every header, length and digest checked."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("the header has no end")
    h = _headers(head, VERSION)
    n = _number(h, "content-length")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"a block of {len(rest) - 4} bytes where {n} are announced")
    block = rest[:n]
    if h.get("warc-block-digest") != f"sha1:{sha1_base32(block)}":
        raise WarcError("the block's digest is another")
    http_head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("the HTTP header has no end")
    length = _number(_headers(http_head, "HTTP/1.1 200"), "content-length")
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "")
    url = h.get("warc-target-uri")
    url = url if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    if kind == "response":
        if length != len(payload) or digest != f"sha1:{sha1_base32(payload)}":
            raise WarcError("the payload's length or digest is another")
        return _page(h.get("warc-record-id")), url, length, digest[5:], kind, None, payload
    if kind != "revisit" or payload or h.get("warc-profile") != PROFILE or not re.fullmatch("sha1:[A-Z2-7]{32}", digest):
        raise WarcError(f"a bad record of type {kind!r}")
    return _page(h.get("warc-record-id")), url, length, digest[5:], kind, _page(h.get("warc-refers-to")), None


def _write(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        nth = n = 0
        out = writer = None
        waiting: list[bytes] = []

        def names():
            path = f"{folder}/part-{ctx.partitionId():06d}-{nth:04d}.warc.zst"
            return path, f"{path}.{ctx.taskAttemptId()}.tmp"

        def start():
            nonlocal out, writer
            out = open_shared(names()[1], "wb")
            writer = ArchiveWriter(out, waiting)
            for r in waiting:
                writer.write(r)
            waiting.clear()

        def finish():
            nonlocal out, writer, nth, n
            out.close()
            path, temp = names()
            rename_shared(temp, path)
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([writer.size], pa.int64())], names=["path", "records", "bytes"])
            out = writer = None
            nth, n = nth + 1, 0
            return row

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                record = record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, refers_to is not None)
                if writer:
                    writer.write(record)
                    if writer.size >= archive_bytes:
                        yield finish()
                    continue
                waiting.append(record)
                if len(waiting) >= SAMPLE_RECORDS or sum(map(len, waiting)) >= SAMPLE_BYTES:
                    start()
        if waiting and not writer:
            start()
        if writer:
            yield finish()

    return write


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with open_shared(path, "rb") as src:
                    for record in read_frames(src):
                        row = parse_record(record)
                        n += 1
                        rows.append(row if with_payload else (*row[:6], None))
                        size += len(record)
                        if len(rows) >= 2000 or size > 16_000_000:
                            yield out(rows)
                            rows, size = [], 0
                if expected is not None and n != expected:
                    raise WarcError(f"{path} has {n} records; {expected} were written")
                if rows:
                    yield out(rows)

    return read


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row and returns the manifest: path, records, bytes of each archive.

    Of rows with equal payloads of at least least_bytes bytes that with the largest id is the response and the others
    are revisits that refer to it; rows that repeat the largest id are all responses; smaller payloads are all responses.
    The payload is the html in UTF-8, empty where it is null. A null id is largest only among null ids. Other columns are
    ignored. An empty table writes no archive.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digest = F.when(F.octet_length(payload) >= least_bytes, F.unhex(F.sha1(payload)))
    # digests alone find what is there more than once; only rows that may be are moved, or meet a hot digest where they lie
    counts = rows.select(digest.alias("digest"), "page_id").where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    firsts = shared_table(counts.where("n > 1 and first is not null"), "firsts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    maybe = id_filter(firsts, "digest")
    marked = rows.withColumn("digest", digest)
    alone = marked.where(~F.coalesce(maybe(F.col("digest")), F.lit(False))).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    joined = join_counted(marked.where(maybe(F.col("digest"))), firsts, "digest", total, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = alone.unionAll(joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to")))
    return shared_table(ready.mapInArrow(_write(folder, archive_bytes), "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives whose path (and records, to be checked; null: not) the manifest has, whole archives to a task."""
    files = manifest.select("path", F.col("records").cast("long").alias("records"))
    n = max(1, min(10_000, files.count()))
    return files.repartition(n).mapInArrow(_read(with_payload), SCHEMA)


def round_trip(pages: DataFrame, with_payload: bool = False, **columns) -> DataFrame:
    """pages written to archives in the shared folder and read back; null ids, null and empty payloads, repeated rows and other columns
    are as in write_archives, and an empty table gives an empty one."""
    folder = new_shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **columns), with_payload)
