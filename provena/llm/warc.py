"""Operator 6: WARC archives in Zstandard, with a dictionary in the leading skippable frame.

Layout of a ``.warc.zst`` file: one skippable frame (magic 0x184D2A5D, length) whose content is the dictionary,
itself compressed as a plain Zstandard frame; then one Zstandard frame for each WARC/1.1 record, compressed with
that dictionary. A reader takes the dictionary from the first frame and decodes one record at a time.

Which record is a revisit is decided before writing, from digests alone: the smallest page of each payload is
combined before the shuffle, and pages learn it by a join on the digest whose payloads stay behind. Archives roll
at ``ARCHIVE_BYTES``, are written under a temporary name and renamed, and have names that depend on the partition
and its order only, so a lost executor's archives are written again in place.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import scratch_path, write_table

DICTIONARY_MAGIC = 0x184D2A5D
#: An archive is closed once it has this many bytes, so that a reader holds one archive of about this size at most.
ARCHIVE_BYTES = 8 << 20
#: Bytes of decoded records that a reader holds before it passes them on.
READ_BYTES = 4 << 20
#: Payloads that the dictionary is trained on, at most, and bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 64 << 10
_LAST = (1 << 63) - 1
#: The identical-payload-digest profile of WARC/1.1 (fixed value).
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample payloads; with too few to train one, their own bytes."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _header_value(text: str) -> str:
    """A header value on one line: control characters become percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str = EMPTY_DATE) -> bytes:
    """One WARC record: a response with the payload, or a revisit of the page ``refers_to`` without it.

    The content is an HTTP response; ``X-Page-Id`` carries the page's own id.
    """
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{uri}/{digest}')}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
        *([("WARC-Target-URI", _header_value(uri))] if uri is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        *([("WARC-Profile", REVISIT), ("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []),
        *([("X-Page-Id", str(page_id))] if page_id is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise WarcError(f"{what}: bad header line")
        try:
            out[key.strip().decode().lower()] = value.strip().decode()
        except UnicodeDecodeError:
            out[key.strip().decode("latin-1").lower()] = value.strip().decode("latin-1")
    return out


def _number(text: str | None, what: str) -> int | None:
    if text is None:
        return None
    try:
        value = int(text)
    except ValueError:
        raise WarcError(f"bad {what}") from None
    if not -(1 << 63) <= value < 1 << 63:
        raise WarcError(f"bad {what}")
    return value


def parse(data: bytes) -> dict:
    """The fields of one record; raises :class:`WarcError` where a header, length or digest is wrong.

    Responses and revisits must hold an HTTP message; a stated length or digest of its payload must be right, an
    unstated one is taken from the payload (of a revisit, which has none, it is null). Records of other types, such
    as warcinfo and request, come back with their type and their block as payload.
    """
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not mark or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("not a WARC record")
    h = _headers(lines, "record")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in h:
            raise WarcError(f"no {need}")
    if not (h["content-length"].isascii() and h["content-length"].isdigit()):
        raise WarcError("bad content-length")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("content-length does not fit the record")
    block = rest[:n]
    if h.get("warc-block-digest", "").startswith("sha1:") and h["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise WarcError("block digest differs")
    kind, stated = h["warc-type"], h.get("warc-payload-digest", "")
    if kind in ("response", "revisit"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark or not http.startswith(b"HTTP/"):
            raise WarcError("no HTTP response")
        fields = http.partition(b"\r\n")[2]
        length = _number((_headers(fields, "response") if fields else {}).get("content-length"), "length of the response")
        if kind == "revisit" and payload:
            raise WarcError("a revisit with a payload")
        size = len(payload) if kind == "response" else length
        if kind == "response" and length not in (None, size):
            raise WarcError("payload digest or length differs")
    else:
        payload, size = block, len(block)
    own = None if kind == "revisit" else base32_sha1(payload)
    if own and stated.startswith("sha1:") and stated != f"sha1:{own}":
        raise WarcError("payload digest or length differs")
    return {
        "page_id": _number(h.get("x-page-id"), "page id"),
        "url": h.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": own or stated.removeprefix("sha1:") or None,
        "record_type": kind,
        "refers_to": _number(h.get("x-refers-to-page-id"), "page id"),
        "record_id": h["warc-record-id"],
        "payload": None if kind == "revisit" else payload,
    }


class ArchiveWriter:
    """Collects the frames of one archive."""

    def __init__(self, dictionary: bytes):
        own = zstandard.ZstdCompressor().compress(dictionary)
        self.frames = [struct.pack("<II", DICTIONARY_MAGIC, len(own)), own]
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True, write_checksum=True)
        self.size, self.records = len(own) + 8, 0

    def add(self, data: bytes) -> None:
        self.frames.append(self.compressor.compress(data))
        self.size += len(self.frames[-1])
        self.records += 1


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded one frame at a time; raises :class:`WarcError` on a broken archive."""
    if len(data) < 8:
        raise WarcError("too short for an archive")
    magic, n = struct.unpack_from("<II", data)
    at, dictionary = 0, b""
    if magic == DICTIONARY_MAGIC:
        if 8 + n > len(data):
            raise WarcError("dictionary frame is cut short")
        own, at = data[8 : 8 + n], 8 + n
        try:
            dictionary = zstandard.ZstdDecompressor().decompress(own) if own[:4] == b"\x28\xb5\x2f\xfd" else own
        except zstandard.ZstdError as e:
            raise WarcError(f"dictionary: {e}") from None
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        one = decoder.decompressobj()
        try:
            out = one.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from None
        if not one.eof:
            raise WarcError(f"frame at {at} is cut short")
        at = len(data) - len(one.unused_data)
        yield out


def _named(spark: SparkSession, folder: str | None) -> str:
    return folder or scratch_path(spark, "warc")


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write one record for each row and return the manifest (path, records, bytes), as a written table.

    Of records with equal payloads of at least ``min_revisit_bytes``, that with the smallest id is a response and
    the others revisit it; smaller payloads are all responses. A null html is an empty payload; a null url leaves
    the target out; a row with a null id, or a repeat of a row with the same id and payload, is written as it
    stands (the repeat of a response is a response); an empty table writes no archive. ``folder`` must be shared by
    all executors (any store that pyarrow can write); by default it is made in the shared folder.
    """
    spark = pages.sparkSession
    folder = _named(spark, folder)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = rows.select("id", F.sha1("payload").alias("digest"), F.length("payload").alias("n"))
    first = digests.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first")
    revisits = digests.where(F.col("n") >= min_revisit_bytes).join(first, "digest").where("id > first").select(F.col("id").alias("of"), "digest", F.col("first").alias("refers_to")).distinct()
    told = rows.withColumn("digest", F.sha1("payload")).join(revisits.withColumnRenamed("digest", "of_digest"), (F.col("id") == F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    # some four times the sample passes the filter, however many rows and tasks there are
    share = min(1.0, 4 * SAMPLE_ROWS / max(1, pages.count()))
    hashed = rows.where(F.length("payload") > 0).select(F.substring("payload", 1, SAMPLE_BYTES).alias("p"), F.xxhash64("id", "payload").alias("h"))
    sample = hashed.where(F.col("h") <= min(_LAST, int((share - 0.5) * 2 * _LAST))).orderBy("h", "p").limit(SAMPLE_ROWS)
    dictionary = spark.sparkContext.broadcast(train([bytes(r.p) for r in sample.collect()]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
        store.create_dir(root, recursive=True)
        part, attempt, seq = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        out: list[tuple] = []
        archive = None

        def close():
            nonlocal archive, seq
            name = f"{root}/part-{part:05d}-{seq:05d}.warc.zst"
            with store.open_output_stream(f"{root}/.{attempt}-{part:05d}-{seq:05d}.tmp", compression=None) as sink:
                for frame in archive.frames:
                    sink.write(frame)
            if store.type_name != "local" and store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)
            store.move(f"{root}/.{attempt}-{part:05d}-{seq:05d}.tmp", name)
            out.append((f"{folder}/part-{part:05d}-{seq:05d}.warc.zst", archive.records, archive.size))
            archive, seq = None, seq + 1

        for batch in batches:
            for page, url, data, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to")), strict=True):
                archive = archive or ArchiveWriter(dictionary.value)
                archive.add(record(page.as_py(), url.as_py(), data.as_py(), refers.as_py()))
                if archive.size >= ARCHIVE_BYTES:
                    close()
        if archive:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["path", "records", "bytes"])

    return write_table(told.select("id", "url", "payload", "refers_to").mapInArrow(write, "path string, records long, bytes long"), "manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary, archive string, error string"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all ``.warc.zst`` files in ``folder``, validated: one row each, payload null for revisits.

    A broken record or archive gives a row with its ``error`` and nulls, and the archive's later frames are left
    where the frame itself can't be decoded; an empty folder gives no rows.
    """
    names = RECORDS.split(", ")
    columns = [n.split()[0] for n in names]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[n.split()[1]]) for n, c in zip(names, columns, strict=True)], columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size, frames = [], 0, read_archive(content.as_py())
                while True:
                    try:
                        data = next(frames, None)
                        if data is None:
                            break
                        rows.append(parse(data) | {"archive": path.as_py(), "error": None})
                        size += len(data)
                    except WarcError as e:
                        rows.append(dict.fromkeys(columns) | {"archive": path.as_py(), "error": str(e)})
                    if size >= READ_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """:func:`write_archives`, then :func:`read_archives` of the same folder."""
    spark = pages.sparkSession
    folder = _named(spark, folder)
    manifest = write_archives(pages, folder, **options)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], RECORDS)
    return read_archives(spark, folder)
