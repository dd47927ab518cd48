"""WARC archives in Zstandard: a dictionary at the head of each file, then one frame per record.

1. Equal payloads meet by digest. The smallest id of a payload is found in two partial steps, (digest, salt) and digest, and
   goes back to the rows by (digest, salt), so a payload that a third of all rows share is spread over many tasks. Only digests
   that occur twice take part; where they are few, Spark broadcasts them by their measured size and no payload moves.
2. A task writes the records of its rows to files of about FILE_BYTES. The first SAMPLE_BYTES of a file's records, bounded
   whatever the input, train its dictionary. It goes, compressed, into a leading skippable frame (magic 0x184D2A5D); a
   warcinfo record and every record follow as frames of their own, compressed with it and closed by a checksum. Where a file
   holds too little to train on, the dictionary is the sample itself.
3. Spark's own writer puts the bytes into files, so that a task that is lost or run twice leaves each record once. It ends each
   row with a separator; that is an empty skippable frame, which readers pass over.
4. The reader finds frames by their block headers, takes the dictionary, checks lengths and digests, and raises on a mismatch.

Files take the names that Spark gives them.

Defined cases: a null payload counts as empty; payloads below ``least`` bytes are never revisits; a null id comes after all
others, and where a payload has null ids only, all are responses; rows that repeat the smallest id of a payload are all
responses; a null url gives no target; control characters and blanks in a url are percent-encoded; a payload of any length
is one record in one frame; an empty table gives no files and no rows; further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewatch.llm.common import lean, stage, text_batches, text_of, work_path

#: Payloads of fewer bytes are never written as revisits.
LEAST = 0
FILE_BYTES = 32 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Decoded bytes held before rows are handed on.
HELD_BYTES = 8 << 20

# Fixed values of the formats.
SKIPPABLE, DICTIONARY_MAGIC = 0x184D2A50, 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)

_FRAMES = "file int, place long, frame binary"
_RECORDS = "id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _urn(id_: int | None) -> str:
    return f"<urn:page:{'null' if id_ is None else id_}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def page_record(id_: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(id_)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    if revisit:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, http if revisit else http + payload)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; the samples' last ``size`` bytes where there are too few to train on."""
    if sum(map(len, samples)) >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8)
        except zstandard.ZstdError:  # for instance a single long sample
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-size:])


def _head(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def _writer(date: str, file_bytes: int, sample_bytes: int) -> Callable:
    """Rows (id, url, payload, revisit, refers_to) -> frames of numbered files, each file's dictionary first."""

    def opened(file: int, held: list[bytes]) -> tuple[list[tuple[int, int, bytes]], zstandard.ZstdCompressor]:
        dictionary = build_dictionary(held)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        name = hashlib.sha1(dictionary.as_bytes()).hexdigest()
        info = _record(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:sha1:{name}:{file}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
            b"software: sievewatch\r\nformat: WARC File Format 1.1\r\n",
        )
        frames = [_head(dictionary), packer.compress(info), *map(packer.compress, held)]
        return [(file, i, f) for i, f in enumerate(frames)], packer

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        file, place, frame = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(file, pa.int32()), pa.array(place, pa.int64()), pa.array(frame, pa.binary())], names=["file", "place", "frame"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, packer, held, waiting, written = 0, 0, None, [], 0, 0
        for batch in batches:
            rows = []
            plain = [batch.column(c).to_pylist() for c in (0, 1, 3, 4)]
            for id_, url, revisit, refers_to, payload in zip(*plain, batch.column(2), strict=True):
                record = page_record(id_, url, payload.as_py(), revisit, refers_to, date)
                if packer is None:
                    held.append(record)
                    waiting += len(record)
                    if waiting < sample_bytes:
                        continue
                    new, packer = opened(file, held)
                    held, waiting = [], 0
                else:
                    new = [(file, place, packer.compress(record))]
                rows += new
                place = rows[-1][1] + 1
                written += sum(len(f) for _, _, f in new)
                if written >= file_bytes:
                    file, place, packer, written = file + 1, 0, None, 0
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of(opened(file, held)[0])

    return write


def with_originals(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, url, payload, revisit, refers_to) of each row."""
    spark = pages.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = text_of(payload_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.pmod(F.xxhash64("id", "url"), F.lit(salts)).alias("salt"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id"))
    spread = stage(rows.where(F.length("payload") >= least).groupBy("digest", "salt").agg(first.alias("first"), F.count("*").alias("n")), "payload-digests")
    whole = spread.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    repeated = stage(spread.select("digest", "salt").join(whole, "digest"), "repeated-payloads").select("digest", "salt", F.col("first.id").alias("original"), F.lit(True).alias("shared"))
    # a digest of another length than ``least`` allows is in no row of ``repeated``, so short payloads stay responses
    joined = rows.join(repeated, ["digest", "salt"], "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("original"))
    return joined.select("id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("original")).alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = LEAST, date: str = "2026-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, sample_bytes: int = SAMPLE_BYTES,
) -> None:
    """Write one record per row of ``pages`` into files below ``path``, a folder that all executors reach."""
    text_batches(pages.sparkSession)
    rows = with_originals(pages, id_col, url_col, payload_col, least)
    frames = rows.mapInArrow(lean(_writer(date, file_bytes, sample_bytes)), _FRAMES).sortWithinPartitions("file", "place")
    lines = frames.select("file", F.col("frame").cast("string").alias("value"))
    lines.write.partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends: its header, its blocks, and a checksum if it has one."""
    head = bytes(data[at: at + 18])
    end = at + zstandard.frame_header_size(head)
    last = 0
    while not last:
        block = int.from_bytes(data[end: end + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * zstandard.get_frame_parameters(head).has_checksum


def archive_records(data: memoryview) -> Iterator[bytes]:
    """The records of one file."""
    at, packer = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if magic == DICTIONARY_MAGIC:
                dictionary = zstandard.ZstdDecompressor().decompress(bytes(data[at + 8: at + 8 + size]))
                packer = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            at += 8 + size
        else:
            end = _frame_end(data, at)
            yield packer.decompress(data[at:end])
            at = end


def _id_of(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def parse_record(record: bytes) -> tuple | None:
    """(id, target, payload bytes, digest, type, refers to, payload or None) of a page's record; None for other records."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError(f"record {fields['WARC-Record-ID']} holds {len(rest) - 4} bytes, not {size}")
    http, payload = rest[:size].split(b"\r\n\r\n", 1)
    (length,) = (int(line.split(b": ", 1)[1]) for line in http.split(b"\r\n")[1:] if line.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers_to = _id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    return _id_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind, refers_to, payload if kind == "response" else None


def _reader(payloads: bool) -> Callable:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = ["id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: 6 + payloads], types, strict=True)], names=names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in archive_records(memoryview(content.as_buffer())):
                    row = parse_record(record)
                    if row is None:
                        continue
                    rows.append(row)
                    held += len(record)
                    if held >= HELD_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(id, target_uri, payload_bytes, payload_digest, record_type, refers_to[, payload: null for revisits]) of all records below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(lean(_reader(payloads)), _RECORDS + ", payload binary" * payloads)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and report what they hold."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False).drop("target_uri")


#: The same by SQL; five hex digits are four letters of base32.
ARCHIVE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS original FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    list_sum([(instr('0123456789abcdef', substr(digest, (1 + 5 * (i // 4) + j)::INTEGER, 1)) - 1) * (16 ** (4 - j))::BIGINT for j in range(5)])::BIGINT
      >> (15 - 5 * (i % 4))::BIGINT & 31)::INTEGER, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN payload_bytes < {LEAST} OR page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> original THEN original END AS refers_to
FROM f
"""
