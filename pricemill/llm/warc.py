"""WARC archives in Zstandard form: a writer, and a reader that trusts nothing it has not checked.

An archive begins with a skippable frame that holds the dictionary; after it comes one frame per
record, all compressed with that dictionary. The reader loads the dictionary, decodes one frame
after the other and checks headers, lengths and digests of each record. Archives of others are read
too: without a dictionary, with records of any type, folded headers, ids of any form. Files are reached
through Arrow's file systems by URI, so tasks read and write them wherever the work folder is.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pricemill.operators.joins import lookup_join
from pricemill.session import stage, work_folder

# Fixed values of the format: the magic number of the skippable frame with the dictionary, and of frames.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

# Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
# Records are gathered in archives of about this size; the dictionary is trained on the first records.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES, TRAINING_RECORDS, TRAINING_BYTES = 16 << 10, 200, 2 << 20

# ``page_id`` and ``refers_to`` are the numbers of this writer's pages; they are null for other ids.
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary, record_id string, refers_to_id string"
)


class ArchiveError(ValueError):
    """An archive that is cut off, or whose headers, lengths or digests are wrong."""


def record_uri(page_id: int | None, *rest: str | None) -> str:
    """A page's number is the lower half of its UUID; rows without one get a UUID made from ``rest``, which is larger."""
    made = uuid.uuid5(uuid.NAMESPACE_URL, repr(rest)) if page_id is None else uuid.UUID(int=page_id % (1 << 64))
    return f"<urn:uuid:{made}>"


def _page_of(uri: str | None) -> int | None:
    digits = re.fullmatch("<?urn:uuid:([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})>?", uri or "")
    value = uuid.UUID(digits[1]).int if digits else 1 << 64
    if value >= 1 << 64:
        return None
    return value - (1 << 64) if value >= 1 << 63 else value


def _safe(value: str) -> str:
    """A header value: line breaks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def encode_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes | None) -> bytes:
    """The bytes of one record; a revisit carries the HTTP head alone, which still tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + (payload or b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_uri(page_id, url, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _safe(url)))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _fields(head: bytes, once: bool = True) -> dict[str, str]:
    """Header names in lower case with their values; a line that begins with a space continues the one before.

    A name may come again only if ``once`` is not asked for, as in HTTP heads; then the first counts.
    """
    fields, name = {}, None
    for line in _text(head).split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            fields[name] = f"{fields[name]} {line.strip(' \t')}".strip(" ")
            continue
        name, colon, value = line.partition(":")
        name = name.rstrip(" \t").lower()
        if not colon or not name:
            if once:
                raise ArchiveError(f"not a header: {line[:80]!r}")
            name = ""
        elif name not in fields:
            fields[name] = value.strip(" \t")
        elif once and name != "warc-concurrent-to":  # the one field that the standard lets come again
            raise ArchiveError(f"header twice: {name}")
        else:
            name = ""
    return fields


def _digest(labelled: str | None) -> tuple[str, str]:
    """Algorithm and lower-case hex digits of ``sha1:...``, in base 32 or hex."""
    algorithm, _, digits = (labelled or "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in ("sha1", "sha256", "md5"):
        return algorithm, ""
    size = hashlib.new(algorithm, usedforsecurity=False).digest_size
    if len(digits) == 2 * size:
        return algorithm, digits.lower()
    try:
        return algorithm, base64.b32decode(digits.upper() + "=" * (-len(digits) % 8)).hex()
    except binascii.Error as error:
        raise ArchiveError(f"not a digest: {labelled}") from error


def _check(name: str, data: bytes, labelled: str | None) -> None:
    algorithm, wanted = _digest(labelled)
    if wanted and hashlib.new(algorithm, data, usedforsecurity=False).hexdigest() != wanted:
        raise ArchiveError(f"{name} does not fit its digest")


def decode_record(record: bytes) -> tuple:
    """Check a record and give it as a row of :data:`RECORD`.

    The payload of a response is what follows the HTTP head, that of other types the whole block; a
    revisit has none, and its length and digest are those it tells of. Lengths and digests are checked
    where they are given; a payload that was cut or is coded for transfer need not fit those of HTTP.
    """
    version = re.match(rb"WARC/[0-9]+\.[0-9]+\r\n", record)
    if not version:
        raise ArchiveError("no version line")
    end = record.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise ArchiveError("headers without an end")
    fields = _fields(record[version.end() : end])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"no {name}")
    block = record[end + 4 : -4]
    size = fields["content-length"]
    if record[-4:] != b"\r\n\r\n" or not re.fullmatch("[0-9]+", size) or int(size) != len(block):
        raise ArchiveError(f"block of {len(block)} bytes, not of {size}")
    _check("block", block, fields.get("warc-block-digest"))
    kind, told = fields["warc-type"].lower(), fields.get("warc-payload-digest")
    payload, length, coded = block, "", "warc-truncated" in fields
    if kind in ("response", "revisit") and fields.get("content-type", "").lower().startswith("application/http") and (block or kind == "response"):
        at = block.find(b"\r\n\r\n")
        status, _, http = block[:at].partition(b"\r\n")
        if at < 0 or not status.startswith(b"HTTP/"):
            raise ArchiveError("no HTTP head")
        heads = _fields(http, once=False)
        payload, length = block[at + 4 :], heads.get("content-length", "")
        length = length if re.fullmatch("[0-9]{1,18}", length) else ""
        coded = coded or "transfer-encoding" in heads
        if length and not coded and kind == "response" and "content-encoding" not in heads and int(length) != len(payload):
            raise ArchiveError(f"payload of {len(payload)} bytes, not of {length}")
    page, uri = _page_of(fields["warc-record-id"]), fields.get("warc-target-uri")
    target = fields.get("warc-refers-to")
    if kind == "revisit":
        if "warc-profile" not in fields or payload and fields["warc-profile"] == REVISIT_PROFILE:
            raise ArchiveError("not a revisit of an equal payload")
        algorithm, digest = _digest(told)
        return (
            page, uri, kind, _page_of(target), int(length) if length else None, digest if algorithm == "sha1" and digest else None,
            None, fields["warc-record-id"], target,
        )
    if not coded:
        _check("payload", payload, told)
    made = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    return page, uri, kind, _page_of(target), len(payload), made, payload, fields["warc-record-id"], target


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from some records; where there are too few to train on, their own bytes serve."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC").ljust(8, b" ")


def write_archive(stream, first: list[bytes], rest: Iterator[bytes]) -> int:
    """Dictionary frame, then a frame for each record; gives the number of records."""
    dictionary = train_dictionary(first)
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    shared = zstandard.ZstdCompressionDict(dictionary)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)
    n = 0
    for records in (first, rest):
        for record in records:
            stream.write(compressor.compress(record))
            n += 1
    return n


def read_archive(stream) -> Iterator[tuple]:
    """The checked records of an archive, one frame at a time."""
    head = stream.read(8)
    magic = struct.unpack("<I", head[:4])[0] if len(head) == 8 else None
    if magic == FRAME_MAGIC:  # an archive without a dictionary begins with its first record
        rest, decompressor = head, zstandard.ZstdDecompressor()
    elif magic == DICTIONARY_MAGIC:
        size = struct.unpack("<I", head[4:])[0]
        dictionary = stream.read(size)
        if len(dictionary) != size:
            raise ArchiveError("dictionary cut off")
        if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        rest, decompressor = b"", zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    else:
        raise ArchiveError("no dictionary frame or record at the beginning")
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        if len(rest) < 4:
            rest += stream.read(1 << 20)
        if len(rest) < 4 or struct.unpack("<I", rest[:4])[0] != FRAME_MAGIC:
            raise ArchiveError("no frame where a record should begin")
        frame, record = decompressor.decompressobj(), io.BytesIO()
        while not frame.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    raise ArchiveError("last frame cut off")
            try:
                record.write(frame.decompress(rest))
            except zstandard.ZstdError as error:
                raise ArchiveError(str(error)) from error
            rest = frame.unused_data if frame.eof else b""
        yield decode_record(record.getvalue())


def _open(uri: str, write: bool = False):
    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)  # not a second time, for the file's ending
    return system.open_input_stream(path, compression=None)


def _uri(folder: str) -> str:
    return folder if "://" in folder else re.sub("^file:/*", "file:///", folder) if folder.startswith("file:") else f"file://{folder}"


def _write(folder: str, archive_bytes: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield encode_record(*row)

    def some(source: Iterator[bytes], limit: int, most: int) -> Iterator[bytes]:
        size = 0
        while size < limit and most > 0:
            record = next(source, None)
            if record is None:
                return
            size += len(record)
            most -= 1
            yield record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, task = records(batches), TaskContext.get()
        number = 0
        while True:
            first = list(some(source, TRAINING_BYTES, TRAINING_RECORDS))
            if not first:
                return
            # an attempt has its own files; only those of the attempt that succeeds are listed
            uri = f"{folder}/part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
            with _open(uri, write=True) as stream:
                n = write_archive(stream, first, some(source, archive_bytes, 1 << 62))
            number += 1
            yield pa.RecordBatch.from_pylist([{"archive": uri, "records": n}], pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "record_id", "refers_to_id"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    for batch in batches:
        for uri, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, size, n = [], 0, 0
            with _open(uri) as stream:
                for row in read_archive(stream):
                    rows.append(row)
                    size += row[4] if row[6] is not None else 0
                    n += 1
                    if size > 4 << 20 or len(rows) >= 1000:
                        yield emit(rows)
                        rows, size = [], 0
            if wanted is not None and n != wanted:
                raise ArchiveError(f"{uri}: {n} records, not {wanted}")
            if rows:
                yield emit(rows)


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None,
    revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row and give the table of files, (archive, records).

    A null html is an empty payload. Of equal payloads of at least ``revisit_bytes`` bytes the rows
    with the largest id are responses, all others revisit it. A row without an id is a response. Rows
    with the same id are all written. A payload that more than 1/1000 of the large repeated ones
    equal is decided without a shuffle by its digest, as are small payloads: their rows are dealt out.
    """
    spark = pages.sparkSession
    folder = _uri(folder or f"{work_folder(spark)}/warc-{uuid.uuid4().hex}")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    rows = rows.withColumn("same", F.when((F.col("size") >= revisit_bytes) & F.col("page_id").isNotNull(), F.concat_ws(":", "digest", "size")))
    groups = rows.where("same IS NOT NULL").groupBy("same").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    first = stage(groups.where("n > 1"), "responses")
    revisits = F.coalesce(F.col("response") > F.col("page_id"), F.lit(False))
    joined = lookup_join(rows, first, "same", F.xxhash64("page_id", "url"), weight="n").select(
        "page_id", "url", F.when(revisits, "revisit").otherwise("response"), F.when(revisits, F.col("response")),
        "digest", "size", F.when(~revisits, F.col("payload")),
    )
    return stage(joined.mapInArrow(_write(folder, archive_bytes), "archive string, records bigint"), "archives")


def read_archives(archives: DataFrame, closed: bool = True) -> DataFrame:
    """The records (:data:`RECORD`) of a table of files; a file is one task's work.

    Where the number of records of a file is null, it is not checked. A revisit has no payload of its
    own. In a ``closed`` set of files each that names a page must name a response of the same digest
    and length in one of them; else the job fails, as it does for any broken archive. Only the
    different references take part in that check, so neither payloads nor a popular page meet in a task.
    """
    files = max(1, archives.count())
    dealt = archives.select("archive", "records").repartition(min(files, 10_000), "archive")
    records = stage(dealt.mapInArrow(_read, RECORD), "records")
    if closed:
        keys = ["page", "payload_digest", "payload_bytes"]
        named = records.where("record_type = 'revisit' AND refers_to IS NOT NULL").withColumnRenamed("refers_to", "page")
        there = records.where("record_type = 'response'").withColumnRenamed("page_id", "page")
        missing = named.select(*keys).distinct().join(there.select(*keys), keys, "left_anti").first()
        if missing is not None:
            raise ArchiveError(f"a revisit refers to no equal payload: {missing}")
    return records
