"""WARC archives: pages written as records, one gzip member each, and a sequential reader that checks them.

Writing: of rows with equal payloads of at least ``LEAST_SHARED`` bytes the one with the smallest id becomes a response
record, the others revisit it and store no payload; equal payloads are found by an aggregation of digests. Each task
writes archives of its own in a folder that all executors share, under names that no other attempt uses, and gives one
row an archive; these rows are written as the ``manifest`` table, so what a lost or repeated attempt left behind is in no
manifest.

Reading: an archive is read front to back. Gzip members are decompressed piece by piece, a record's header gives the
length of its block, the block must end with two line ends where its member ends, and its digests must be right. What
is wrong is told in ``fault``; reading goes on with the next record after a wrong digest, and ends an archive where its
framing is broken. Memory holds one record and one batch.

Defined results: a null payload is an empty one; a null url gives the record's own id as target; in urls, what is no
printable ASCII is percent-encoded; rows equal in id and payload are told apart by nothing, so all of them are responses if one is;
a null id never stands for others (if all ids of equal payloads are null, all are responses) and is read back as null; an
empty table gives an empty manifest and no records; columns not named are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import checkpointed, quoted

#: Payloads shorter than this are stored each time.
LEAST_SHARED = 100
#: An archive that has this many bytes is closed and another begun.
ARCHIVE_BYTES = 256 << 20
#: Bytes read, and bytes decompressed, at once; bytes of payload in one batch of rows.
PIECE, BATCH_BYTES = 1 << 16, 8 << 20
#: The longest header of a record that is read.
HEADER_BYTES = 1 << 20
#: Archives are read by at most so many tasks.
READ_TASKS = 100_000

#: Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
RECORD_URI = "urn:corpusloom:page:"


class WarcError(ValueError):
    """An archive that isn't framed as records in gzip members."""


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        uri = "/" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def record_id(page_id: str | None) -> str:
    return f"<{RECORD_URI}{quote(page_id or '', safe='')}>"


def page_of(record: str | None) -> str | None:
    """The row's id in a record's id; None where it was null or another writer made the record."""
    found = record.strip("<>").removeprefix(RECORD_URI) if record and record.startswith(f"<{RECORD_URI}") else ""
    return unquote(found) or None


def member(headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    lines = {**headers, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n"
    return b"".join((packer.compress(head), packer.compress(block), packer.compress(END), packer.flush()))


def page_member(page_id: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """A page as a response, or as a revisit of the page ``first``."""
    own = record_id(page_id)
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else own.strip("<>")
    headers = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": HTTP}
    if first is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first)}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(headers, http + payload if first is None else http)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row as a record under ``folder``; (path, records, bytes) of the archives, read from its manifest."""
    payload = F.coalesce(F.col(quoted(payload_col)).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    shared = shared.where("copies > 1 AND first IS NOT NULL").select(F.col("digest").alias("same"), "first")
    placed = rows.join(shared, F.col("digest") == F.col("same"), "left")
    placed = placed.select(F.col("id").cast("string"), "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("first"))
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        name, out, records, size = "", None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*batch.columns, strict=True):
                if out is not None and size >= archive_bytes:
                    yield closed()
                    out = None
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
                    size += out.write(member(info, b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_member(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), first.as_py(), date))
                records += 1
        if out is not None:
            yield closed()

    placed.mapInArrow(run, "path string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark, folder: str) -> DataFrame:
    """The archives that a finished write has left in a folder."""
    return spark.read.schema("path string, records long, bytes long").parquet(f"{folder}/manifest")


class Members:
    """The gzip members of a stream, front to back."""

    def __init__(self, stream):
        self.stream, self.kept, self.at = stream, b"", 0

    def more(self) -> bool:
        self.kept = self.kept or self.stream.read(PIECE)
        return bool(self.kept)

    def pieces(self) -> Iterator[bytes]:
        """The next member's content, at most PIECE bytes at once."""
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            given = self.kept or self.stream.read(PIECE)
            try:
                piece = unpacker.decompress(given, PIECE)
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from None
            if not given and not piece and not unpacker.eof:
                raise WarcError("archive ends within a gzip member")
            self.kept = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            self.at += len(given) - len(self.kept)
            yield piece


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def get(self, name: str) -> str | None:
        return self.headers.get(name.lower())

    def split(self) -> tuple[bytes, bytes]:
        """HTTP header and payload of the block."""
        if not (self.get("Content-Type") or "").startswith("application/http"):
            return b"", self.block
        head, _, payload = self.block.partition(END)
        return head, payload

    def fault(self) -> str | None:
        """Which digest is wrong."""
        if not right(self.get("WARC-Block-Digest"), self.block):
            return "block digest"
        if self.get("WARC-Type") != "revisit" and not right(self.get("WARC-Payload-Digest"), self.split()[1]):
            return "payload digest"
        return None


def right(told: str | None, data: bytes) -> bool:
    """Whether a digest "name:value" (hex or base 32) is that of the data; unknown names and no digest are right."""
    name, _, value = (told or "").partition(":")
    if not value or name.lower() not in hashlib.algorithms_guaranteed:
        return True
    own = hashlib.new(name.lower(), data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def one_record(pieces: Iterator[bytes]) -> Record:
    """The record that is the whole of one gzip member."""
    held, end = bytearray(), -1
    while end < 0:
        piece = next(pieces, None)
        if piece is None or len(held) > HEADER_BYTES:
            raise WarcError("no end of a record's header")
        seen = max(0, len(held) - 3)
        held += piece
        end = held.find(END, seen)
    version, *lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    last = ""
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
        elif colon:
            last = name.strip().lower()
            headers[last] = value.strip()
        else:
            raise WarcError("a header line without colon")
    told = headers.get("content-length", "")
    if not (told.isascii() and told.isdigit()):
        raise WarcError("no Content-Length")
    del held[: end + 4]
    size = int(told) + len(END)
    for piece in pieces:
        held += piece
        if len(held) > size:
            break
    if len(held) != size or not held.endswith(END):
        raise WarcError("Content-Length and gzip member differ")
    return Record(headers, bytes(held[: -len(END)]))


def records_of(stream) -> Iterator[tuple[int, int, Record | None, str | None]]:
    """(offset, compressed length, record, fault) of a stream's records; the record is None where the framing is broken."""
    members = Members(stream)
    while members.more():
        offset = members.at
        try:
            record = one_record(members.pieces())
        except WarcError as e:
            yield offset, members.at - offset, None, str(e)
            return
        yield offset, members.at - offset, record, record.fault()


SCHEMA = "path string, offset long, length long, record_type string, record_id string, page_id string, target_uri string, refers_to string, refers_to_page string, payload_bytes long, payload_digest string, payload binary, fault string"


def described(record: Record | None, with_payload: bool) -> tuple:
    """A record's columns from record_type to payload."""
    if record is None:
        return (None,) * 9
    head, payload = record.split()
    own, refers, told, size = record.get("WARC-Record-ID"), record.get("WARC-Refers-To"), record.get("WARC-Payload-Digest"), len(payload)
    revisit = record.get("WARC-Type") == "revisit"
    if revisit:
        digest, size = (told or "").removeprefix("sha256:").lower() or None, None
        for line in head.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                with contextlib.suppress(ValueError):
                    size = int(line[15:])
    else:
        digest = hashlib.sha256(payload).hexdigest()
    return record.get("WARC-Type"), own, page_of(own), record.get("WARC-Target-URI"), refers, page_of(refers), size, digest, payload if with_payload and not revisit else None


def read_archives(archives: DataFrame, payloads: bool = True, path_col: str = "path") -> DataFrame:
    """A row for every record of the archives, warcinfo and others too, and a row with ``fault`` where one is broken.

    payload_digest is the SHA-256 of the payload in lower-case hex, of a revisit the one that it tells; its payload is null.
    """
    n = min(READ_TASKS, max(1, archives.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, own = filesystem(path)
                with fs.open_input_stream(own, compression=None) as stream:
                    for offset, length, record, fault in records_of(stream):
                        rows.append((path, offset, length, *described(record, payloads), fault))
                        held += len(rows[-1][-2] or b"") + 500
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select(F.col(quoted(path_col)).cast("string").alias("path")).repartition(n).mapInArrow(run, SCHEMA)


def unbroken(value: Column) -> Column:
    """The value, or an error where the record has a fault."""
    told = F.concat_ws(" ", F.col("path"), F.col("offset").cast("string"), F.col("fault"))
    return F.when(F.col("fault").isNotNull(), F.raise_error(told).cast("string")).otherwise(value)


def resolved(records: DataFrame) -> DataFrame:
    """Response and revisit records, each revisit held against the response that it refers to.

    ``fault`` tells a revisit whose response (by record id and payload digest) isn't there or has another length.
    The records are cut to their short columns and checkpointed, so archives are read once.
    """
    short = checkpointed(records.drop("payload", "length", "target_uri")).where("record_type IN ('response', 'revisit') OR fault IS NOT NULL")
    revisit = F.col("record_type").eqNullSafe("revisit")
    responses = short.where("record_type = 'response' AND fault IS NULL").groupBy(F.col("record_id").alias("r"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("full"))
    # what is known of the archives' sizes before they are read must not decide how this is joined
    found = short.where(revisit).join(responses.hint("merge"), (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("d")), "left")
    fault = F.coalesce("fault", F.when(F.col("full").isNull() | (F.col("full") != F.coalesce("payload_bytes", "full")), F.lit("no such response")))
    return short.where(~revisit).unionByName(found.select(*(c for c in short.columns if c != "fault"), fault.alias("fault")))
