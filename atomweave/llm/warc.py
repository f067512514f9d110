"""WARC archives: writing, normalising monolithic gzip files, and reading by a sidecar index.

``write_archives`` writes rows as WARC/1.1 response and revisit records into gzip files of a single member
(one compressed stream per file). ``normalise`` inflates such a file once, as a stream, rewrites every record as
a gzip member of its own and writes a sidecar index (offset, length, type, id, digest) beside it, so that any
record can be read alone. ``read_records`` opens each member at its indexed offset.

A task writes files under names of its own attempt and returns them; only returned files count, so a task
that is run again leaves nothing wrong behind. Files go to the shared folder through pyarrow's filesystems.

Null html is an empty payload; a null url has no target header; a null page_id is kept, but is never what a
revisit refers to. Rows that repeat the smallest page_id of their payload are all responses. Other
columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.llm.common import fresh_path, materialise

CHUNK = 1 << 20
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
SALTS = 32
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"


def deduplicated(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url") -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the smallest page_id with an equal payload, null on that row itself.

    Digests are counted with partial sums, only those of several ids are joined back, and the join is salted:
    a payload that a third of all rows share is dealt to many tasks.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    keys = pages.select(F.col(id_col).cast("long").alias("page_id"), body.alias("html")).where(F.octet_length("html") >= min_bytes)
    first = (
        keys.groupBy(F.sha1(F.col("html").cast("binary")).alias("sha"))
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
        .where("first_id < last_id")
        .select("sha", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt"))
    )
    return rows.join(first, ["sha", "salt"], "left").select(
        "page_id", "url", "html", F.when(F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull()), F.col("first_id")).alias("refers_to")
    )


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(s: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit holds the HTTP head alone, whose Content-Length tells the payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write (page_id, url, html, refers_to) rows; returns the manifest (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base)
        tag = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        made: list[tuple[str, int]] = []
        out = gz = None
        size = count = 0

        def close() -> None:
            out.write(gz.flush())
            out.close()
            made[-1] = (made[-1][0], count)

        for b in batches:
            for page_id, url, html, ref in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{tag}-{len(made):04d}.warc.gz"
                    out, gz, size, count = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    made.append((f"{folder}/{name}", 0))
                raw = record(page_id, url, html.encode(), ref)
                out.write(gz.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    return materialise(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records long"), "warc-manifest")


class RecordStream:
    """Parses the records of a gzip file of one or many members, as a stream: memory holds a chunk and a header."""

    def __init__(self, source):
        self.source, self.z, self.buf, self.end = source, zlib.decompressobj(31), b"", False

    def _fill(self) -> bool:
        while not self.end:
            raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            raw = raw or self.source.read(CHUNK)
            if not raw:
                self.end = True
                return False
            got = self.z.decompress(raw, CHUNK)
            if got:
                self.buf += got
                return True
        return False

    def header(self) -> tuple[bytes, dict[str, str]] | None:
        """The next record's raw header and its fields by lower-case name."""
        while True:
            self.buf = self.buf.lstrip(b"\r\n")
            at = self.buf.find(b"\r\n\r\n")
            if at >= 0:
                break
            if not self._fill():
                if self.buf:
                    raise ValueError("the archive ends within a record's header")
                return None
        raw, self.buf = self.buf[: at + 4], self.buf[at + 4 :]
        lines = raw.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        return raw, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}

    def block(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.buf and not self._fill():
                raise ValueError("the archive ends within a record")
            part, self.buf = self.buf[:length], self.buf[length:]
            length -= len(part)
            yield part


def normalise_file(archive: str, target: str, level: int = 4) -> int:
    """Rewrite one archive with a member per record; the sidecar is ``target`` + '.idx', a JSON line per record."""
    fs, path = _fs(archive)
    tfs, tpath = _fs(target)
    offset = n = 0
    with fs.open_input_stream(path, compression=None) as src, tfs.open_output_stream(tpath, compression=None) as out, tfs.open_output_stream(f"{tpath}.idx", compression=None) as idx:
        stream = RecordStream(src)
        while (h := stream.header()) is not None:
            raw, fields = h
            gz = zlib.compressobj(level, zlib.DEFLATED, 31)
            parts = [gz.compress(raw)]
            size = len(parts[0])
            out.write(parts[0])
            for chunk in stream.block(int(fields["content-length"])):
                got = gz.compress(chunk)
                out.write(got)
                size += len(got)
            got = gz.compress(b"\r\n\r\n") + gz.flush()
            out.write(got)
            size += len(got)
            entry = {"offset": offset, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "digest": fields.get("warc-payload-digest")}
            idx.write(json.dumps(entry).encode() + b"\n")
            offset, n = offset + size, n + 1
    return n


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of a manifest, a task each; returns the manifest of normalised files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs, base = _fs(folder)
            fs.create_dir(base)
            names, counts = [], []
            for archive, expected in zip(*(c.to_pylist() for c in b.columns)):
                name = f"{folder}/{archive.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                n = normalise_file(archive, name)
                if n != expected:
                    raise ValueError(f"{archive}: {n} records, {expected} were written")
                names.append(name)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    n = max(1, archives.count())
    return materialise(archives.select("archive", "records").repartition(n).mapInArrow(run, "archive string, records long"), "warc-normalised")


def _number(uri: str | None) -> int | None:
    s = (uri or "").strip("<>").removeprefix(RECORD_ID)
    return int(s) if s else None


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record by its sidecar entry: (page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload]).

    The digest of a response is computed from the payload read and held against its header.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload

    def rows(archive: str) -> Iterator[tuple]:
        fs, path = _fs(archive)
        with fs.open_input_file(path) as f, fs.open_input_stream(f"{path}.idx", compression=None) as idx:
            for line in idx.read().splitlines():
                e = json.loads(line)
                f.seek(e["offset"])
                raw = zlib.decompress(f.read(e["length"]), 31)
                head, _, rest = raw.partition(b"\r\n\r\n")
                fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
                block = rest[: int(fields["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                declared = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and digest(payload) != declared:
                    raise ValueError(f"{archive}: the payload of {e['id']} differs from its digest")
                size = len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1])
                row = (_number(fields["warc-record-id"]), size, declared, kind, _number(fields.get("warc-refers-to")), fields.get("warc-target-uri"))
                yield (*row, payload) if with_payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 6 + with_payload]
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for archive in b.column(0).to_pylist():
                part: list[tuple] = []
                for r in rows(archive):
                    part.append(r)
                    if len(part) == (64 if with_payload else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(run, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and read every record back by the index."""
    raw = write_archives(deduplicated(pages, min_bytes), fresh_path(spark, "warc-raw"))
    return read_records(normalise(raw, fresh_path(spark, "warc")))
