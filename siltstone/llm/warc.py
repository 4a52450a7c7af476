"""Legacy web archives (ARC, versions 1 and 2) read, converted to WARC, written and read back.

``read_arc`` takes the layout of a file's record lines from the version block at its
start and the extent of each record from the length that its line declares.
``convert`` synthesises what ARC lacks: record identifiers (name-based UUIDs),
ISO timestamps, record types and SHA-1 digests. A payload that is already archived
becomes a ``revisit`` record that refers to the ``response`` with that payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from siltstone.llm.scratch import discard, materialize, new_path
from siltstone.llm.tokens import open_fs

#: Fields of a record line by ARC version (fixed values of the format).
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"],
}
#: Names of those fields in the version block (fixed values of the format).
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Profile of revisits with an equal payload (a fixed value of WARC 1.0).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Uncompressed bytes after which a task begins another WARC file, and bytes of one ARC run.
SHARD_BYTES = 256 << 20
RUN_BYTES = 4 << 20
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:siltstone:archive")


class ArchiveError(ValueError):
    """An archive that doesn't keep to its format."""


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    version: int

    @property
    def url(self) -> str:
        return self.fields["url"]


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    extra: dict = field(default_factory=dict)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str | None, empty: str = "-") -> str:
    """A value fit for one field of a record line: no white space, not empty."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value or "") or empty


def http_block(headers: dict[str, object], body: bytes, status: str = "200 OK") -> bytes:
    head = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return head.encode() + b"\r\n" + body


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def write_arc(records: Iterable[tuple[str, str, str, bytes]], version: int = 1, name: str = "run.arc", date: str = "20000101000000") -> bytes:
    """An uncompressed ARC file of (url, 14-digit date, content type, block) records."""
    intro = f"{version} 0 siltstone\n{ARC_NAMES[version]}\n".encode()

    def line(url, when, kind, length, offset):
        more = [] if version == 1 else ["200", "-", "-", str(offset), name]
        return " ".join([_one_line(url), "0.0.0.0", when, kind, *more, str(length)]).encode() + b"\n"

    out = io.BytesIO()
    out.write(line(f"filedesc://{name}", date, "text/plain", len(intro), 0) + intro + b"\n")
    for url, when, kind, block in records:
        out.write(line(url, when, kind, len(block), out.tell()))
        out.write(block)
        out.write(b"\n")
    return out.getvalue()


def _arc_line(stream) -> bytes | None:
    """The next record line; blank lines between records are passed over."""
    while line := stream.readline():
        if line.strip():
            return line
    return None


def _arc_fields(line: bytes, version: int) -> dict[str, str]:
    names, values = ARC_FIELDS[version], line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    if len(values) > len(names):  # a URL or type with spaces in it: the fields at the end are sure
        values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
    if len(values) != len(names) or not values[-1].isdigit():
        raise ArchiveError(f"no version-{version} record line: {line[:200]!r}")
    return dict(zip(names, values, strict=True))


def _arc_block(stream, fields: dict[str, str]) -> bytes:
    block = stream.read(int(fields["length"]))
    if len(block) != int(fields["length"]):
        raise ArchiveError(f"record of {fields['url'][:100]} is cut off: {len(block)} of {fields['length']} bytes")
    return block


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an ARC file (gzip members or plain), its version block first."""
    if not isinstance(stream, (io.BufferedReader, io.BytesIO)):
        stream = io.BufferedReader(stream)
    if _is_gzip(stream):
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    line = _arc_line(stream)
    if line is None:
        return
    values = line.decode("utf-8", "replace").split()
    if not values[0].startswith("filedesc://") or not values[-1].isdigit():
        raise ArchiveError(f"an ARC file begins with a filedesc record, not {line[:100]!r}")
    intro = _arc_block(stream, {"url": values[0], "length": values[-1]})
    version = int(intro.split(None, 1)[0]) if intro[:1].isdigit() else 0
    if version not in ARC_FIELDS:
        raise ArchiveError(f"unknown ARC version block: {intro[:100]!r}")
    yield ArcRecord(_arc_fields(line, version if len(values) == len(ARC_FIELDS[version]) else 1), intro, version)
    while (line := _arc_line(stream)) is not None:
        fields = _arc_fields(line, version)
        yield ArcRecord(fields, _arc_block(stream, fields), version)


def _is_gzip(stream) -> bool:
    at = stream.getbuffer()[stream.tell() :][:2] if isinstance(stream, io.BytesIO) else stream.peek(2)[:2]
    return bytes(at) == b"\x1f\x8b"


def iso_date(stamp: str) -> str:
    """YYYYMMDDhhmmss, cut off anywhere after the year, as a WARC date; no date is the epoch."""
    try:
        full = stamp + "00000101000000"[len(stamp) :]
        return datetime.strptime(full[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def convert(records: Iterable[ArcRecord], refers_to: Callable[[dict[str, str], str], tuple[str, str] | None] | None = None) -> Iterator[WarcRecord]:
    """The WARC equivalents of ARC records, in their order.

    ``refers_to`` gets a response's HTTP header fields and payload digest and returns None
    or (record id, label) of the response that already holds the payload.
    """
    for r in records:
        url, http = r.url, r.url.startswith(("http:", "https:"))
        headers = {"WARC-Type": "response" if http else "resource", "WARC-Date": iso_date(r.fields["date"])}
        if url.startswith("filedesc://"):
            fields = f"software: siltstone\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC version {r.version}\r\n"
            headers |= {"WARC-Type": "warcinfo", "WARC-Filename": url[len("filedesc://") :], "Content-Type": "application/warc-fields"}
            block = fields.encode()
            headers["WARC-Record-ID"] = record_id("info", url, sha1_base32(block))
        else:
            block = r.block
            own, payload = split_http(block) if http else ({}, block)
            digest = sha1_base32(payload)
            headers |= {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response" if http else r.fields["content_type"]}
            if re.fullmatch(r"[0-9a-fA-F:.]+", r.fields["ip"]) and r.fields["ip"] != "0.0.0.0":
                headers["WARC-IP-Address"] = r.fields["ip"]
            headers["WARC-Record-ID"] = record_id("response", own.get("x-page-id") or url, digest)
            earlier = refers_to(own, digest) if refers_to and http else None
            if earlier:
                headers |= {"WARC-Type": "revisit", "WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": earlier[0], "X-Refers-To-Page": earlier[1]}
                headers["WARC-Record-ID"] = record_id("revisit", own.get("x-page-id") or url, r.fields["date"], digest)
                block = block[: len(block) - len(payload)]
        headers["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
        yield WarcRecord(headers, block)


def write_warc(record: WarcRecord, level: int = 1) -> bytes:
    """The record as one gzip member."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items()) + f"Content-Length: {len(record.block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + record.block + b"\r\n\r\n") + z.flush()


def read_warc(stream) -> Iterator[WarcRecord]:
    """The records of a WARC file (gzip members or plain); digests are checked."""
    if not isinstance(stream, (io.BufferedReader, io.BytesIO)):
        stream = io.BufferedReader(stream, 1 << 20)
    if _is_gzip(stream):
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no WARC record: {line[:100]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers.pop("Content-Length")))
        if headers.get("WARC-Block-Digest", "") not in ("", f"sha1:{sha1_base32(block)}"):
            raise ArchiveError(f"wrong block digest in {headers.get('WARC-Record-ID')}")
        yield WarcRecord(headers, block)


MANIFEST = StructType([StructField("path", StringType()), StructField("n_records", LongType()), StructField("n_bytes", LongType())])
#: The same with the hidden name under which a task wrote the file.
WRITTEN = StructType([*MANIFEST.fields, StructField("hidden", StringType())])


def archive_pages(pages: DataFrame, out_uri: str | None = None, min_bytes: int = 0, arc_version: int = 2) -> DataFrame:
    """Write (page_id, url, html) as WARC files, by way of ARC runs; return the manifest.

    Of pages with equal payloads of ``min_bytes`` at least, that with the smallest page_id
    becomes a response and the others revisits; smaller payloads are all responses. A null
    html is an empty payload, a url without http a placeholder of its page_id; a null page_id is larger than
    any other; rows that repeat the smallest page_id are all responses. Rows are dealt out
    by payload; a payload that many pages share is split over tasks by the adaptive join.
    An empty table gives no files; very long pages are one record each; only the three columns are
    read, so others may have any names. Tasks write files that readers of the folder pass over (their names begin with
    a dot); those of the attempts that Spark has committed get their names afterwards, so what a failed or rival attempt
    wrote is never read.
    """
    spark = pages.sparkSession
    out_uri, own = out_uri or new_path(spark, "warc"), uuid.uuid4().hex[:12]  # own: of this run's files among others of the folder
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("size"))
    shared = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(shared.select("sha", "first"), "payloads")
    joined = rows.join(shared, "sha", "left").select("page_id", "url", "html", "first")

    def run(batches):
        fs, base = open_fs(out_uri)
        fs.create_dir(base, recursive=True)
        out = _Shards(fs, base, out_uri, own)
        for batch in batches:
            group, held = [], 0
            for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                payload = (html or "").encode()
                kind = "text/html"
                block = http_block({"Content-Type": "text/html; charset=utf-8", "X-Page-Id": "" if page_id is None else page_id, "Content-Length": len(payload)}, payload)
                group.append((url if (url or "").startswith(("http:", "https:")) else f"http://none.invalid/{page_id}", "20000101000000", kind, block, page_id, first))
                held += len(block)
                if held >= RUN_BYTES:
                    yield from out.put(group, arc_version)
                    group, held = [], 0
            if group:
                yield from out.put(group, arc_version)
        yield from out.close()

    written = materialize(joined.mapInArrow(run, WRITTEN), "written")
    manifest = materialize(publish(written, out_uri), "manifest")
    discard(shared, written)
    return manifest


def publish(written: DataFrame, out_uri: str) -> DataFrame:
    """The manifest of written files, which get their names; a file that another attempt has named already is left as it is."""

    def run(batches):
        fs, base = open_fs(out_uri)
        for batch in batches:
            for path, hidden in zip(batch.column("path").to_pylist(), batch.column("hidden").to_pylist(), strict=True):
                name = f"{base}/{path.rpartition('/')[2]}"
                try:
                    fs.move(f"{base}/{hidden}", name)
                except OSError:
                    if fs.get_file_info(name).type != pa.fs.FileType.File:
                        raise
            yield batch.select(MANIFEST.names)

    return written.mapInArrow(run, MANIFEST)


ARC = StructType([StructField("path", StringType()), *(StructField(c, StringType()) for c in ("url", "ip", "date", "content_type")), StructField("version", IntegerType()), StructField("block", BinaryType())])


def _files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of existing archives by Spark's own reader; a file is one row, of 2 GB at most."""
    return spark.read.format("binaryFile").load(glob).select("path", "content")


def read_arc_files(spark: SparkSession, glob: str) -> DataFrame:
    """A row for each record of existing ARC files (plain, or of gzip members), without their version blocks.

    A file that is cut off, begins with no version block, or is of an unknown version raises ArchiveError.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for r in read_arc(io.BytesIO(content)):
                    if not r.url.startswith("filedesc://"):
                        values = [path, *(r.fields[c] for c in ("url", "ip", "date", "content_type")), r.version, r.block]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (*[pa.string()] * 5, pa.int32(), pa.binary()), strict=True)], ARC.names)

    return _files(spark, glob).mapInArrow(run, ARC)


def convert_arc_files(spark: SparkSession, glob: str, out_uri: str) -> DataFrame:
    """Write a WARC file, of one name with its ARC file, for each existing ARC file; return the manifest.

    A task that runs twice writes the same bytes under the same name.
    """

    def run(batches):
        fs, base = open_fs(out_uri)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = re.sub(r"\.arc(\.gz)?$", "", path.rpartition("/")[2]) + f"-{zlib.crc32(path.encode()):08x}.warc.gz"
                temp, n, size = f"{base}/.{name}.{uuid.uuid4().hex}", 0, 0
                with fs.open_output_stream(temp, compression=None) as sink:
                    for record in convert(read_arc(io.BytesIO(content))):
                        sink.write(write_warc(record))
                        n += record.headers["WARC-Type"] != "warcinfo"
                        size += len(record.block)
                fs.move(temp, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{out_uri}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], MANIFEST.names)

    return materialize(_files(spark, glob).mapInArrow(run, MANIFEST), "manifest")


class _Shards:
    """A task's WARC files, under hidden names; those that they are to have tell the run, the partition and its files."""

    def __init__(self, fs, base: str, uri: str, own: str):
        self.fs, self.base, self.uri, self.own, self.sink, self.files = fs, base, uri, own, None, 0

    def put(self, group, version: int):
        arc = write_arc([g[:4] for g in group], version)
        firsts = iter(group)

        def refers_to(http, digest):
            _, _, _, _, page_id, first = next(firsts)
            return None if first is None or first == page_id else (record_id("response", first, digest), str(first))

        if not self.sink:
            self.name = f"pages-{self.own}-{TaskContext.get().partitionId():06d}-{self.files:04d}.warc.gz"
            self.hidden = f".{self.name}.{uuid.uuid4().hex}"
            self.sink, self.n, self.size = self.fs.open_output_stream(f"{self.base}/{self.hidden}", compression=None), 0, 0
            self.files += 1
        for record in convert(read_arc(io.BytesIO(arc)), refers_to):
            if record.headers["WARC-Type"] == "warcinfo" and self.n:
                continue  # one for each file
            self.sink.write(write_warc(record))
            self.n += record.headers["WARC-Type"] != "warcinfo"
            self.size += len(record.block)
        if self.size >= SHARD_BYTES:
            yield from self.close()

    def close(self):
        if self.sink:
            self.sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{self.uri}/{self.name}"]), pa.array([self.n], pa.int64()), pa.array([self.size], pa.int64()), pa.array([self.hidden])], WRITTEN.names)
            self.sink = None


RECORDS = StructType([
    StructField("page_id", LongType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()),
    StructField("record_type", StringType()), StructField("refers_to", LongType()), StructField("url", StringType()),
    StructField("record_id", StringType()), StructField("status", IntegerType()),
])


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per response or revisit record in the files of a manifest."""

    def run(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = open_fs(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as raw:
                    for r in read_warc(raw):
                        kind = r.headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, payload = split_http(r.block)
                        digest = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http["content-length"])
                        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                            raise ArchiveError(f"wrong payload in {r.headers['WARC-Record-ID']}")
                        page, first = http.get("x-page-id", ""), r.headers.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, size, digest, kind, int(first) if first else None, r.headers["WARC-Target-URI"], r.headers["WARC-Record-ID"], int(r.block[9:12])))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return manifest.select("path").repartition(max(1, min(100_000, manifest.count())), "path").mapInArrow(run, RECORDS)


def _batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], RECORDS.names)
