"""Web archives packaged in ZIP files: written by tasks, read back by ranges."""

import base64
import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import text_slices
from .storage import checked, cut, new_path

_DATE = "2026-01-01T00:00:00Z"
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit of refers_to with the
    HTTP headers alone. Content-Length there and the digest are of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + payload if refers_to is None else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (None
    of a revisit). A response whose payload doesn't have its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


class ArchiveWriter:
    """One ZIP package: a stored WARC member of gzipped records and its stored index."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"  # a task that is tried again leaves the first try alone
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(MEMBER), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page_id: int | None, raw: bytes, level: int) -> None:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        body = packer.compress(raw) + packer.flush()
        self.member.write(body)
        self.index.append(f"{'' if page_id is None else page_id} {_DATE} {json.dumps({'offset': self.at, 'length': len(body)})}\n")
        self.at += len(body)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("".join(self.index).encode())
        self.zip.close()
        self.out.close()
        self.fs.move(self.part, self.path)


@dataclass
class Member:
    name: str
    start: int  # of its bytes in the file
    size: int
    stored: bool


def members(file, size: int) -> list[Member]:
    """The members of a ZIP file, from its central directory (ZIP64 or not) and local
    headers alone: nothing is extracted."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack("<10xHII", tail[end : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        signature, at = struct.unpack("<4s4xQ", read(tail_at + end - 20, 16))
        if signature != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        count, length, start = struct.unpack("<32xQQQ", read(at, 56))
    directory, found, at = read(start, length), [], 0
    for _ in range(count):
        method, packed, full, n, extra, comment, offset = struct.unpack("<10xH8xIIHHH8xI", directory[at : at + 46])
        name = directory[at + 46 : at + 46 + n].decode()
        more, i = directory[at + 46 + n : at + 46 + n + extra], 0
        while i + 4 <= len(more):
            tag, width = struct.unpack("<HH", more[i : i + 4])
            if tag == 1:  # ZIP64: those of the fields that are full, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", more[i + 4 : i + 4 + width // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            i += 4 + width
        n_local, extra_local = struct.unpack("<26xHH", read(offset, 30))
        found.append(Member(name, offset + 30 + n_local + extra_local, packed, method == 0))
        at += 46 + n + extra + comment
    return found


def record_ranges(uri: str, most_bytes: int = 4 << 20) -> list[tuple[int, list[int]]]:
    """(start in the file, lengths of the records) of runs of neighbouring records."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as file:
        inside = {m.name: m for m in members(file, file.size())}
        data, index = inside[MEMBER], inside[INDEX]
        if not (data.stored and index.stored):
            raise ValueError(f"{uri}: members must be stored")
        file.seek(index.start)
        entries = [json.loads(line.split(" ", 2)[2]) for line in file.read(index.size).decode().splitlines()]
    found: list[tuple[int, list[int]]] = []
    total, end = 0, -1
    for e in sorted(entries, key=lambda e: e["offset"]):
        if not found or total + e["length"] > most_bytes or e["offset"] != end:
            found.append((data.start + e["offset"], []))
            total = 0
        found[-1][1].append(e["length"])
        total, end = total + e["length"], e["offset"] + e["length"]
    return found


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, records_an_archive: int = 50_000, level: int = 1) -> DataFrame:
    """Write a record per page; (path, records) of the archives.

    Of pages with equal payloads of least_bytes or more, the one with the largest id is a
    response and the others revisit it (rows that repeat its id and payload are responses
    too, as are rows with null id). Rows with one id and different payloads are told apart
    by payload. Null html is an empty payload. Payloads are compared by SHA-1 and length;
    only ids and digests are shuffled for that, pre-aggregated, so copies of one page may
    hold any share of the rows; pages stay where they are read while the revisits are few
    enough to broadcast.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keys = [F.col(id_col).alias("page_id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n")]
    marks = cut(pages.select(*keys).where("page_id is not null").where(F.col("n") >= least_bytes).groupBy("page_id", "sha1", "n").agg(F.count("*").alias("rows")), "page-digests")
    largest = marks.groupBy("sha1", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("ids")).where("ids > 1").drop("ids")
    revisits = checked(cut(marks.join(largest, ["sha1", "n"]).where("page_id <> refers_to").select("page_id", "sha1", "n", "refers_to"), "revisits"), 100_000)
    rows = pages.select(*keys, F.col(url_col).alias("url"), F.col(html_col).alias("text"))
    folder = folder or new_path(pages.sparkSession, "archives")

    def of(batches):
        part, n, writer, done = TaskContext.get().partitionId(), 0, None, []
        for slice_, texts in text_slices(batches):
            ids, urls, refers = (slice_.column(slice_.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "refers_to"))
            for page_id, url, body, to in zip(ids, urls, texts.cast(pa.large_binary()).to_pylist(), refers, strict=True):
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{n:04d}.wacz"
                    writer, n = ArchiveWriter(name), n + 1
                writer.add(page_id, record(page_id, url, body, to), level)
                if len(writer.index) >= records_an_archive:
                    writer.close()
                    done.append((name, len(writer.index)))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, len(writer.index)))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return cut(rows.join(revisits, ["page_id", "sha1", "n"], "left").select("page_id", "url", "text", "refers_to").mapInArrow(of, "path string, records long"), "archives")


PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = False, task_bytes: int = 64 << 20) -> DataFrame:
    """All records of the archives (path): one task finds an archive's ranges through its
    directory and index; then ranges of some MB are dealt out and read on their own, so
    many to a task as hold task_bytes of archive, but at least a task a core."""

    def find(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                ranges = record_ranges(path)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges), pa.string()), pa.array([r[0] for r in ranges], pa.int64()), pa.array([r[1] for r in ranges], pa.list_(pa.int64()))], ["path", "start", "lengths"])

    def read(batches):
        fields = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, inside = filesystem(path)
                with fs.open_input_file(inside) as file:
                    file.seek(start)
                    body, at, rows = memoryview(file.read(sum(lengths))), 0, []
                    for n in lengths:
                        rows.append(parse_record(zlib.decompress(body[at : at + n], 31)))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(fields, types, strict=False)], fields)

    schema = PAGE + (", payload binary" if with_payload else "")
    cores = spark.sparkContext.defaultParallelism
    few = max(1, min(archives.count(), max(cores, archives.count() // 8)))
    ranges = cut(archives.select("path").repartition(few, "path").mapInArrow(find, "path string, start long, lengths array<long>"), "ranges")
    total, parts = ranges.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)), F.count("*")).first()
    tasks = max(1, min(parts, max(cores, -(-(total or 0) // task_bytes))))
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, schema)
