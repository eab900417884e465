"""WARC files stored in ZIP packages: writing them, and reading records back by byte ranges without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableweave.llm.marks import marked, marks_of
from tableweave.plans.materialize import cut, hinted, scratch_path

MEMBER, INDEX = "archive/data.warc", "indexes/index.cdx"
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "path string, records long"
RANGES = "path string, start long, size long"
RECORDS = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}, payload binary"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as any task of the cluster opens it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# ---- records


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit (refers_to isn't None) has the HTTP header, whose Content-Length is the payload's, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, dict[str, str], bytes]]:
    """(WARC header, payload start marker, HTTP header, payload) of each record in ``data``, which ends with a record."""

    def header(block: bytes) -> dict[str, str]:
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}

    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        warc = header(data[at:split])
        body = data[split + 4 : (end := split + 4 + int(warc["content-length"]))]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where its Content-Length says")
        http, _, payload = body.partition(b"\r\n\r\n")
        yield warc, http, header(http), payload
        at = end + 4


# ---- packages


def write_packages(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Writes a task's records to packages of about ``archive_bytes``; a row for each package that is complete.

    Each attempt writes files of its own names, and only rows of the attempt that succeeds count: what a lost attempt
    left is never read.
    """
    where, path = located(folder)
    where.create_dir(path, recursive=True)
    out, done = None, []

    def close() -> None:
        out["member"].close()
        with out["zip"].open(INDEX, "w") as index:
            index.writelines(out["index"])
        out["zip"].writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": MEMBER}, {"path": INDEX}]}))
        out["zip"].close()
        out["file"].close()
        done.append((f"{folder}/{out['name']}", len(out["index"])))

    for batch in batches:
        for page_id, url, html, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                name = f"pages-{uuid.uuid4().hex}.zip"
                file = where.open_output_stream(f"{path}/{name}")
                package = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED, allowZip64=True)
                out = {"name": name, "file": file, "zip": package, "member": package.open(MEMBER, "w", force_zip64=True), "index": [], "at": 0}
            data = record(page_id, url, (html or "").encode(), size, digest, refers_to)
            out["member"].write(data)
            out["index"].append(f"{json.dumps({'offset': out['at'], 'length': len(data)})}\n".encode())
            out["at"] += len(data)
            if out["at"] >= archive_bytes:
                close()
                out = None
    if out is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])


def zip_members(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """(offset of its data, size) of each stored member, from the central directory; ZIP64 fields where they are used.

    Reads the end of the file, the directory and a local header for each member looked at. Compressed members are left out.
    """
    total = file.size()

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, total - 65557)
    tail = read(tail_at, total - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file")
    entries, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if entries == 0xFFFF or 0xFFFFFFFF in (size, start):
        locator = tail_at + end - 20
        sign, _, at64, _ = struct.unpack("<IIQI", read(locator, 20))
        if sign != 0x07064B50:
            raise ValueError("the ZIP64 locator is missing")
        entries, size, start = struct.unpack("<QQQ", read(at64, 56)[32:56])
    directory, found, at = read(start, size), {}, 0
    for _ in range(entries):
        sign, flags, method, packed, plain, n_name, n_extra, n_comment, header = struct.unpack("<I4xHH8xIIHHH8xI", directory[at : at + 46])
        if sign != 0x02014B50:
            raise ValueError("the central directory is damaged")
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        if method == 0:
            found[name] = (header, packed)
    return found


def member_data(file: pa.NativeFile, header: int) -> int:
    """Where a member's data begin: its local header's name and extra field have lengths of their own."""
    file.seek(header)
    local = file.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("a local header is missing")
    return header + 30 + sum(struct.unpack("<HH", local[26:30]))


def list_ranges(batches: Iterator[pa.RecordBatch], range_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring records of about ``range_bytes``, from each package's index."""
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            where, at = located(path)
            with where.open_input_file(at) as file:
                members = zip_members(file)
                (header, size), base = members[INDEX], member_data(file, members[MEMBER][0])
                file.seek(member_data(file, header))
                start = total = 0
                for line in file.read(size).splitlines():
                    entry = json.loads(line)
                    if total and total + entry["length"] > range_bytes:
                        rows.append((path, base + start, total))
                        total = 0
                    start, total = (entry["offset"], entry["length"]) if not total else (start, total + entry["length"])
                if total:
                    rows.append((path, base + start, total))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "size"), x, strict=True)) for x in rows], pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))


def read_ranges(batches: Iterator[pa.RecordBatch], kind: pa.DataType, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The records of each range. A response's digest and size are of the payload as read; they must be as recorded."""
    schema = pa.schema([
        ("page_id", kind), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", kind), ("payload", pa.binary()),
    ])

    def known(value: str | None):
        value = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return None if not value else value if pa.types.is_string(kind) else int(value)

    for batch in batches:
        for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size")), strict=True):
            where, at = located(path)
            with where.open_input_file(at) as file:
                file.seek(start)
                data = file.read(size)
            rows = []
            for warc, _, http, payload in parse_records(data):
                digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                n = int(http["content-length"])
                if warc["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, n):
                    raise ValueError(f"a record of {path} is damaged")
                rows.append({
                    "page_id": known(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest,
                    "record_type": warc["warc-type"], "refers_to": known(warc.get("warc-refers-to")), "payload": payload if payloads else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema)


# ---- operators


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record for every row to packages below ``folder``; returns ``path, records`` of each package.

    The payload is the HTML in UTF-8 (null: empty). Of rows with equal payloads of at least ``min_revisit`` bytes the
    largest id is the response and the others revisit it; a repeat of that very row is a response too. Null urls are left
    out of the record; control characters in one are percent-encoded. Extra columns are not read.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest"),
    )
    groups = rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.filter("n > 1").select("digest", "first"), "warc-groups")
    refers = F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    # pages that can't have an equal one aren't joined: their html stays where it is
    told = marked(rows, marks_of(groups, F.xxhash64("digest"), "warc-marks"), F.xxhash64("digest"), "again")
    alone = told.filter("NOT again").select("id", "url", "html", "size", "digest", F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to"))
    ready = told.filter("again").join(hinted(groups), "digest", "left").select("id", "url", "html", "size", "digest", refers.alias("refers_to")).unionByName(alone)
    return cut(ready.mapInArrow(lambda b: write_packages(b, folder, archive_bytes), ARCHIVES), "warc-archives")


def read_archives(archives: DataFrame, id_type: str = "long", payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of packages, given a table with their ``path``: ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload`` (a revisit's payload is empty; all null if ``payloads`` is false).

    Packages' directories and indexes are listed first; the byte ranges are then dealt out evenly, so that a task's work
    depends neither on a package's size nor on how many there are.
    """
    kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    # a stage of its own: what is dealt out must not change if a task runs again
    ranges = cut(archives.select("path").mapInArrow(lambda b: list_ranges(b, range_bytes), RANGES), "warc-ranges")
    dealt = ranges.repartition(max(1, min(ranges.count(), 10_000)), "path", "start")
    return dealt.mapInArrow(lambda b: read_ranges(b, kind, payloads), RECORDS.format(id=id_type))


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives every page and reads it back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    archives = write_archives(pages, folder or scratch_path(pages.sparkSession, "warc"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(archives, kind, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
