"""WARC records in ZIP packages: written, located through the ZIP directories and range-read.

A package is a ZIP file with stored (not deflated) members: ``archive/*.warc.gz``
with one gzip member per record, and ``indexes/index.cdxj`` with the offset
and length of each record.  Reading never unpacks a package: tasks read the
end record, the ZIP64 records where there are any, the central directory and
the index, and then only the byte range of each record.

Packages lie in a folder that all executors reach; pyarrow opens it, so local
and network mounts, HDFS and object stores work alike.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Stage, broadcast_small

# Record profile and signatures of the ZIP format.
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


def index_key(url: str | None) -> str:
    """The URL as one word of an index line: blanks, braces and all else outside ASCII percent-encoded."""
    return quote(url or "-", safe="!#$%&'()*+,/:;=?@[]~", errors="surrogatepass")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, payload: bytes, refers_to: str | None,
           ) -> bytes:
    """One WARC record.  A revisit has the HTTP head only; its Content-Length tells the full payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    if uri is not None:
        fields.insert(2, ("WARC-Target-URI", " ".join(uri.split())))
    if kind == "revisit":
        fields += [("WARC-Profile", _SAME_PAYLOAD), ("WARC-Refers-To", f"<{refers_to}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    store, root = open_store(folder)
    stream = package = member = None
    path, index, offset = "", [], 0

    def close() -> pa.RecordBatch:
        member.close()
        package.writestr("indexes/index.cdxj", "".join(index))
        package.writestr("datapackage.json", json.dumps(
            {"profile": "data-package", "wacz_version": "1.1.1",
             "resources": [{"name": "data.warc.gz", "path": "archive/data.warc.gz", "bytes": offset}]}))
        package.close()
        stream.close()
        return pa.record_batch([pa.array([path]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            page, url, html, first, kind = (columns[c][i].as_py() for c in ("page_id", "url", "payload", "first", "kind"))
            if stream is None:
                name = f"pages-{uuid.uuid4().hex}.wacz"
                path, index, offset = f"{folder}/{name}", [], 0
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(f"{root}/{name}")
                package = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                member = package.open("archive/data.warc.gz", "w", force_zip64=True)
            payload = html or b""
            digest = digest32(payload)
            pack = zlib.compressobj(4, zlib.DEFLATED, 31)
            data = pack.compress(record(kind, f"urn:page:{page}", url, date, digest, payload, f"urn:page:{first}"))
            data += pack.flush()
            member.write(data)
            index.append(index_key(url) + " " + json.dumps(
                {"offset": offset, "length": len(data), "digest": f"sha1:{digest}", "filename": "data.warc.gz"}) + "\n")
            offset += len(data)
            if offset >= most_bytes:
                yield close()
                stream = None
    if stream is not None:
        yield close()


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   most_bytes: int = 64_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """Write a WARC record per row of ``pages(page_id, url, html)``; returns path and records of each package.

    The payload is the html in UTF-8 (null: empty).  Of records whose payloads
    are equal and hold at least ``least_bytes`` bytes the one with the smallest
    page_id is a response and the others revisit it; all other records are
    responses.  Rows that share the smallest page_id are all responses, and so
    are equal payloads if all their page_ids are null; other rows without an id
    revisit.  A task that is run again writes packages of other names, and only
    those of the successful run are returned.  Extra columns are ignored.
    """
    stage = Stage(pages.sparkSession, "packages")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.col("html").cast("string").cast("binary").alias("payload"))
    payload = F.coalesce("payload", F.lit(b""))
    keyed = src.withColumns({"sha": F.sha1(payload), "bytes": F.length(payload)})
    shared = stage.put(keyed.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes")
                       .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
                       "shared")
    typed = (keyed.join(broadcast_small(shared, broadcast_rows), ["sha", "bytes"], "left")
             .withColumn("kind", F.when(F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")), "response")
                         .otherwise("revisit")))
    written = typed.select("page_id", "url", "payload", "first", "kind").mapInArrow(
        partial(_write, folder=folder, date=date, most_bytes=most_bytes), "path string, records long")
    return stage.put(written, "written")


def _at(file, start: int, size: int) -> bytes:
    data = file.read_at(size, start)
    if len(data) != size:
        raise ValueError(f"package ends early: {len(data)} of {size} bytes at {start}")
    return data


def central_directory(file) -> list[tuple[str, int, int, int, int]]:
    """(name, method, stored size, full size, place of the local header) of every member of a ZIP file."""
    total = file.size()
    tail_size = min(total, 22 + 65_535)
    tail = _at(file, total - tail_size, tail_size)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end record: not a ZIP file")
    count, size, start = struct.unpack("<HII", tail[at + 10:at + 20])
    place = total - tail_size + at
    if (count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF) and place >= 20:
        locator = _at(file, place - 20, 20)
        if locator[:4] == _LOCATOR64:
            end64 = _at(file, struct.unpack("<Q", locator[8:16])[0], 56)
            if end64[:4] != _END64:
                raise ValueError("broken ZIP64 end record")
            count, size, start = struct.unpack("<QQQ", end64[32:56])
    data, pos, out = _at(file, start, size), 0, []
    for _ in range(count):
        if data[pos:pos + 4] != _ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", data[pos + 8:pos + 12])
        packed, full, n_name, n_extra, n_note = struct.unpack("<IIHHH", data[pos + 20:pos + 34])
        local = struct.unpack("<I", data[pos + 42:pos + 46])[0]
        name = data[pos + 46:pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[pos + 46 + n_name:pos + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, length = struct.unpack("<HH", extra[:4])
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = list(struct.unpack(f"<{length // 8}Q", extra[4:4 + length // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + length:]
        out.append((name, method, packed, full, local))
        pos += 46 + n_name + n_extra + n_note
    return out


def data_start(file, local: int) -> int:
    """Where a member's bytes begin."""
    head = _at(file, local, 30)
    if head[:4] != _LOCAL:
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return local + 30 + n_name + n_extra


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of all records, from each package's directory and indexes."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, name = open_store(path)
            with store.open_input_file(name) as file:
                members = central_directory(file)
                starts = {}
                for member, method, packed, _, local in members:
                    if member.startswith("archive/"):
                        if method:
                            raise ValueError(f"{path}: {member} is not stored, so its records have no byte ranges")
                        starts[member.removeprefix("archive/")] = data_start(file, local)
                for member, method, packed, _, local in members:
                    if not member.startswith("indexes/"):
                        continue
                    data = _at(file, data_start(file, local), packed)
                    text = zlib.decompress(data, -15) if method == 8 else data
                    # keys hold no blank, so the first one before a brace begins the JSON
                    entries = [json.loads(line[line.index(b" {"):]) for line in text.split(b"\n") if b" {" in line]
                    if entries:
                        yield pa.record_batch(
                            [pa.array([path] * len(entries)),
                             pa.array([starts[e["filename"]] + int(e["offset"]) for e in entries], pa.int64()),
                             pa.array([int(e["length"]) for e in entries], pa.int64())],
                            names=["path", "start", "length"])


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one gzipped or plain record."""
    raw = zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


_RECORD = ("record_type string, record_id string, target_uri string, warc_date string, refers_to string, "
           "payload_bytes long, payload_digest string")


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    file, path = None, None
    for batch in batches:
        rows, size = [], 0
        for at, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
            if at != path:
                if file is not None:
                    file.close()
                store, name = open_store(at)
                file, path = store.open_input_file(name), at
            fields, block = parse_record(_at(file, start, length))
            head, _, payload = block.partition(b"\r\n\r\n")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            kind = fields.get("warc-type")
            if kind == "revisit":
                sizes = [line.split(b":")[1] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length")]
                n = int(sizes[0]) if sizes else None
            else:
                n = len(payload)
                if digest32(payload) != digest:
                    raise ValueError(f"{at}: payload at {start} does not have the digest {digest}")
            rows.append((kind, fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri"),
                         fields.get("warc-date"), (fields.get("warc-refers-to") or "").strip("<>") or None, n, digest,
                         *([payload if kind != "revisit" else None] if with_payload else [])))
            size += len(payload)
            if size >= 16_000_000:
                yield _batch(rows, with_payload)
                rows, size = [], 0
        if rows:
            yield _batch(rows, with_payload)
    if file is not None:
        file.close()


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in _RECORD.split(", ")] + ["payload"] * with_payload
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def read_packages(spark: SparkSession, packages: DataFrame, with_payload: bool = True,
                  task_bytes: int = 16_000_000) -> DataFrame:
    """Records of the packages named in ``packages(path)``: one row per index entry.

    Columns: record_type, record_id, target_uri, warc_date, refers_to,
    payload_bytes, payload_digest (bare base32 SHA-1, both of the full payload)
    and, unless ``with_payload`` is false, payload (null for a revisit).  A
    response whose payload does not have its digest, a deflated archive member
    and a damaged directory raise an error; a package without an index has no
    rows.  Null paths are left out.  A task reads about ``task_bytes``.
    """
    where = Stage(spark, "ranges").put(
        packages.where("path is not null").select("path").repartition("path").mapInArrow(
            _locate, "path string, start long, length long"), "ranges")
    total = where.agg(F.sum("length")).head()[0] or 0
    ordered = where.repartitionByRange(total // task_bytes + 1, "path", "start").sortWithinPartitions("path", "start")
    return ordered.mapInArrow(partial(_read, with_payload=with_payload),
                              _RECORD + (", payload binary" if with_payload else ""))
