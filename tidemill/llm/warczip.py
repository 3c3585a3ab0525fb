"""WARC archives packed in ZIP: written by tasks, read back by ranges without unpacking.

A package is one ZIP whose archive members are stored, not compressed: WARC files under ``archive/``, plain or with
one gzip member per record, and indexes of them under ``indexes/``.  Packages are written with
``archive/data.warc.gz`` and ``indexes/index.cdxj``.  The reader finds the central directory from the end of the file
(through the ZIP64 locator where sizes or counts pass 32 or 16 bits), reads the index members - CDXJ or CDX lines, plain
or compressed, the compressed blocks of a two-level index among them - and then only the ranges of the records it wants;
ranges that lie close together are read at once.  An archive member that no index names is walked record by record.

Files are opened through pyarrow's file systems, by URI, so the shared folder may be local or remote.  A task
writes packages under a name of its own and reports them in its result rows; packages of failed attempts are
never in that result and so never read.

Nulls, ties and repeats: a null payload is empty, a null url or id stays null, and urls keep outer blanks.  Among
records with equal payloads of at least ``least`` bytes the smallest id is the response and the others revisit it; rows
that repeat the smallest id are responses too; a null id sorts last.  An empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.scratch import materialise, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed after so many bytes.
PACKAGE_BYTES = 256 << 20
#: Records and bytes of one row of work for the reader, and bytes that a task of the reader gets.
READ_RECORDS, READ_BYTES, TASK_BYTES = 256, 8 << 20, 16 << 20
#: Ranges with a smaller gap between them are read at once.
GAP = 1 << 16
#: Most repeated payloads whose digests are sent to every executor (under 100 bytes each).
SEND_ROWS = 100_000


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def record(page_id: str | None, url: str | None, kind: str, digest: str, size: int, refers_to: str, payload: bytes) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit keeps the response's head, with the full length, and no payload.

    Control characters of the url are percent-encoded, as a header line cannot hold them.  Without an id the record has
    a random name, without an url no target.
    """
    url = None if url is None else "".join(quote(c) if c < " " or c == "\x7f" else c for c in url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    name = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{quote(page_id, safe='')}"
    target = [] if url is None else [f"WARC-Target-URI: {url}"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *target, "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of one record (names in lower case), and under ``http`` and ``payload`` what its block holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP from its central directory: name to (offset of the data, size, method). ``read(at, n)`` reads a range."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        end64 = read(struct.unpack_from("<Q", tail, at - 12)[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, found, p = read(start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, p)
        name = directory[p + 46 : p + 46 + n_name].decode()
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:  # in the ZIP64 field, those numbers follow that did not fit, in this order
            kind, n = struct.unpack_from("<HH", directory, q)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", directory, q + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + n
        n_name2, n_extra2 = struct.unpack("<HH", read(local + 26, 4))
        found[name] = (local + 30 + n_name2 + n_extra2, packed, method)
        p = stop + n_note
    return found


def _packages(rows: Iterator[tuple[str, bytes]], folder: str) -> Iterator[tuple[str, int]]:
    """Write (url, record) rows to packages in ``folder``; yields (uri, records)."""
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    row = next(rows, None)
    while row:
        name = f"{uuid.uuid4().hex}.wacz"
        with fs.open_output_stream(f"{base}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
            index, at, head = [], 0, {"filename": DATA.rpartition("/")[2], "mime": "text/html", "status": "200"}
            with package.open(DATA, "w", force_zip64=True) as data:
                while row and at < PACKAGE_BYTES:
                    packed = gzip.compress(row[1], 1, mtime=0)
                    data.write(packed)
                    index.append(f"{quote(row[0] or '-')} 19700101000000 {json.dumps({'url': row[0], 'offset': at, 'length': len(packed)} | head)}\n")
                    at += len(packed)
                    row = next(rows, None)
            package.writestr(INDEX, "".join(index))
        yield f"{folder}/{name}", len(index)


def write(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages into ``folder``; returns uri and records of each package."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("body")).withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    again = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialise(again.select(F.col("digest").alias("_d"), "first"), "payloads")
    again = F.broadcast(again) if again.count() <= SEND_ROWS else again
    typed = rows.join(again, F.col("digest") == F.col("_d"), "left")
    revisit = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = typed.select(F.col("page_id").cast("string").alias("id"), "url", F.when(revisit, F.col("first").cast("string")).alias("refers_to"), "digest", "size", F.when(~revisit, F.col("body")).alias("body"))

    def run(batches):
        def records():
            for batch in batches:
                for r in range(len(batch)):
                    page, url, refers, digest, size, body = (c[r].as_py() for c in batch.columns)
                    yield url, record(page, url, "revisit" if refers is not None else "response", digest, size, refers or "", body or b"")

        for uri, n in _packages(records(), folder):
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [n]})

    return typed.mapInArrow(run, "uri string, records long")


def _unzipped(data: bytes) -> bytes:
    """``data`` with all its gzip members unpacked, if it is packed at all."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _index_lines(data: bytes) -> Iterator[tuple[str | None, int, int | None]]:
    """(file name, offset, length) of the lines of a CDXJ or CDX index; length is None where it isn't told."""
    order = {}
    for line in _unzipped(data).decode().splitlines():
        if line.lstrip().startswith("CDX "):
            order = {c: k for k, c in enumerate(line.split()[1:])}
            continue
        at = line.find("{")
        if at >= 0:
            fields = json.loads(line[at:])
            if "offset" in fields:
                length = fields.get("length")
                yield fields.get("filename"), int(fields["offset"]), None if length is None else int(length)
        elif {"V", "g"} <= order.keys():
            cells = line.split(" ")
            length = cells[order["S"]] if "S" in order else "-"
            yield cells[order["g"]], int(cells[order["V"]]), int(length) if length.isdigit() else None


def _walk(f: io.RawIOBase, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of the records of the archive member at ``start``, read once from front to end."""
    f.seek(start)
    if f.read(2) == b"\x1f\x8b":
        f.seek(start)
        left, at, begin, data = size, start, start, b""
        unpack = zlib.decompressobj(31)
        while True:
            if not data and left:
                data = f.read(min(1 << 20, left))
                left -= len(data)
            if not data:
                return
            unpack.decompress(data)
            at += len(data) - len(unpack.unused_data)
            data = unpack.unused_data if unpack.eof else b""
            if unpack.eof:
                yield begin, at - begin
                begin, unpack = at, zlib.decompressobj(31)
    at = start
    while at < start + size:
        f.seek(at)
        head = f.read(1 << 12)
        while b"\r\n\r\n" not in head:
            more = f.read(1 << 12)
            if not more:
                return
            head += more
        cut = head.index(b"\r\n\r\n")
        length = cut + 8 + int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head[:cut])[1])
        yield at, length
        at += length


def ranges(f, size: int, uri: str = "") -> list[tuple[int, int]]:
    """(offset, length) of every record of the package ``f``, by its indexes or, for archive members that they don't name, by a walk."""
    found = members(lambda at, n: (f.seek(at), f.read(n))[1], size)
    archives = {name: m for name, m in found.items() if re.search(r"(?i)\.warc(\.gz)?$", name)}
    if packed := [name for name, m in archives.items() if m[2]]:
        raise ValueError(f"{uri}: archive members are compressed: {packed}")
    short = {name.rpartition("/")[2]: name for name in archives}
    out: dict[str, dict[int, int | None]] = {name: {} for name in archives}
    for name, (at, n, method) in found.items():
        if name.startswith("indexes/") and re.search(r"(?i)\.(cdxj?)(\.gz)?$", name):
            f.seek(at)
            data = f.read(n)
            for file, offset, length in _index_lines(zlib.decompress(data, -15) if method == 8 else data):
                home = short.get((file or "").rpartition("/")[2]) or (next(iter(archives)) if file is None and len(archives) == 1 else None)
                if home:
                    out[home][offset] = length
    rows = []
    for name, (start, n, _) in archives.items():
        places = sorted(out[name])
        if not places:
            rows += _walk(f, start, n)
        rows += [(start + p, out[name][p] or until - p) for p, until in zip(places, [*places[1:], n])]
    return sorted(rows)


def _texts(parts: list[tuple[int, int]], f) -> Iterator[bytes]:
    """The bytes of each of ``parts`` (offset, length; sorted), read in runs with small gaps."""
    i = 0
    while i < len(parts):
        begin, end, j = parts[i][0], sum(parts[i]), i + 1
        while j < len(parts) and parts[j][0] - end <= GAP and sum(parts[j]) - begin <= READ_BYTES:
            end, j = max(end, sum(parts[j])), j + 1
        f.seek(begin)
        run = f.read(end - begin)
        yield from (run[a - begin : a - begin + n] for a, n in parts[i:j])
        i = j


def read(packages: DataFrame) -> DataFrame:
    """Every response and revisit of ``packages`` (uri): page_id, url, payload_bytes, payload_digest, record_type, refers_to (ids as strings) and payload (null in revisits).

    A record that was not named after a page keeps its own name as ``page_id``, but random ones have none; a digest
    that the archive lacks or gives in another form is computed.
    """

    def spans(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    parts = ranges(f, f.size(), uri)
                i = 0
                while i < len(parts):
                    j, size = i, 0
                    while j < len(parts) and j - i < READ_RECORDS and (j == i or size + parts[j][1] <= READ_BYTES):
                        size, j = size + parts[j][1], j + 1
                    yield pa.RecordBatch.from_pydict({"uri": [uri], "at": [[a for a, _ in parts[i:j]]], "length": [[n for _, n in parts[i:j]]], "bytes": [size]}, schema=pa.schema([("uri", pa.string()), ("at", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("bytes", pa.int64())]))
                    i = j

    def records(batches):
        for batch in batches:
            for uri, at, length in zip(*(batch.column(c).to_pylist() for c in ("uri", "at", "length"))):
                fs, path = open_fs(uri)
                out = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
                with fs.open_input_file(path) as f:
                    for a, data in zip(at, _texts(list(zip(at, length)), f)):
                        r = parse_record(_unzipped(data))
                        if r["warc-type"] not in ("response", "revisit"):
                            continue
                        full = r["warc-type"] == "response"
                        kind, _, digest = r.get("warc-payload-digest", "").strip().partition(":")
                        if full and (own := hashlib.sha256(r["payload"]).hexdigest()) != digest:
                            if kind == "sha256" and len(digest) == 64:
                                raise ValueError(f"{uri} at {a}: payload digest differs")
                            digest = own
                        name = lambda n: unquote(n[len("urn:page:") :]) if n.startswith("urn:page:") else None if n.startswith("urn:uuid:") else n
                        out["page_id"].append(name(r["warc-record-id"].strip().strip("<>")))
                        out["url"].append(r.get("warc-target-uri"))
                        out["payload_bytes"].append(len(r["payload"]) if full else int(r["http"].get("content-length", 0)))
                        out["payload_digest"].append(digest)
                        out["record_type"].append(r["warc-type"])
                        out["refers_to"].append(None if full or "warc-refers-to" not in r else name(r["warc-refers-to"].strip().strip("<>")))
                        out["payload"].append(r["payload"] if full else None)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64() if k == "payload_bytes" else pa.binary() if k == "payload" else pa.string()) for k in out]))

    work = materialise(packages.select("uri").mapInArrow(spans, "uri string, at array<long>, length array<long>, bytes long"), "ranges")
    n, size = work.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return work.repartition(max(1, min(n, -(-size // TASK_BYTES)))).mapInArrow(records, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read every record back (see :func:`read`)."""
    packages = materialise(write(pages, new_path(pages.sparkSession, "warc"), least), "packages")
    return read(packages)
