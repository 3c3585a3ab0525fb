import gzip
import hashlib
import io
import zipfile

import pytest

from tidemill.llm import warczip


def brute(rows):
    body = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, b in body:
        if b not in first or first[b] is None or (p is not None and p < first[b]):
            first[b] = p
    out = []
    for p, b in body:
        again = len(b) >= 100 and p != first[b]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int").repartition(2)
    num = lambda x: None if x is None else int(x)
    return sorted(((num(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in warczip.round_trip(df).collect()), key=repr)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warczip, "PACKAGE_BYTES", 600)
    monkeypatch.setattr(warczip, "READ_RECORDS", 3)
    long = "é" * 80
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * i) for i in range(30)]
    rows += [(50, None, long), (40, "http://a\r\nb: c", long), (60, "u", long), (61, "u", None), (62, "u", ""), (63, "u", "short"), (64, "u", "short"), (65, "u", "x\r\n\r\ny" * 40), (40, "again", long), (None, "u", long), (None, "u", "z" * 200)]
    assert run(spark, rows) == brute(rows)
    urls = spark.createDataFrame([(1, "-", "x"), (2, " http://a/b ", "y"), (3, None, "z"), (4, "", "w")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url) for r in warczip.round_trip(urls).collect()) == [("1", "-"), ("2", " http://a/b "), ("3", None), ("4", "")]
    dashes = spark.createDataFrame([("-", "u", "x"), ("a/b c", "u", "y")], "page_id string, url string, html string")
    assert sorted(r.page_id for r in warczip.round_trip(dashes).collect()) == ["-", "a/b c"]
    payloads = {r.page_id: r.payload for r in warczip.round_trip(spark.createDataFrame(rows[-5:-3], "page_id long, url string, html string")).collect()}
    assert payloads["65" if "65" in payloads else "64"] is not None


def test_empty(spark):
    assert run(spark, []) == []


def test_reads_zip_and_zip64():
    for wide in (False, True):
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
            with z.open("a.bin", "w", force_zip64=wide) as f:
                f.write(b"alpha")
            z.writestr("b/é.txt", "beta", zipfile.ZIP_DEFLATED)
            z.comment = b"note"
        data = sink.getvalue()
        found = warczip.members(lambda at, n, data=data: data[at : at + n], len(data))
        at, size, method = found["a.bin"]
        assert data[at : at + size] == b"alpha" and method == 0 and found["b/é.txt"][2] == 8


def test_reads_zip64_end_record():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(f"{i}", b"")
        z.writestr("last", b"omega")
    data = sink.getvalue()
    found = warczip.members(lambda at, n: data[at : at + n], len(data))
    at, size, _ = found["last"]
    assert len(found) == 66_001 and data[at : at + size] == b"omega"


def test_packages_of_others(spark, tmp_path):
    """Several archives, plain and packed records, CDXJ and CDX indexes, packed and two-level, and an archive without one."""
    make = lambda i, packed: (lambda r: gzip.compress(r) if packed else r)(warczip.record(str(i), f"http://h/{i}", "response", hashlib.sha256(b"p%d" % i).hexdigest(), 2, "", b"p%d" % i))
    info = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    parts = {"archive/a.warc.gz": [info] + [make(i, True) for i in range(4)], "archive/b.warc.gz": [make(i, True) for i in range(4, 9)], "archive/c.warc": [make(i, False) for i in range(9, 12)], "archive/d.warc.gz": [make(i, True) for i in range(12, 15)]}
    place = lambda name: [(sum(map(len, parts[name][:k])), len(r)) for k, r in enumerate(parts[name])]
    cdxj = "".join(f'h)/{k} 2020 {{"offset": "{a}", "length": "{n}", "filename": "a.warc.gz"}}\n' for k, (a, n) in enumerate(place("archive/a.warc.gz")))
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"h)/{k} 2020 u text/html 200 - - - {n} {a} b.warc.gz\n" for k, (a, n) in enumerate(place("archive/b.warc.gz")))
    half = cdxj.splitlines(True)
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as z:
        for name, records in parts.items():
            z.writestr(name, b"".join(records))
        z.writestr("indexes/index.idx", '!meta 0 {"format": "cdxj-gzip-1.0"}\n')
        z.writestr("indexes/index.cdx.gz", gzip.compress("".join(half[:2]).encode()) + gzip.compress("".join(half[2:]).encode()))
        z.writestr("indexes/other.cdx", cdx, zipfile.ZIP_DEFLATED)
    got = warczip.read(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "uri string")).collect()
    assert sorted((int(r.page_id), bytes(r.payload)) for r in got) == [(i, b"p%d" % i) for i in range(15)]
    with zipfile.ZipFile(tmp_path / "y.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", b"x" * 100)
    with open(tmp_path / "y.wacz", "rb") as f, pytest.raises(ValueError, match="compressed"):
        warczip.ranges(f, (tmp_path / "y.wacz").stat().st_size)
