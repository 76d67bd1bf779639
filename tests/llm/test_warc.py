"""WARC archives: exact round trips with payloads that hold records, revisits, split files, and captures from linked records."""

import base64
import hashlib
import uuid

import pytest

from takeoff.llm import warc

EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:fake>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"
ROWS = [(1, "http://a.b/x y\r\nZ: 1", "<p>é</p>"), (2, None, None), (3, "http://a.b", ""), (4, "http://c/d?q#f", EVIL), (5, "http://c/e", EVIL), (5, "http://c/e", EVIL),
        (None, "http://n", "<p>é</p>"), (None, None, None), (6, "u", "WARC/1.1\r\n"), (7, "u", "\r\n\r\n"), (8, "u", "y\r\n\r\nWARC/1." * 3), (9, "u", "é" * 3000 + "\nWARC/1.0")]


def expected(rows, minimum):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, []
    for i in order:
        page, data = rows[i][0], (rows[i][2] or "").encode()
        again = len(data) >= minimum and data in first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(map(repr, out))


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("minimum", [0, 3])
def test_round_trip(spark, tmp_path, compression, minimum):
    df = spark.createDataFrame([(*r, "c") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write(df, path, minimum, compression)
    try:
        for size in ("128m", "700"):  # small splits cut records of uncompressed files
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(repr(tuple(r)) for r in warc.page_captures(spark, path).collect()) == expected(ROWS, minimum)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    texts = {(r["type"], bytes(r["payload"])) for r in warc.records(spark, path).where("type = 'response'").collect()}
    assert {("response", (t or "").encode()) for _, _, t in ROWS} == texts


def test_an_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/a")
    assert warc.page_captures(spark, f"{tmp_path}/a").count() == 0


def test_captures_over_other_records(spark, tmp_path):
    """Bytes that are no UTF-8, a record without a length, links in both directions and over another record, and records without a response."""
    def record(kind, rid, block, *more, length=True):
        fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), *more, *([("content-length", str(len(block)))] if length else [])]
        return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"

    to = "WARC-Concurrent-To"
    data = b"".join([
        record("warcinfo", "<i>", b"software: x\r\n"), record("response", "<r1>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\xfe\x00", ("Content-Type", "application/http"), (to, "<q1>")),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n"), record("metadata", "<m1>", b"a: 1", (to, "<q1>")), record("metadata", "<m2>", b"b: 2", ("warc-concurrent-to", "<r2>")),
        record("resource", "<r2>", b"whole", ("Content-Type", "text/plain")), record("request", "<q9>", b"lost", (to, "<gone>")), b"junk outside\r\n\r\n", record("response", "<r3>", b"no length", length=False)])
    (tmp_path / "x.warc").write_bytes(data)
    rows = warc.records(spark, str(tmp_path / "x.warc"))
    got = {r["capture_id"]: r for r in warc.captures(rows).collect()}
    names = lambda r, c: sorted(x["record_id"] for x in r[c])
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<i>", "<q9>"}
    assert bytes(got["<r1>"]["head"]["payload"]) == b"\xff\xfe\x00" and names(got["<r1>"], "requests") == ["<q1>"] and names(got["<r1>"], "metadata") == ["<m1>"]
    assert bytes(got["<r2>"]["head"]["payload"]) == b"whole" and names(got["<r2>"], "metadata") == ["<m2>"] and names(got["<i>"], "others") == ["<i>"]
    assert got["<q9>"]["head"] is None and names(got["<q9>"], "requests") == ["<q9>"]
