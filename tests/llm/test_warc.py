"""WARC archives: round trips, the layout of the files, and the query against its SQL."""

import glob
import gzip
import hashlib
import json
import zlib

import duckdb
import pytest

from spendlake.llm import warc
from spendlake.llm.queries import ORACLE, op13_warc
from spendlake.session import shared_path


def brute(rows, min_bytes=1000):
    tops = {}
    for i, _, h in rows:
        if i is not None:
            tops[h or ""] = max(i, tops.get(h or "", i))
    out = []
    for i, u, h in rows:
        raw = (h or "").encode()
        top = tops.get(h or "")
        to = top if len(raw) >= min_bytes and top != i else None
        out.append((i, u, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to, raw if to is None else None))
    return sorted(out, key=str)


def check(spark, rows, **more):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, refers_to int")
    archives = warc.archive(spark, pages.repartition(3), shared_path(spark, "warc"), **more)
    got = warc.read(archives, split_records=7)
    cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    rows_back = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.select(*cols).collect()]
    assert sorted(rows_back, key=str) == brute(rows)
    return archives


ROWS = [
    *[(i, f"http://a/{i}", f"page {i % 5} é " * 150) for i in range(40)],
    *[(i, None, "same short page") for i in range(50, 60)],
    (60, "http://b/\r\nWARC-Type: x%0A", "\r\n\r\nWARC/1.1\r\n" * 90),
    (61, "", None),
    (62, "u", ""),
    (None, "u", "page 1 é " * 150),
    (None, "u", "q" * 2000),
    (None, "u", "q" * 2000),
    (39, "again", "page 4 é " * 150),
    (63, "big", "long " * 700_000),
]


def test_round_trip(spark):
    archives = check(spark, ROWS, archive_bytes=20_000)
    assert archives.count() > 3


def test_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 5)
    check(spark, ROWS)


def test_layout(spark):
    path = shared_path(spark, "warc")
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    archives = warc.archive(spark, pages, path)
    for f in glob.glob(f"{path}/monolithic/*.gz"):
        d = zlib.decompressobj(31)
        d.decompress(open(f, "rb").read())
        assert d.eof and not d.unused_data  # a single member
    n = 0
    for r in archives.collect():
        raw = open(r.path, "rb").read()
        entries = [json.loads(x) for x in open(r.index_path)]
        assert len(entries) == r.records and [e["offset"] for e in entries][0] == 0
        assert sum(e["length"] for e in entries) == len(raw)
        for e in entries:
            member = gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
            assert f"WARC-Record-ID: {e['id']}\r\n".encode() in member and f"WARC-Type: {e['type']}\r\n".encode() in member
        n += r.records
    assert n == len(ROWS)
    # what is normal already stays as it is, record for record
    again = warc.normalise(archives, shared_path(spark, "again"))
    assert sorted(map(str, warc.read(again).collect())) == sorted(map(str, warc.read(archives).collect()))


def test_damaged_archives(spark):
    path = shared_path(spark, "warc")
    whole = warc.write_monolithic(warc.revisits(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)).coalesce(1), path)
    (file,) = [r.path for r in whole.collect()]
    raw = open(file, "rb").read()
    text = gzip.decompress(raw)
    for i, bad in enumerate((raw[:-200], gzip.compress(text[:-3]), gzip.compress(b"no archive\r\n\r\n"))):
        open(f"{path}/bad{i}", "wb").write(bad)
        with pytest.raises(Exception, match=f"bad{i}"):
            warc.normalise(spark.createDataFrame([(f"{path}/bad{i}",)], "path string"), f"{path}/out").collect()
    # a payload changed behind its digest
    open(f"{path}/changed", "wb").write(gzip.compress(text.replace(b"same short page", b"sane short page")))
    out = warc.normalise(spark.createDataFrame([(f"{path}/changed",)], "path string"), f"{path}/out")
    with pytest.raises(Exception, match="not the one of its digest"):
        warc.read(out).collect()


def test_empty_table(spark):
    check(spark, [])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    got = op13_warc(spark, sf)
    want = con.execute(ORACLE["op13_warc"])
    order = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(order)
    assert sorted(map(str, map(tuple, got.select(*order).collect()))) == sorted(map(str, want.fetchall()))
