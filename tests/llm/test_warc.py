import hashlib
import zlib

import pytest

from driver import check
from ledgerline.llm import queries, warc
from ledgerline.llm.common import Tables

SCHEMA = "page_id bigint, url string, html string, digest string, shard int"


@pytest.mark.parametrize("url,key", [
    ("http://www.Example.com:80/a//b?x=1#top", "com,example)/a/b?x=1"), ("https://m.example.com:8080", "com,example,m:8080)/"), (None, ")/"),
    ("example.org/p", "org,example)/p"), ("http://[bad/x", ")http://[bad/x"), ("", ")/"),
])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_record_round_trip():
    for payload in (b"", b"\r\n\r\n", "é\n".encode() * 500):
        headers, block = warc.parse(warc.record(7, "http://a b\r\nX: y/é", payload, hashlib.sha256(payload).hexdigest(), "response", None))
        assert warc.answer(block) == (len(payload), payload) and headers["WARC-Record-ID"] == "<urn:page:7>" and headers["WARC-Target-URI"] == "http://a%20b%0D%0AX:%20y/é"


def test_archives_hold_what_the_format_asks_for(spark):
    rows = [(i, f"http://a.b/{i}", "same payload " * 20 if i < 3 else f"own {i}", "d", 1) for i in range(6)]
    tables = Tables(spark, "test-warc")
    captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), tables).orderBy("start").collect()
    with open(f"{tables.path('archives')}/{captures[0].file}", "rb") as f:
        data, members = f.read(), []
    while data:
        one = zlib.decompressobj(31)
        members.append(one.decompress(data))
        data = one.unused_data
    heads = [m.split(b"\r\n\r\n")[0].decode().split("\r\n") for m in members]
    kinds = [next(h.split(": ")[1] for h in head if h.startswith("WARC-Type")) for head in heads]
    assert kinds[0] == "warcinfo" and sorted(kinds[1:]) == ["response"] * 4 + ["revisit"] * 2
    for head, member in zip(heads, members):
        names = {h.split(":")[0] for h in head[1:]}
        assert head[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "Content-Length"} <= names
        length = int(next(h.split(": ")[1] for h in head if h.startswith("Content-Length")))
        assert member.endswith(b"\r\n\r\n") and len(member) == member.index(b"\r\n\r\n") + 4 + length + 4
    assert all(m.split(b"\r\n\r\n", 1)[1].startswith(b"HTTP/1.1 200 OK\r\n") for m in members[1:])


def test_equals_sql(spark):
    frame = queries.QUERIES["op2_warc_index"](spark, "/root/testdata/sf0.01")
    got = check.rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    done = check.duck("/root/testdata/sf0.01").execute(queries.ORACLES["op2_warc_index"])
    assert got == check.rows_of([d[0] for d in done.description], done.fetchall()) and len(got[1]) == 250


def test_odd_rows(spark):
    long = "x" * 200000
    rows = [(5, "http://a.b/1", long, "d", 1), (3, "http://a.b/1", long, "d", 1), (9, None, long, None, None), (None, "http://a.b/1", long, "d", 1), (4, "u", None, "d", 1), (6, "u", "", "d", 1),
            (7, "u", "z" * 99, "d", 1), (8, "u", "z" * 99, "d", 1), (10, "u", "y" * 100, "d", 1), (10, "u", "y" * 100, "d", 1), (11, "u", "y" * 100, "d", 1), (None, "v", "w" * 100, "d", 1), (None, "v", "w" * 100, "d", 1)]
    got = sorted((repr(r.page_id), r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.archive_and_read(spark.createDataFrame(rows, SCHEMA), block=2).collect())
    assert got == sorted([("5", 200000, "revisit", 3), ("3", 200000, "response", 0), ("9", 200000, "revisit", 3), ("None", 200000, "revisit", 3), ("4", 0, "response", 0), ("6", 0, "response", 0), ("7", 99, "response", 0),
                          ("8", 99, "response", 0), ("10", 100, "response", 0), ("10", 100, "response", 0), ("11", 100, "revisit", 10), ("None", 100, "response", 0), ("None", 100, "response", 0)])
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lookup_by_key_over_blocks_and_shards(spark):
    rows = [(i, f"http://h{i % 3}.example.com/p{0 if i < 60 else i}", f"text {i}", "d", 1) for i in range(200)]
    tables = Tables(spark, "test-warc")
    captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), tables)
    shards = warc.build_index(captures, tables, block=4)
    for key in ("com,example,h1)/p0", "com,example,h2)/p101", "com,example,h9)/none"):
        asked = spark.createDataFrame([(key,), (key,)], "url_key string")
        got = warc.read_records(warc.lookup(asked, shards, tables.path("index")), tables.path("archives")).collect()
        want = {(i, h.encode()) for i, u, h, *_ in rows if warc.url_key(u) == key}
        assert {(r.page_id, bytes(r.payload)) for r in got} == want and len(got) == len(want)
