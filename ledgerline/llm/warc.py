"""WARC archives with a two-level capture index.

Archives: every task writes its records, one gzip member each, to a file of its
own in the shared folder. The files of tasks that were repeated are never named
by the capture table, which is written by Spark and lists the finished ones.

Index: capture lines are sorted by reversed-host URL key and written as shards
of compressed blocks. The sparse directory has one entry per block, its first
key and place; it lies at the end of its shard, and the shard table holds each
shard's first and last key. So a lookup goes from the shard table (one row per
shard) by binary search to the shard, reads the directory there, by binary
search to the blocks, and then by range reads to lines and records.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import STEP, Tables, arrow_schema, settings

#: Capture lines in a block.
BLOCK = 1000
#: Payloads below this many bytes are always stored.
LEAST_SHARED = 100


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: com,example)/a?b=1. Scheme, fragment, case of the host and a leading www. do not count."""
    text = (url or "").strip()
    if "://" not in text:
        text = f"//{text}"
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return f"){text}"
    path = re.sub(r"/{2,}", "/", parts.path or "/")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path
    return key + (f"?{parts.query}" if parts.query else "")


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else f"/{uri}")


#: Pages carry no time of capture; records state this one.
CAPTURED = "1970-01-01T00:00:00Z"


def _member(headers: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *headers, f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def information(file: str, captured: str = CAPTURED) -> bytes:
    """The record that begins an archive, as one gzip member."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, file)
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {captured}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"], b"software: ledgerline\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None, captured: str = CAPTURED) -> bytes:
    """A record as one gzip member: the head of an HTTP answer, and in a response the payload after it."""
    # One header per line, whatever the address holds.
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    headers = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {captured}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member([*headers, "Content-Type: application/http; msgtype=response"], head + (payload if kind == "response" else b""))


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    data = zlib.decompress(member, 31)
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, data[cut + 4 : cut + 4 + int(headers["Content-Length"])]


def answer(block: bytes) -> tuple[int, bytes]:
    """The length that an HTTP answer states, and what follows its head."""
    head, _, body = block.partition(b"\r\n\r\n")
    return int(re.search(rb"(?im)^content-length: (\d+)", head)[1]), body


CAPTURES = "url_key string, page_id bigint, file string, start bigint, size bigint, digest string, kind string"


def write_archives(pages: DataFrame, tables: Tables, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row of `pages`; the captures, one row per record."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("shared", F.octet_length("html") >= LEAST_SHARED)
    firsts = rows.where("shared").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    firsts = tables.save("firsts", firsts.select("digest", "first"))
    # Payloads that several pages share: Spark sends them to every task if they are few, else splits large groups.
    known = rows.join(firsts, "digest", "left")
    root, fields = tables.path("archives"), arrow_schema(CAPTURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                payload = row["html"].encode()
                first, page = row["first"], row["page_id"]
                kind = "revisit" if row["shared"] and first is not None and first != page else "response"
                member = record(page, row["url"], payload, row["digest"], kind, first)
                if out is None:
                    out, first_record = fs.open_output_stream(f"{base}/{name}", compression=None), information(name)
                    out.write(first_record)
                    at = len(first_record)
                out.write(member)
                made.append((url_key(row["url"]), page, name, at, len(member), row["digest"], kind))
                at += len(member)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*made), fields)], schema=fields)
        if out:
            out.close()

    written = known.select("page_id", "url", "html", "digest", "shared", "first").mapInArrow(run, CAPTURES)
    return tables.save("captures", written)


SHARDS = "shard string, low_key string, low_id bigint, high_key string, high_id bigint, directory_at bigint, directory_size bigint, blocks bigint, captures bigint"


def _line(row: dict) -> str:
    return json.dumps([row[c] for c in ("url_key", "page_id", "file", "start", "size", "digest", "kind")])


def build_index(captures: DataFrame, tables: Tables, block: int = BLOCK) -> DataFrame:
    """Sorts the captures into shards of compressed blocks; the shard table.

    Equal keys are parted by page and file, so one much-captured address spreads
    over blocks and shards like any other run of lines.
    """
    ordered = captures.repartitionByRange("url_key", F.coalesce("page_id", F.lit(-(1 << 63))), "file", "start").sortWithinPartitions("url_key", F.coalesce("page_id", F.lit(-(1 << 63))), "file", "start")
    root, fields = tables.path("index"), arrow_schema(SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        name, out, at, held, directory, total, ends = f"{uuid.uuid4().hex}.idx.gz", None, 0, [], [], 0, []

        def flush() -> None:
            nonlocal out, at, held, total
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            data = gzip.compress("\n".join(map(_line, held)).encode(), 6, mtime=0)
            out.write(data)
            directory.append([held[0]["url_key"], held[-1]["url_key"], at, len(data)])
            at, total, held = at + len(data), total + len(held), []

        for batch in batches:
            for row in batch.to_pylist():
                ends = [ends[0] if ends else (row["url_key"], row["page_id"]), (row["url_key"], row["page_id"])]
                held.append(row)
                if len(held) == block:
                    flush()
        if held:
            flush()
        if out:
            data = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            out.write(data)
            out.close()
            values = [name, *ends[0], *ends[1], at, len(data), len(directory), total]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=fields)

    return tables.save("shards", ordered.mapInArrow(run, SHARDS))


def lookup(keys: DataFrame, shards: DataFrame, root: str) -> DataFrame:
    """The captures of each distinct url_key in `keys`.

    The shard table has one row per index partition and is all that every task
    gets; directories and blocks are read where they are needed.
    """
    table = sorted((tuple(r) for r in shards.collect()), key=lambda r: (r[1], r[3]))
    lows, highs = [r[1] for r in table], [r[3] for r in table]
    spark = keys.sparkSession
    held = spark.sparkContext.broadcast((table, lows, highs))
    asked_fields, fields = arrow_schema("shard string, url_key string"), arrow_schema(CAPTURES)

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, low, high = held.value
        for batch in batches:
            out = [(rows[i][0], key) for key in batch.column(0).to_pylist() for i in range(bisect.bisect_left(high, key), bisect.bisect_right(low, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(2)], schema=asked_fields)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        places = {r[0]: (r[5], r[6]) for r in held.value[0]}
        shard = file = directory = firsts = lasts = None
        cached, lines = None, []
        for batch in batches:
            found = []
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != shard:
                    shard, file, cached = name, fs.open_input_file(f"{base}/{name}"), None
                    at, size = places[name]
                    directory = json.loads(gzip.decompress(file.read_at(size, at)))
                    firsts, lasts = [d[0] for d in directory], [d[1] for d in directory]
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    if cached != i:
                        cached, lines = i, [json.loads(x) for x in gzip.decompress(file.read_at(directory[i][3], directory[i][2])).split(b"\n")]
                        line_keys = [x[0] for x in lines]
                    found += lines[bisect.bisect_left(line_keys, key) : bisect.bisect_right(line_keys, key)]
                    if len(found) >= 2000:
                        yield _rows(found, fields)
                        found = []
            if found:
                yield _rows(found, fields)

    asked = keys.select("url_key").where("url_key is not null").distinct().mapInArrow(to_shards, "shard string, url_key string")
    # Questions to one shard follow one another in key order, so each of its blocks is read once per task.
    asked = asked.repartitionByRange("shard", "url_key").sortWithinPartitions("shard", "url_key")
    return asked.mapInArrow(search, CAPTURES)


def _rows(found: list, fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*found), fields)], schema=fields)


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_records(captures: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records of `captures` by range reads; a response's digest and length are taken from its payload.

    A revisit has no payload of its own: digest and length are those it was
    written with, `refers_to` names the response.
    """
    fields = arrow_schema(RECORDS)

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text and text != "None" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name = file = None
        for batch in batches:
            out = []
            for want, start, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if want != name:
                    name, file = want, fs.open_input_file(f"{base}/{want}")
                headers, block = parse(file.read_at(size, start))
                kind = headers["WARC-Type"]
                length, payload = answer(block)
                if kind == "response":
                    length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if headers["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"{want} at {start}: payload and digest differ")
                else:
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                refers = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                out.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], length, digest, kind, refers, payload if payloads and kind == "response" else None))
            if out:
                yield _rows(out, fields)

    # Reads of one archive follow one another from its beginning to its end.
    places = captures.select("file", "start", "size").repartitionByRange("file", "start").sortWithinPartitions("file", "start")
    return places.mapInArrow(run, RECORDS)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block: int = BLOCK) -> DataFrame:
    """Archives `pages`, indexes the archives, looks every address up and reads its records back.

    One row per row of `pages`: (page_id, url, payload_bytes, payload_digest,
    record_type, refers_to). Of rows with equal payloads of at least 100 bytes,
    that with the smallest id is a response (all rows of that id, if it is
    repeated), the others revisit it; rows without id come last and are
    responses where no row with an id has their payload. A null html is an empty
    payload, a null url an empty address. No rows give no rows.
    """
    tables = Tables(pages.sparkSession, "warc")
    captures = write_archives(pages, tables, id_col, url_col, html_col)
    shards = build_index(captures, tables, block)
    with settings(pages.sparkSession, STEP):
        found = tables.save("found", lookup(captures.select("url_key"), shards, tables.path("index")))
    records = tables.save("records", read_records(found, tables.path("archives"), payloads=False))
    return records.drop("payload").withColumnRenamed("page_id", id_col)


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
