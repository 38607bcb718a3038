"""Removal of repeated byte strings in buckets of a cover sampled by content.

A byte goes if it lies in a 100-byte string that also starts earlier (smaller
document, or earlier in the same one). Only windows of 100 bytes whose bucket
holds a second one are looked at. Windows are grouped by hashes of their bytes;
nothing depends on the order of suffixes, so none are ranked:

1. Cover sample. Each 100-byte window picks the least hash of the 24-byte strings
   in it. Like a difference cover this gives any two equal windows sample points
   at one and the same shift, but the points are chosen by content, 2.6 % of the
   positions; a cover by residues needs 12 % at this length.
2. Buckets. A sample's 24 bytes name the bucket of all windows that pick it. A
   bucket of one sample holds no repeated window and is never sorted.
3. Contexts. A sample's context is all bytes of the windows that picked it. Equal
   contexts of a bucket are long ties: the earliest occurrence stays, the others
   go as a whole.
4. Blocks. The earliest one of each context is left. Buckets with several
   contexts are dealt out, and a task sorts the window hashes of a few buckets at
   a time, in memory bounded by a block; in each run of equal windows the first
   one stays. Buckets of very many contexts are grouped window by window over the
   cluster. Wherever windows are equated, bucket and window hash both agree.

Texts move twice: to cut out the contexts of step 4 and to remove what was found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import POWERS, Tables, arrow_map, arrow_schema, mix, prefix_hash, stretch_hash, utf8

LENGTH, GRAM = 100, 24
#: Strings of GRAM bytes in a window.
SPAN = LENGTH - GRAM + 1
#: Window starts handled at once, so that places fit in 24 bits.
PIECE = 8 << 20
PLACE = np.uint64((1 << 24) - 1)
#: Contexts in a block, and in a bucket that one task may sort.
BLOCK, BUCKET = 4000, 2000
#: Places are one number: start, count of windows less one, and shift of the sample.
BITS = 7


def _sample(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, context hash, first window, windows less one and shift of each sample point."""
    sums = prefix_hash(data)
    _, down = POWERS.get(len(sums))
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    least = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    picked = (least & PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(picked, prepend=-1))
    last = np.append(first[1:], len(picked)) - 1
    return grams[picked[first]], stretch_hash(sums, first, last + LENGTH), first, last - first, picked[first] - first


def sample(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, context hash and packed place of each sample point of a text."""
    data = np.frombuffer(text, np.uint8)
    found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    for start in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        bucket, context, first, more, shift = _sample(data[start : start + PIECE + LENGTH - 1])
        for held, x in zip(found, (bucket, context, (first + start) << 2 * BITS | more << BITS | shift)):
            held.append(x)
    return tuple(np.concatenate(x) for x in found)


SAMPLES = "bucket bigint, context bigint, doc bigint, text_hash bigint, place bigint"


def _samples(docs: DataFrame) -> DataFrame:
    fields = arrow_schema(SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sample(t) for t in utf8(batch.column(2))]
            sizes = [len(r[0]) for r in rows]
            bucket, context, place = (np.concatenate([r[i] for r in rows] or [np.zeros(0, np.int64)]) for i in range(3))
            doc, text_hash = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket.view(np.int64), context.view(np.int64), doc, text_hash, place)], schema=fields)

    return docs.mapInArrow(run, SAMPLES)


CUTS = "bucket bigint, doc bigint, text_hash bigint, start bigint, cut binary, window bigint"


def _cut(rows: DataFrame) -> DataFrame:
    """Contexts of the wanted places; of crowded buckets a row per window with its hash."""
    fields = arrow_schema(CUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text_hash, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = (text or "").encode()
                for want in wanted:
                    start, more = want["place"] >> 2 * BITS, want["place"] >> BITS & (1 << BITS) - 1
                    cut = text[start : start + more + LENGTH]
                    if not want["crowded"]:
                        out.append((want["bucket"], doc, text_hash, start, cut, None))
                        continue
                    hashes = _windows([cut])[0].view(np.int64)
                    out += [(want["bucket"], doc, text_hash, start + i, None, int(h)) for i, h in enumerate(hashes)]
            for i in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out[i : i + 5000]), fields)], schema=fields)

    return rows.mapInArrow(run, CUTS)


def _windows(cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, cut and place in the cut of every 100-byte window."""
    sums = prefix_hash(np.frombuffer(b"".join(cuts), np.uint8))
    sizes = np.array([len(c) for c in cuts], np.int64)
    counts = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(cuts)), counts)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + inside
    return stretch_hash(sums, start, start + LENGTH), row, inside


RUNS = "doc bigint, text_hash bigint, first bigint, last bigint"


def repeated_windows(cuts: list[bytes]) -> list[tuple[int, int, int]]:
    """(cut, first, last) of runs of windows that an earlier cut, or an earlier place of the cut, also has."""
    hashes, row, inside = _windows(cuts)
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order), bool)
    same[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    at = np.flatnonzero(same)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(row[at]) > 0)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return [(int(row[at[b]]), int(inside[at[b]]), int(inside[at[e]])) for b, e in zip(begin, end)]


def _sort_blocks(cuts: DataFrame) -> DataFrame:
    """Repeated windows of whole buckets, a block of buckets at a time."""
    fields = arrow_schema(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            out = [(rows[r][1], rows[r][2], rows[r][3] + a, rows[r][3] + b) for r, a, b in repeated_windows([x[4] for x in rows])]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], schema=fields)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if len(held) >= BLOCK and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    dealt = cuts.repartition("bucket").sortWithinPartitions("bucket", "doc", "text_hash", "start")
    return dealt.mapInArrow(run, RUNS)


def _removed(text: bytes, runs: list[int] | None) -> tuple[int, int, str]:
    """Removed bytes, their maximal runs, and the digest of what is left."""
    if not runs:
        return 0, 0, hashlib.sha256(text).hexdigest()
    edges = np.zeros(len(text) + 1, np.int64)
    packed = np.array(runs, np.int64)
    np.add.at(edges, packed >> 32, 1)
    np.add.at(edges, (packed & 0xFFFFFFFF) + LENGTH, -1)
    gone = np.cumsum(edges[:-1]) > 0
    return int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Tables]:
    """(doc, text_hash, runs array<bigint>): for each text the runs of repeated windows, first and last in one number."""
    tables = Tables(docs.sparkSession, "suffix")
    texts = _keyed(docs, id_col, text_col)
    samples = tables.save("samples", _samples(texts))
    shared = tables.save("shared", samples.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"))
    # Tables on both sides: Spark splits the rows of a bucket that many texts share.
    held = tables.save("held", samples.join(shared, "bucket"))
    tables.drop("samples")
    at = F.struct("doc", "text_hash", "place")
    ranks = tables.save("ranks", held.groupBy("bucket", "context").agg(F.min(at).alias("first")).select("bucket", "context", "first.*"))
    crowds = tables.save("crowds", ranks.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))

    earliest = ranks.select("bucket", "context", at.alias("earliest"))
    start, more = F.shiftright("place", 2 * BITS), F.shiftright("place", BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    ties = held.join(earliest, ["bucket", "context"]).where(at != F.col("earliest")).select("doc", "text_hash", start.alias("first"), (start + more).alias("last"))
    ties = tables.save("ties", ties)

    wanted = ranks.join(crowds, "bucket").select("doc", "text_hash", F.struct("bucket", "place", (F.col("c") > BUCKET).alias("crowded")).alias("w"))
    wanted = tables.save("wanted", wanted.groupBy("doc", "text_hash").agg(F.collect_list("w").alias("wanted")))
    cuts = tables.save("cuts", _cut(texts.join(wanted, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"]).select("doc", "text_hash", "text", "wanted")))
    blocks = tables.save("blocks", _sort_blocks(cuts.where("window is null").select("bucket", "doc", "text_hash", "start", "cut")))
    # Equal windows lie in one bucket, so two independent hashes have to agree.
    windows = cuts.where("window is not null").select("bucket", "window", "doc", "text_hash", "start")
    place = F.struct("doc", "text_hash", "start")
    leaders = tables.save("leaders", windows.groupBy("bucket", "window").agg(F.min(place).alias("leader"), F.count("*").alias("c")).where("c > 1").select("bucket", "window", "leader"))
    crowded = windows.join(leaders, ["bucket", "window"]).where(place != F.col("leader")).select("doc", "text_hash", F.col("start").alias("first"), F.col("start").alias("last"))

    runs = ties.union(blocks).union(crowded).select("doc", "text_hash", F.shiftleft("first", 32).bitwiseOR(F.col("last")).alias("run"))
    runs = tables.save("runs", runs.groupBy("doc", "text_hash").agg(F.collect_list("run").alias("runs")))
    tables.drop("held", "ranks", "cuts", "wanted", "ties", "blocks")
    return runs, tables


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`; with `keep_text` also what is left, as bytes.

    Null texts are empty. Rows without id come before all others. Rows that
    repeat id and text are one document and get equal results; rows that repeat
    an id with other texts are documents of their own, in the order of a hash of
    the text. Other columns are not read. No rows give no rows.
    """
    runs, _ = repeated_strings(docs, id_col, text_col)
    rows = _keyed(docs, id_col, text_col).withColumn("id", F.col("doc")).join(runs, ["doc", "text_hash"], "left").select("id", "text", "runs")
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text

    def make(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column(1))
        lists = batch.column(2).to_pylist()
        found = [_removed(t, r) for t, r in zip(texts, lists)]
        out = {"id": batch.column(0), "n_bytes": [len(t) for t in texts], **{n: [x[i] for x in found] for i, n in enumerate(("n_removed", "n_spans", "kept_sha256"))}}
        if keep_text:
            out["kept"] = [remaining(t, r) for t, r in zip(texts, lists)]
        return out

    out = Tables(docs.sparkSession, "suffix-result").save("result", arrow_map(rows, schema, make))
    return out.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias(id_col), *out.columns[1:])


def remaining(text: bytes, runs: list[int] | None) -> bytes:
    """What is left of `text` without the windows of `runs`."""
    gone = np.zeros(len(text), bool)
    for run in runs or []:
        gone[run >> 32 : (run & 0xFFFFFFFF) + LENGTH] = True
    return np.frombuffer(text, np.uint8)[~gone].tobytes()
