"""Byte-level BPE over a whole corpus: every distinct word is encoded once.

Encoding has three steps. (1) Each task takes chunks of documents, splits the
texts into pre-tokens and replaces them by numbers in the chunk's own word list;
the words of a chunk and the documents' numbers are written, the numbers in
buckets by chunk. So a word travels once per chunk and not once per occurrence,
and its positions do not travel at all. (2) The words are dealt out by a hash of
the word; each distinct word is encoded once, and its ids go back to every chunk
that holds it. (3) The chunk's ids meet its documents in the bucket that already
holds them and are put back by position.

Decoding looks every id up in the token-byte table. That table is the
vocabulary file, of a fixed size, and is sent to every task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import STEP, Tables, arrow_map, arrow_schema, settings

#: UTF-8 bytes of text in a chunk; one longer text is a chunk of its own.
CHUNK = 24 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of least rank, leftmost first, until no pair has one."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _encode_long(parts, ranks)
    pairs = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pairs):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _encode_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for words of any length."""
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or parts[i] + parts[j] != joined:
            continue
        parts[i], alive[j] = joined, False
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (p := parts[left] + parts[right]) in ranks:
                heapq.heappush(heap, (ranks[p], left, p))
    return [ranks[p] for i, p in enumerate(parts) if alive[i]]


def _planes(numbers: np.ndarray) -> bytes:
    """Four-byte numbers, first all lowest bytes, then all second ones, and so on: high bytes are mostly zero."""
    return np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


SPLIT = "chunk bigint, row_id bigint, codes binary, words array<string>"
CODED = "chunk bigint, at binary, sizes binary, ids binary"


def _new_chunk() -> int:
    return uuid.uuid4().int >> 65


def _split(pattern: str, chunk_bytes: int):
    schema = arrow_schema(SPLIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        chunk, held, numbers = _new_chunk(), 0, {}

        def words() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([list(numbers)], schema.field(3).type)], schema=schema)

        def docs(ids: list, codes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(codes, pa.binary()), pa.nulls(len(ids), schema.field(3).type)], schema=schema)

        for batch in batches:
            ids, codes = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                size = len(text.encode())
                if held and held + size > chunk_bytes:
                    yield docs(ids, codes)
                    yield words()
                    ids, codes, chunk, held, numbers = [], [], _new_chunk(), 0, {}
                held += size
                found = find(text)
                for word in set(found).difference(numbers):
                    numbers[word] = len(numbers)
                ids.append(key)
                codes.append(_planes(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))))
            yield docs(ids, codes)
        if held or numbers:
            yield words()

    return run


class _Encoded:
    """Ids of words in the order of their rows; equal words follow one another and are encoded once."""

    def __init__(self, table: dict[bytes, int]):
        self.table, self.last, self.last_ids = table, None, []
        self.clear()

    def clear(self) -> None:
        self.chunks, self.ats, self.sizes, self.ids, self.rows = [], [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        words, n = batch.column(1), batch.num_rows
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(words.slice(1), words.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        distinct = words.take(pa.array(np.flatnonzero(new))).to_pylist()
        found = [self.last_ids if w == self.last else encode_word(w.encode(), self.table) for w in distinct]
        self.last, self.last_ids = distinct[-1], found[-1]
        run = np.cumsum(new) - 1
        self.chunks.append(batch.column(0).to_numpy())
        self.ats.append(batch.column(2).to_numpy())
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.sizes.append(size[run])
        self.ids.append(_runs(np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), np.cumsum(size) - size, size, run))
        self.rows += n

    def packed(self, schema: pa.Schema) -> pa.RecordBatch:
        """One row per chunk: places in its word list, sizes, and ids one after the other."""
        chunks, ats, sizes, ids = (np.concatenate(x) for x in (self.chunks, self.ats, self.sizes, self.ids))
        order = np.argsort(chunks, kind="stable")
        first = np.cumsum(sizes) - sizes
        _, cuts = np.unique(chunks[order], return_index=True)
        groups = np.split(order, cuts[1:])
        out = [[int(chunks[g[0]]) for g in groups], [_planes(ats[g]) for g in groups], [_planes(sizes[g]) for g in groups], [_planes(_runs(ids, first, sizes, g)) for g in groups]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)


def _runs(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that the picked entries stand for, one after the other."""
    n = sizes[picked]
    stop = np.cumsum(n)
    return flat[np.repeat(first[picked] - (stop - n), n) + np.arange(int(n.sum()))]


def _encode_words(ranks):
    schema = arrow_schema(CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = _Encoded(ranks.value)
        for batch in batches:
            if batch.num_rows:
                encoded.add(batch)
            if encoded.rows > 300_000:
                yield encoded.packed(schema)
                encoded.clear()
        if encoded.rows:
            yield encoded.packed(schema)

    return run


def _join_back(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Ids of each document of one chunk."""
    at = np.concatenate([np.zeros(0, np.uint32), *(_from_planes(x) for x in words.column("at").to_pylist())]).astype(np.int64)
    sizes = np.concatenate([np.zeros(0, np.uint32), *(_from_planes(x) for x in words.column("sizes").to_pylist())]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *(_from_planes(x) for x in words.column("ids").to_pylist())]).astype(np.int32)
    first, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    first[at], count[at] = np.cumsum(sizes) - sizes, sizes
    out, ends = [], [0]
    for codes in docs.column("codes").to_pylist():
        out.append(_runs(flat, first, count, _from_planes(codes)))
        ends.append(ends[-1] + len(out[-1]))
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *out]), pa.int32()))
    return pa.table([docs.column("row_id").combine_chunks(), ids], names=["row_id", "ids"])


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, name: str | None = None) -> DataFrame:
    """(id, ids) for each row of `docs`: the ids of its whole text, array<int>.

    `vocabulary` is the path of a rank file, `pattern` splits texts into
    pre-tokens that are encoded separately; special tokens are ordinary text.
    Null and empty texts have no ids. Rows that repeat an id, or have none, each
    give a row. Other columns are not read. No rows give no rows. The result is
    read from a catalog table `name` over files in the shared folder.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "bpe")
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"bpe_chunks_{uuid.uuid4().hex}"
    split = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(_split(pattern, chunk_bytes), SPLIT)
    with settings(spark, STEP):
        split.write.format("parquet").option("compression", "zstd").option("path", tables.path("chunks")).bucketBy(buckets, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    words = chunks.where("words is not null").select("chunk", F.posexplode("words").alias("at", "word"))
    words = words.select("chunk", "word", "at").repartition("word").sortWithinPartitions("word")
    ids = tables.save("words", words.mapInArrow(_encode_words(ranks), CODED), **{"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"})
    numbers = chunks.where("codes is not null").select("chunk", "row_id", "codes")
    joined = numbers.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_join_back, "row_id bigint, ids array<int>")
    return joined.select(F.col("row_id").cast(docs.schema[id_col].dataType).alias(id_col), "ids")


def encode_with_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """`digests` of `encode`, written; the chunk table's name is given back to the catalog, also after a failure."""
    name = f"bpe_chunks_{uuid.uuid4().hex}"
    try:
        return digests(encode(docs, vocabulary, pattern, id_col, text_col, name=name), vocabulary, id_col, keep_ids)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


class Tokens:
    """The token-byte table: bytes of all tokens, and where each id's begin."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return _runs(self.data, self.start, self.length, ids).tobytes()


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes that the ids of each row of `encoded` stand for; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(Tokens(read_ranks(vocabulary)))

    def make(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "decoded": [held.value.bytes_of(row.values.to_numpy()) if row.is_valid else None for row in batch.column("ids")]}

    rows = encoded.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).alias("ids"))
    return arrow_map(rows, "id bigint, decoded binary", make).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), with the ids themselves if asked for.

    Each row's ids are decoded by the token-byte table as in `decode`; only the
    digest of the bytes leaves the task.
    """
    held = encoded.sparkSession.sparkContext.broadcast(Tokens(read_ranks(vocabulary)))
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def make(batch: pa.RecordBatch) -> dict:
        ids = [row.values.to_numpy() for row in batch.column("ids")]
        return {
            "id": batch.column("id"),
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(held.value.bytes_of(x)).hexdigest() for x in ids],
            "ids": batch.column("ids"),
        }

    rows = encoded.select(F.col(id_col).cast("bigint").alias("id"), "ids")
    out = Tables(encoded.sparkSession, "bpe-digests").save("digests", arrow_map(rows, schema, make))
    return out.withColumnRenamed("id", id_col)
