"""Alignment of two tokenizers' tokens over a corpus by interval coalescing.

Both tokenizers cut the same bytes, so tokens are byte ranges. The tokens of
both sides are sorted by start and their ends accumulated by maximum: where a
start reaches the running maximum no token of either side crosses, and a group
breaks there. Within groups every pair of tokens whose ranges overlap is a link;
as ranges of one side follow one another, a token's partners are a run, and
there are fewer links than tokens.

Counts of the whole corpus come in three steps. (1) Tasks align chunks of
documents, write each document's own pairs as numbers in the chunk's pair list,
and the list with the count of documents that hold each pair. (2) Lists are
summed by pair; the highest count of each token of side A is taken from the
sums. (3) Each chunk gets the counts of its own list back, and its documents add
them up. A pair travels once per chunk, however many documents hold it.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import _from_planes as unpack
from ledgerline.llm.bpe import _planes as pack
from ledgerline.llm.common import ARROW, STEP, Tables, settings

#: UTF-8 bytes of text in a chunk and in one call of the tokenizers; one longer text is a chunk and a call of its own.
CHUNK, CALL = 24 << 20, 1 << 20
#: Characters of pre-tokens that a task keeps with their ids before it starts anew.
KNOWN = 64 << 20

SPLIT = "chunk bigint, row_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, times binary, pairs array<bigint>, held array<bigint>"
OUT = "row_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def plain_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema of plain columns, without a session."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Pair:
    """The two tokenizers and their tokens' bytes; files are read on the driver, tokenizers made where they are used."""

    def __init__(self, bpe_path: str, piece_path: str, pattern: str):
        with open(bpe_path, encoding="utf-8") as f:
            self.bpe = f.read()
        with open(piece_path, "rb") as f:
            self.pieces = f.read()
        self.pattern = pattern

    def __getstate__(self) -> dict:
        return {"bpe": self.bpe, "pieces": self.pieces, "pattern": self.pattern}

    def load(self) -> Pair:
        if hasattr(self, "a"):
            return self
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(self.bpe)
        self.a.encode_special_tokens = True
        self.find = regex.compile(self.pattern).findall
        self._forget()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.pieces)
        to_byte = byte_level()
        vocabulary = json.loads(self.bpe)["model"]["vocab"]
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, at in vocabulary.items():
            self.a_bytes[at] = bytes(to_byte[c] for c in token)
        self.b_bytes = []
        for at in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(at)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(at) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        return self

    def _forget(self) -> None:
        """Starts the list of known pre-tokens anew: their numbers, and the ids of each in one array."""
        self.numbers, self.characters = {}, 0
        self.ids, self.stop = _Growing(), _Growing()

    def _learn(self, new: list[str]) -> None:
        found = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        for word, ids in zip(new, found):
            if b"".join(map(self.a_bytes.__getitem__, ids)) != word.encode():
                raise ValueError(f"side A changes the bytes of {word!r}")
        before = len(self.numbers)
        self.numbers.update(zip(new, range(before, before + len(new))))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.stop.add(len(self.ids) + np.cumsum(sizes))
        self.ids.add(np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())))
        self.characters += sum(64 + len(w) for w in new)

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of side A, text after text, and how many each text has: a pre-token is encoded when it is first met, and then known."""
        if self.characters > KNOWN:
            self._forget()
        found = [self.find(t) for t in texts]
        if any(sum(map(len, words)) != len(t) for words, t in zip(found, texts)):
            raise ValueError("the pattern leaves out a part of a text")
        self._learn(list(set().union(*found).difference(self.numbers)))
        words = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        stop = self.stop.held()
        size = np.diff(stop, prepend=0)
        counts = size[words]
        ends = np.cumsum(counts)
        ids = self.ids.held()[np.repeat(stop[words] - ends, counts) + np.arange(int(counts.sum()))]
        return ids, np.diff(np.r_[0, ends][np.cumsum([0, *map(len, found)])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, text after text, and how many of each side a text has; none where either side's bytes are not the text's."""
        spaced = [" " + t if t else "" for t in texts]
        a, n_a = self.encode_a(spaced)
        b = [ids if b"".join(map(self.b_bytes.__getitem__, ids)) == t.encode() else [] for t, ids in zip(spaced, self.b.encode(texts, num_threads=1))]
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        a, n_a = a[np.repeat(n_b > 0, n_a)], np.where(n_b > 0, n_a, 0)
        return a, n_a, np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum())), n_b


class _Growing:
    """Numbers, one after the other, in an array that doubles."""

    def __init__(self) -> None:
        self.data, self.used = np.zeros(1 << 16, np.int64), 0

    def __len__(self) -> int:
        return self.used

    def add(self, more: np.ndarray) -> None:
        need = self.used + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(need, 2 * len(self.data)) - self.used, np.int64)])
        self.data[self.used : need] = more
        self.used = need

    def held(self) -> np.ndarray:
        return self.data[: self.used]


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The group of each range: groups break where a start reaches the running maximum of the ends."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    new = np.r_[True, start[order][1:] >= reach[:-1]] if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of ranges that overlap; each side's ranges follow one another without gaps."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = high - low
    stop = np.cumsum(n)
    return np.repeat(np.arange(len(n)), n), np.repeat(low - (stop - n), n) + np.arange(int(n.sum()))


def _group_texts(ids: np.ndarray, group: np.ndarray, side: np.ndarray, doc: np.ndarray, n_docs: int) -> list[str]:
    """Digest of each document's groups, `a1,a2|b1;a3|b2`: ids in order, written digit by digit."""
    if not len(ids):
        return [""] * n_docs
    order = np.argsort(2 * group + side, kind="stable")
    ids, group, side, doc = ids[order], group[order], side[order], doc[order]
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[1:][side[1:] != side[:-1]] = ord("|")
    mark[1:][group[1:] != group[:-1]] = ord(";")
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))
    end = np.cumsum(digits + 1)
    text = np.empty(int(end[-1]), np.uint8)
    text[end - digits - 1] = mark
    for k in range(int(digits.max())):
        has = digits > k
        text[end[has] - 1 - k] = ord("0") + ids[has] // 10**k % 10
    first, last = np.searchsorted(doc, np.arange(n_docs), "left"), np.searchsorted(doc, np.arange(n_docs), "right")
    begins = end - digits
    return [hashlib.sha256(text[begins[f] : end[x - 1]].tobytes()).hexdigest() if x > f else "" for f, x in zip(first, last)]


class _Aligned:
    """Counts, digests and distinct pairs (with their number of links) of some documents."""

    def __init__(self, pair: Pair, texts: list[str]):
        n = len(texts)
        a, self.n_a, b, self.n_b = pair.encode(texts)
        doc_a, doc_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        # Both sides hold the same bytes of every document, so places in all texts together agree.
        a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        a_start, b_start = a_end - pair.a_size[a], b_end - pair.b_size[b]
        side = np.repeat(np.array([0, 1]), [len(a), len(b)])
        group, doc = coalesce(np.r_[a_start, b_start], np.r_[a_end, b_end], side), np.r_[doc_a, doc_b]
        first = np.r_[True, group[1 : len(a)] != group[: len(a) - 1]] if len(a) else np.zeros(0, bool)
        self.n_groups = np.bincount(doc_a[first], minlength=n)
        self.digests = _group_texts(np.r_[a, b], group, side, doc, n)
        left, right = overlaps(a_start, a_end, b_start, b_end)
        self.n_links = np.bincount(doc_a[left], minlength=n)
        keys, times = np.unique(doc_a[left] << 32 | a[left] << 16 | b[right], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(1, n) << 32)
        self.pairs, self.times = np.split(keys & 0xFFFFFFFF, cuts), np.split(times, cuts)


class _Chunk:
    """Aligned documents that share one pair list."""

    def __init__(self) -> None:
        self.name, self.bytes, self.ids, self.parts = uuid.uuid4().int >> 65, 0, [], []

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        pairs = [p for part in self.parts for p in part.pairs]
        distinct, codes = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_inverse=True)
        held = np.bincount(codes, minlength=len(distinct))
        codes = np.split(codes, np.cumsum([len(p) for p in pairs])[:-1])
        n = len(self.ids)
        made = {
            "chunk": np.full(n, self.name), "row_id": self.ids,
            **{c: np.concatenate([getattr(part, c) for part in self.parts]) for c in ("n_a", "n_b", "n_groups", "n_links")},
            "groups_sha256": [d for part in self.parts for d in part.digests],
            # Codes of a document ascend, so their steps are small numbers.
            "codes": [pack(np.diff(c, prepend=0)) for c in codes], "times": [pack(t) for part in self.parts for t in part.times],
        }
        yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)
        if len(distinct):
            listed = {"chunk": [self.name], "pairs": [distinct], "held": [held]}
            yield pa.RecordBatch.from_arrays([pa.array(listed[f.name], f.type) if f.name in listed else pa.nulls(1, f.type) for f in schema], schema=schema)


def _split(held, chunk_bytes: int, call_bytes: int):
    schema = plain_schema(SPLIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk, waiting, size = held.value.load(), _Chunk(), [], 0

        def align() -> None:
            if waiting:
                chunk.parts.append(_Aligned(pair, waiting))
                waiting.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                n = len(text.encode())
                if chunk.bytes and chunk.bytes + n > chunk_bytes:
                    align()
                    yield from chunk.rows(schema)
                    chunk, size = _Chunk(), 0
                elif size and size + n > call_bytes:
                    align()
                    size = 0
                chunk.bytes, size = chunk.bytes + n, size + n
                chunk.ids.append(key)
                waiting.append(text)
        align()
        if chunk.ids:
            yield from chunk.rows(schema)

    return run


def _add_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Each document's sums, from the counts of its chunk's pairs."""
    at = counts.column("at").to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    total[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    sums = []
    for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist()):
        codes, times = np.cumsum(unpack(codes).astype(np.int64)), unpack(times).astype(np.int64)
        sums.append((int(times[best[codes]].sum()), int((times * total[codes]).sum())))
    made = {"n_best": [s[0] for s in sums], "count_sum": [s[1] for s in sums]}
    return pa.table([pa.array(made[f.name], f.type) if f.name in made else docs.column(f.name) for f in plain_schema(OUT)], schema=plain_schema(OUT))


def align(docs: DataFrame, bpe_path: str, piece_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, call_bytes: int = CALL) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of `docs`.

    Side A encodes a blank and the text by the byte-level vocabulary in
    `bpe_path`, whose pre-tokens are the matches of `pattern`; side B the text by the piece model in `piece_path`; strings of
    special tokens are plain text. n_best counts links whose pair of ids is held
    by as many documents as any pair of its A id, count_sum adds up those
    numbers over all links. Texts that are null or empty, or whose bytes either
    side changes, have zeros and no digest. Rows that repeat an id, or have none,
    are documents of their own. Other columns are not read, whatever their
    names. No rows give no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "align")
    held = spark.sparkContext.broadcast(Pair(bpe_path, piece_path, pattern))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    chunks = tables.save("chunks", rows.mapInArrow(_split(held, chunk_bytes, call_bytes), SPLIT))
    listed = chunks.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p"))
    listed = listed.select("chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = tables.save("counts", listed.groupBy("pair").agg(F.sum("held").alias("n")))
    a_id = F.shiftright("pair", 16).alias("a")
    # One row per id of the vocabulary at most.
    highest = F.broadcast(counts.groupBy(a_id).agg(F.max("n").alias("highest")))
    judged = tables.save("judged", counts.withColumn("a", F.shiftright("pair", 16)).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))
    back = tables.save("back", listed.select("chunk", "at", "pair").join(judged, "pair").select("chunk", F.col("at").cast("bigint").alias("at"), "n", "best"))
    numbers = chunks.where("codes is not null").drop("pairs", "held")
    with settings(spark, STEP):
        summed = tables.save("sums", numbers.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_add_up, OUT))
    return summed.withColumnRenamed("row_id", id_col).withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))
