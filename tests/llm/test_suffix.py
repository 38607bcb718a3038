import hashlib
import random

import pytest

from ledgerline.llm import suffix

SCHEMA = "doc_id bigint, text string, doc int, runs string"


def brute(texts):
    """Every 100-byte string in order of position; the first of equal ones stays."""
    seen, out = set(), []
    for text in texts:
        data, gone = text.encode(), set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(data[i : i + 100])
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        out.append((len(data), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9)))
    passages = [" ".join(word() for _ in range(draw.randint(10, 60))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [draw.choice(passages) if draw.random() < 0.4 else " ".join(word() for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(1, 6))]
        text = " ".join(parts)
        if draw.random() < 0.4:
            cut = draw.randint(0, len(text))
            text = text[cut:] + word() + text[:cut]
        texts.append(text)
    for _ in range(15):
        texts.append(draw.choice(texts))
        words = draw.choice(texts).split(" ")
        words[draw.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts + ["a" * 300, "ab" * 200, "", "a" * 99, "a" * 100, "xyz " * 500, "漢" * 120]


def check(spark, texts):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_crowded_buckets_and_small_pieces(spark, monkeypatch):
    """Window by window over the cluster, blocks of a row, texts in pieces: the same result."""
    monkeypatch.setattr(suffix, "BUCKET", 1)
    check(spark, corpus(2))


def test_pieces_and_samples():
    draw = random.Random(5)
    text = "".join(draw.choice("abc ") for _ in range(3000)).encode()
    bucket, _, place = suffix.sample(text)
    starts = place >> 2 * suffix.BITS
    more = place >> suffix.BITS & (1 << suffix.BITS) - 1
    assert starts[0] == 0 and (starts[1:] == starts[:-1] + more[:-1] + 1).all() and starts[-1] + more[-1] == len(text) - 100
    old, suffix.PIECE = suffix.PIECE, 170
    try:
        cut, _, place = suffix.sample(text)
    finally:
        suffix.PIECE = old
    assert set(bucket) <= set(cut)
    starts, more = place >> 2 * suffix.BITS, place >> suffix.BITS & (1 << suffix.BITS) - 1
    assert starts[0] == 0 and (starts[1:] == starts[:-1] + more[:-1] + 1).all() and starts[-1] + more[-1] == len(text) - 100


def test_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=60000))
    rows = [(2, long, 0, None), (2, long, 0, "x"), (3, long[100:400], None, None), (None, long[:150], 0, "x"), (4, None, 0, "x"), (5, "", 0, "x"), (3, "other " + long[100:400], 0, "x")]
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed) for r in suffix.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("2", 60000, 150), ("2", 60000, 150), ("3", 300, 300), ("3", 306, 300), ("4", 0, 0), ("5", 0, 0), ("None", 150, 0)]
    assert suffix.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = {r.doc_id: bytes(r.kept) for r in suffix.deduplicate(spark.createDataFrame(rows[:1] + rows[3:4], SCHEMA), keep_text=True).collect()}
    assert kept == {2: long[150:].encode(), None: long[:150].encode()}
