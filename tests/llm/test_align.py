import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ledgerline.llm import align

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def texts():
    draw = random.Random(4)
    words = ["the", "tokenization", "naïve", "漢字", "🙂", "\n", "\t", " ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "123456", "don't", "x▁y", "　", "ﬁ", "\x00", "é"]
    made = [" ".join(draw.choices(words[:8], k=draw.randint(1, 30))) for _ in range(60)] + ["".join(draw.choices(words, k=draw.randint(1, 12))) for _ in range(40)]
    return [None, "", " ", "  ", "a", "same text here", "same text here", *words, *made, "long words and numbers 42 " * 4000]


def brute(given):
    pair = align.Pair(*PATHS).load()
    docs, holds = [], Counter()
    for text in given:
        a, b = [], []
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            want = (" " + text).encode()
            if b"".join(pair.a_bytes[i] for i in a) != want or b"".join(pair.b_bytes[i] for i in b) != want:
                a, b = [], []
        ends = []
        for side, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, found = 0, []
            for i in side:
                at += len(table[i])
                found.append(at)
            ends.append(found)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, low = [], [], 0
        for cut in cuts:
            inside = [[k for k, e in enumerate(side) if low < e <= cut] for side in ends]
            groups.append("|".join(",".join(str(ids[k]) for k in inside[s]) for s, ids in enumerate((a, b))))
            for i in inside[0]:
                for j in inside[1]:
                    if max(ends[0][i] - len(pair.a_bytes[a[i]]), ends[1][j] - len(pair.b_bytes[b[j]])) < min(ends[0][i], ends[1][j]):
                        links.append((a[i], b[j]))
            low = cut
        holds.update(set(links))
        docs.append((len(a), len(b), links, ";".join(groups)))
    highest = Counter()
    for (i, _), n in holds.items():
        highest[i] = max(highest[i], n)
    out = []
    for n_a, n_b, links, text in docs:
        best = sum(holds[p] == highest[p[0]] for p in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, text.count(";") + 1 if n_a else 0, len(links), best, sum(holds[p] for p in links), digest))
    return out


@pytest.mark.parametrize("chunk_bytes, call_bytes", [(align.CHUNK, align.CALL), (300, 100)])
def test_equals_plain_loops(spark, chunk_bytes, call_bytes):
    short = [t if t is None or len(t) < 10_000 else t[:2000] for t in texts()]
    rows = [(i, t, 1, "p", 5) for i, t in enumerate(short)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chunk int, pairs string, n int").repartition(3)
    got = sorted(tuple(r) for r in align.align(docs, *PATHS, chunk_bytes=chunk_bytes, call_bytes=call_bytes).collect())
    assert [r[1:] for r in got] == brute(short)
    assert any(r[1] for r in got) and any(not r[1] and short[r[0]] for r in got)


def test_whole_long_text_missing_and_repeated_ids(spark):
    long = texts()[-1]
    docs = spark.createDataFrame([(None, long), (3, "a b"), (3, "a b"), (None, None)], "doc_id bigint, text string")
    out = align.align(docs, *PATHS)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((r.doc_id is None, *tuple(r)[1:]) for r in out.collect())
    assert [r[0] for r in got] == [False, False, True, True]
    pair = align.Pair(*PATHS).load()
    assert got[3][1:3] == (len(pair.a.encode(" " + long).ids), len(pair.b.encode(long)))
    assert got[0] == got[1] and got[0][5] >= 2 and got[2] == (True, 0, 0, 0, 0, 0, 0, "")


def test_known_words_equal_the_library_on_whole_texts(spark, monkeypatch):
    draw = random.Random(12)
    signs = "ab é漢🙂1² .,'!\t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2028\u3000\u200b_-İʼ"
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    given += ["".join(draw.choices(signs, k=draw.randint(1, 60))) for _ in range(3000)] + ["it's WE'LL they've  I'd\n\n 'tis", " " * 5000 + "x", "a" * 20000]
    given = [" " + t for t in given if t]
    pair = align.Pair(*PATHS).load()
    want = [e.ids for e in pair.a.encode_batch(given, add_special_tokens=False)]
    for size, known in ((7, align.KNOWN), (len(given), align.KNOWN), (50, 1000)):
        monkeypatch.setattr(align, "KNOWN", known)
        got = []
        for k in range(0, len(given), size):
            ids, counts = pair.encode_a(given[k : k + size])
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want


def test_no_rows(spark):
    assert align.align(spark.createDataFrame([], "doc_id bigint, text string"), *PATHS).collect() == []
