import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerline.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})


def texts():
    draw = random.Random(3)
    alphabet = "abcdefghij éßñ漢字🙂'\t\n  .,!?0123456789İ  \x1c"
    out = ["", None, "<|endoftext|> it's we'll", " " * 3000, "a" * 5000, "x y " * 30000, "\r\n\r\n  end ", "\x00\x1f"]
    return out + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 400))) for _ in range(150)]


@pytest.mark.parametrize("chunk_bytes", [1, 2000, bpe.CHUNK])
def test_ids_equal_the_library_and_decode_to_the_text(spark, library, chunk_bytes):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(5, "again", "x", "y"), (5, "again", "x", "y"), (None, "no id", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, ids string")
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, chunk_bytes=chunk_bytes)
    got = bpe.digests(encoded, VOCABULARY, keep_ids=True).collect()
    want = [(i, library.encode_ordinary(t or ""), t or "") for i, t, *_ in rows]
    assert sorted((repr(r.doc_id), r.ids) for r in got) == sorted((repr(i), ids) for i, ids, _ in want)
    assert sorted((repr(r.doc_id), bytes(r.decoded)) for r in bpe.decode(encoded, VOCABULARY).collect()) == sorted((repr(i), t.encode()) for i, _, t in want)
    digests = sorted((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for _, ids, t in want)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == digests


def test_the_catalog_keeps_no_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    before = {t.name for t in spark.catalog.listTables()}
    got = bpe.encode_with_digests(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert {t.name for t in spark.catalog.listTables()} <= before
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == [(1, 2), (2, 0)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.digests(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).collect() == []


def test_both_merge_loops_agree():
    ranks = bpe.read_ranks(VOCABULARY)
    draw = random.Random(9)
    for _ in range(200):
        word = "".join(draw.choice("aeinrst hé") for _ in range(draw.randint(2, 60))).encode()
        assert word in ranks or bpe.encode_word(word, ranks) == bpe._encode_long([word[i : i + 1] for i in range(len(word))], ranks)
