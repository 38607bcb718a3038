import hashlib

import pytest

import corpus_pipeline
from ledgerline.llm import bpe, cotraining, minhash, pii
from ledgerline.llm.common import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of documents and of every stage."""
    tables = Tables(spark, "test-pipeline")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(tables.save(f"stage-{number}", stage(spark, out[-1], SF)))
    return out


def test_columns(stages):
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:5])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "personal data", "mixing", "byte-level BPE"]


def test_each_stage_takes_its_decisions_on_all_it_is_given(spark, stages):
    raw, good, single, private, mixed, coded = (s.toPandas().set_index("doc_id", drop=False) for s in stages)
    model = cotraining.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(good.doc_id) == {r.doc_id for r in cotraining.score(stages[0], model).collect() if r.kept}
    assert set(single.doc_id) == {r.doc_id for r in minhash.near_duplicates(stages[1]).collect() if r.kept}
    assert (single.text == raw.text[single.index]).all()
    assert set(private.doc_id) == set(single.doc_id)
    assert all(not pii.base_spans(t) for t in private.text) and (private.n_chars == private.text.str.len()).all()
    untouched = [i for i, t in single.text.items() if not pii.proposals(t)]
    assert len(untouched) > len(single) / 2 and (private.text[untouched] == single.text[untouched]).all()
    assert set(mixed.doc_id) <= set(private.doc_id) and mixed.doc_id.is_unique
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").toPandas().doc_id
    clean = set(labels) & set(private.doc_id)
    assert len(clean & set(mixed.doc_id)) >= 0.9 * len(clean)
    ranks = bpe.read_ranks(corpus_pipeline.VOCABULARY)
    back = {i: t for t, i in ranks.items()}
    for row in coded.itertuples():
        text = mixed.text[row.doc_id].encode()
        assert b"".join(back[i] for i in row.ids) == text and row.decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_odd_documents_go_through(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id a@b.cc", "en", "s", 9), (3, "long " * 30000, "en", "s", 1), (4, "twice the same text here", "en", "s", 1), (4, "twice the same text here", "en", "s", 1), (5, "twice the same text here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for start in (docs, docs.limit(0)):
        now, tables = start, Tables(spark, "test-odd")
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = tables.save(f"stage-{number}", stage(spark, now, SF))
            if number == 1:
                assert now.where("text LIKE 'twice%'").count() <= 1
        assert now.count() <= 6


def test_near_duplicates_keep_one_row_of_each_group_whatever_the_ids(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    a, b, c, d = (" ".join(f"{letter}{i}" for i in range(30)) for letter in "abcd")
    texts = [
        (None, a), (None, b), (None, b), (None, b.upper()), (7, c), (7, d), (3, d + " end"), (8, c), (9, a + " end"),
        (None, None), (None, ""), (5, " "), (5, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], schema).repartition(5)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    worded = [r for r in got if (r[1] or "").strip()]
    assert sorted(worded, key=str) == sorted([(9, a + " end"), (7, c), (3, d + " end"), next(r for r in worded if r[1].lower() == b)], key=str)
    assert sorted(set(got) - set(worded), key=str) == sorted({(None, None), (None, ""), (5, " "), (5, "")}, key=str) and len(got) == 8
