import numpy as np

from ledgerline.llm import cotraining

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, _text string, score double"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = cotraining.train(docs, labels.where("doc_id % 4 <> 1"))
    held = cotraining.score(docs, model).join(labels.where("doc_id % 4 = 1"), "doc_id").toPandas()
    assert (held.kept == (held.quality == 1)).mean() > 0.93
    assert held.kept[held.quality == 1].mean() > 0.97
    for view in ("text_score", "meta_score"):
        assert ((held[view] > 0.5) == (held.quality == 1)).mean() > 0.85
    assert set(cotraining.keep_good(docs, model).select("doc_id").toPandas().doc_id) == set(cotraining.score(docs, model).where("kept").toPandas().doc_id)


def test_pool_helps_when_labels_are_few():
    draw = np.random.default_rng(1)
    y = draw.random(1200) < 0.5
    text = (draw.normal(size=(1200, 8)) + 1.2 * y[:, None]).astype(np.float32)
    meta = (draw.normal(size=(1200, 8)) + 1.2 * y[:, None]).astype(np.float32)
    few = slice(0, 24)
    taught = lambda rows: lambda views: cotraining.sums(text[rows], meta[rows], views, cotraining.SURE)
    alone = cotraining.cotrain(text[few], meta[few], y[few].astype(float), taught(slice(0, 0)))
    both = cotraining.cotrain(text[few], meta[few], y[few].astype(float), taught(slice(24, 700)))
    right = lambda m: ((m.scores(text[700:], meta[700:])[:, 2] > 0.5) == y[700:]).mean()
    assert right(both) >= right(alone) - 0.01 and right(both) > 0.9


def plain_scores(docs, labels, labelled_rows=6000):
    """The same model from one array of all documents, and each document scored by itself."""
    rows = [(r.doc_id, (r.text or "").encode(), r.source, r.lang, r.n_chars) for r in docs.select("doc_id", "text", "source", "lang", "n_chars").collect()]
    text, meta = np.stack([cotraining.text_view(r[1]) for r in rows]), np.stack([cotraining.meta_view(*r[1:]) for r in rows])
    known = {}
    for r in labels.collect():
        if r.quality is not None and r.doc_id is not None:
            known.setdefault(r.doc_id, []).append(r.quality)
    known = {i: float(np.mean(q) >= 0.5) for i, q in known.items()}
    assert len(known) <= labelled_rows
    picked = sorted((r[0], text[i].tobytes(), meta[i].tobytes(), i) for i, r in enumerate(rows) if r[0] in known)
    mine = [i for *_, i in picked]
    others = [i for i, r in enumerate(rows) if r[0] not in known]
    model = cotraining.cotrain(text[mine], meta[mine], np.array([known[i] for i, *_ in picked]), lambda views: cotraining.sums(text[others], meta[others], views, cotraining.SURE))
    return {r[0]: model.scores(text[i : i + 1], meta[i : i + 1])[0] for i, r in enumerate(rows)}


def test_scores_equal_plain_numpy_however_documents_are_dealt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = plain_scores(docs, labels)
    for parts in (1, 5):
        dealt = docs.repartition(parts)
        got = cotraining.score(dealt, cotraining.train(dealt, labels.repartition(parts))).collect()
        assert len(got) == len(want) and all(np.allclose([r.text_score, r.meta_score, r.score], want[r.doc_id], atol=1e-9) for r in got)
        assert all(r.kept == (r.score >= cotraining.THRESHOLD) for r in got)


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None, None, None, None, "a", 0.5), (1, "", "en", "s", 0, "a", 0.5), (None, "x " * 100000, "en", "s", 5, "a", 0.5), (2, "ok", "en", "s", 2, "a", 0.5), (2, "ok", "en", "s", 2, "a", 0.5)]
    docs = spark.createDataFrame(rows, DOCS)
    one_class = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    model = cotraining.train(docs, one_class)
    assert model.text is None
    assert [r.kept for r in cotraining.score(docs, model).collect()] == [True] * 5
    assert cotraining.keep_good(docs, model).count() == 5
    big = spark.read.parquet(f"{SF}/documents.parquet")
    model = cotraining.train(big, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = cotraining.score(docs, model).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    assert cotraining.score(docs.limit(0), model).collect() == []
    kept = cotraining.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() <= 5
    assert cotraining.score(docs.select("doc_id", "text"), model).count() == 5
