import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import mixing
from ledgerline.llm.common import Tables

SF = "/root/testdata/sf0.01"
TARGETS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}


def solve(n, p, shares, budget, pull, most):
    """The same least squares by many plain projected steps."""
    weight = n / budget
    there = weight @ p
    size = 1 / (len(shares) + pull)
    r = np.ones(len(n))
    for _ in range(50000):
        total = (weight * r) @ p
        r = np.clip(r - size * (p @ ((total - shares) / there) + pull * (r - 1)), 0, most)
    return r


def test_rates_equal_plain_projected_gradient(spark):
    draw = np.random.default_rng(2)
    p = draw.dirichlet([0.4, 0.3, 0.3], 200)
    n = draw.integers(1, 500, 200)
    members = spark.createDataFrame([(i, int(n[i]), *(float(x) for x in p[i])) for i in range(200)], "id bigint, n_tokens bigint, p0 double, p1 double, p2 double")
    shares = np.array([0.7, 0.1, 0.2])
    for most in (None, 1.0):
        rated = mixing.fit_rates(Tables(spark, "test-mixing"), members, list(shares), pull=0.2, most=most)
        got = np.array([r.rate for r in rated.orderBy("id").collect()])
        want = solve(n, p, shares, n.sum(), 0.2, most or np.inf)
        assert np.abs(got - want).max() < 0.02
        assert got.min() >= 0


def least_squares(n, p, shares, budget, pull, most):
    """Accelerated projected steps, restarted when they turn back, until nothing moves."""
    weight = n / budget
    there = weight @ p
    size = 1 / (len(shares) + pull)
    r, z, t = np.ones(len(n)), np.ones(len(n)), 1.0
    for _ in range(200000):
        new = np.clip(z - size * (p @ (((weight * z) @ p - shares) / there) + pull * (z - 1)), 0, most)
        if ((z - new) * (new - r) * weight).sum() > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, moved = new + (t - 1) / after * (new - r), np.abs(new - r).max()
        r, t = new, after
        if moved < 1e-13:
            break
    return r


def test_overlapping_posteriors_reach_the_least_squares_solution(spark):
    """The pull and the targets of the pipeline, with posteriors that no domain has for itself."""
    draw = np.random.default_rng(4)
    logits = draw.normal(0, 1.2, (400, 3)) + np.log([0.6, 0.3, 0.1])
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    n = draw.integers(1, 500, 400)
    members = spark.createDataFrame([(i, int(n[i]), *(float(x) for x in p[i])) for i in range(400)], "id bigint, n_tokens bigint, p0 double, p1 double, p2 double")
    shares = np.array(list(TARGETS.values()))
    for most in (None, 1.0):
        rated = mixing.fit_rates(Tables(spark, "test-overlap"), members, list(shares), most=most)
        got = np.array([r.rate for r in rated.orderBy("id").collect()])
        want = least_squares(n, p, shares, n.sum(), 0.001, most or np.inf)
        assert np.abs(got - want).max() < 1e-3
        assert np.allclose((got * n) @ p, (want * n) @ p, rtol=1e-4, atol=0)


def test_targets_are_met_and_classifier_generalizes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    out = mixing.mix(docs, labels.where("doc_id % 3 <> 0"), TARGETS).toPandas()
    assert len(out) == docs.select("doc_id").distinct().count()
    total = out.n_tokens.sum()
    for domain, share in TARGETS.items():
        assert abs((out.rate * out.n_tokens * out[f"p_{domain}"]).sum() / total - share) < 0.01
    assert (abs(out.p_clean + out.p_low + out.p_toxic - 1) < 1e-9).all()
    held = out.merge(labels.where("doc_id % 3 = 0").toPandas(), on="doc_id")
    guess = held[[f"p_{d}" for d in TARGETS]].to_numpy().argmax(1)
    assert (np.array(list(TARGETS))[guess] == held.domain).mean() > 0.85
    assert set(out.copies - np.floor(out.rate)) <= {0, 1}


def test_no_python_runs_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    weights, prior = mixing.fit_domains(docs, labels, list(TARGETS))
    for frame in (weights, mixing.posteriors(docs, weights, prior)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, p string, mark string"
    docs = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b"), (None, "x y", "a", "b"), (None, "z", None, None), (3, "w " * 50000, "a", "b"), (4, "q", "a", "b"), (4, "q r", "a", "b")], schema)
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, 0), (4, 1, 0), (None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")
    out = mixing.mix(docs, mixing.label_domains(labels), TARGETS)
    got = {r.doc_id: r for r in out.collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {1: 0, 2: 0, None: 3, 3: 50000, 4: 3}
    back = mixing.resample(docs, out.withColumn("copies", F.when(F.col("doc_id") == 4, 2).otherwise(1)))
    assert back.columns == docs.columns and back.count() == 9
    empty = mixing.mix(docs.limit(0), mixing.label_domains(labels), TARGETS)
    assert empty.collect() == [] and mixing.resample(docs.limit(0), empty).collect() == []
    assert mixing.mix(docs, mixing.label_domains(labels.limit(0)), TARGETS).count() == 5


def test_names_of_further_columns_do_not_matter(spark):
    names = ["domain", "known", "_known", "copies", "_copies", "copy", "_copy", "mixed_id", "_mixed_id", "c0", "c1", "id", "n_tokens", "rate", "w", "at", "n"]
    rows = [(i, "good words here " * (i % 5) if i % 2 else f"bad {i} stuff", *names) for i in range(40)]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    wide = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = mixing.label_domains(spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int"))
    mixed = mixing.mix(wide, labels, TARGETS)
    assert sorted(mixed.collect()) == sorted(mixing.mix(plain, labels, TARGETS).collect())
    back = mixing.resample(wide, mixed)
    assert back.columns == wide.columns
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in mixing.resample(plain, mixed).collect())


def test_the_sample_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    found = [sorted(mixing.fit_domains(docs.repartition(n), labels.repartition(n), list(TARGETS), labelled_rows=100)[0].collect()) for n in (1, 7)]
    assert found[0] == found[1]


def test_inexact_sums_do_not_shorten_the_last_steps():
    """Sums that differ in their last digits from look to look: a step is one look, but for a few."""
    draw = np.random.default_rng(0)
    parts = draw.dirichlet((0.9, 0.1, 0.2), 4000)
    shares, soft, looks = np.array([0.97, 0.01, 0.02]), parts.mean(0), []

    def look(prices):
        looks.append(prices)
        free = 1 - parts @ prices / 0.001
        rate = np.maximum(0, free)
        value = 0.001 * (rate * (rate / 2 - free)).mean() - prices @ shares - prices @ (soft * prices) / 2
        return value + 2e-12 * draw.standard_normal(), (parts * rate[:, None]).mean(0) - shares - soft * prices

    near = 1e-8 * shares
    prices = mixing._settled(look, np.diag(1 / (soft * 1001)), near, 200)
    assert len(looks) <= 25
    assert (np.abs(look(prices)[1]) <= near).all()
