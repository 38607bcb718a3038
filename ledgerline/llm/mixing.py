"""Mixing by soft membership, with DataFrame functions only.

A classifier fitted on a labelled table gives every document a probability for
each domain. Document rates r >= 0 then solve a least-squares problem: the
expected tokens of domain d, the sum of r * tokens * p(d), shall be the target
share of the budget, and rates shall stay near 1. Errors are weighted by the
domain's own tokens, so small domains count.

The rates are fitted by projected gradient steps. A step takes the objective and
the D totals of the present rates, one aggregate of the whole table, and moves one
price for each domain along the gradient; the rates follow by projection, 1 -
(probabilities . prices) / pull cut at the bounds. So a step's expression does
not grow with the number of steps, and nothing but D + 1 numbers leaves the
executors. The gradient is scaled, at first by the domains' own tokens and then
by what the steps so far have shown of its change (a D x D matrix with BFGS
updates, no second derivatives); a step that does not gain enough is shortened.
Steps go on until the totals agree with the prices.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Tables

#: What sums in another order may differ by, relative to the objective.
NOISE = 1e-11
SPACES = "[\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _marks(words: Column) -> Column:
    """What the classifier sees: distinct words, and distinct word ends."""
    distinct = F.array_distinct(words)
    ends = F.array_distinct(F.transform(distinct, lambda w: F.concat(F.lit("\u0001"), F.right(w, F.lit(2)))))
    return F.concat(distinct, ends)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = 20000, vocabulary: int = 2000) -> tuple[DataFrame, list[float]]:
    """(mark, w array<double>) of the most telling marks, and the log prior of each domain.

    `labelled` has (id, domain). Weights are logarithms of how much likelier a
    mark is in a domain than overall, by documents and smoothed. At most
    `labelled_rows` labelled documents are read; this bounds the training set only.
    """
    known = labelled.where(F.col("domain").isin(domains)).select(F.col(id_col).alias("known"), "domain").groupBy("known").agg(F.min("domain").alias("domain"))
    # The least hashes: the same rows however the table is dealt.
    picked = known.orderBy(F.xxhash64("known"), "known").limit(labelled_rows)
    own = docs.select(F.col(id_col).alias("known"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(picked), "known").select("domain", "text")
    sizes = {r.domain: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    whole = sum(sizes.values())
    prior = [math.log((sizes.get(d, 0) + 1) / (whole + len(domains))) for d in domains]
    counts = texts.select("domain", F.explode(_marks(_words(F.col("text")))).alias("mark")).groupBy("mark")
    counts = counts.agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)))
    overall = (F.col("n") + 1) / F.lit(float(whole + 2))
    weights = [F.log((F.col(f"n{i}") + overall * 2) / (sizes.get(d, 0) + 2.0) / overall) for i, d in enumerate(domains)]
    telling = sum((F.col(f"n{i}") * w for i, w in enumerate(weights)), F.lit(0.0))
    found = counts.where("n >= 5").select("mark", F.array(*weights).alias("w"), telling.alias("telling"))
    return found.orderBy(F.desc("telling"), "mark").limit(vocabulary).select("mark", "w"), prior


def posteriors(docs: DataFrame, weights: DataFrame, prior: list[float], id_col: str = "doc_id", text_col: str = "text", firmness: float = 8.0) -> DataFrame:
    """(id, n_tokens, p0, p1, ...): tokens are words, the probabilities sum to 1.

    Beyond `firmness` known marks further ones sharpen p no more, so long texts
    are not surer than their marks allow. A text without words has the prior.
    Rows that repeat an id are one document, as are rows without id.
    """
    count = len(prior)
    words = docs.select(F.col(id_col).alias("id"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    marks = words.select("id", F.size("words").cast("bigint").alias("n"), F.posexplode_outer(_marks(F.col("words"))).alias("at", "mark"))
    # The weights are bounded by the vocabulary parameter.
    scored = marks.join(F.broadcast(weights), "mark", "left").groupBy("id")
    scored = scored.agg(
        F.sum(F.when(F.col("at") == 0, F.col("n")).otherwise(0)).alias("n_tokens"), F.count("w").alias("hits"), *(F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(count))
    )
    soft = F.least(F.lit(1.0), firmness / F.greatest(F.col("hits"), F.lit(1)))
    logits = scored.select("id", "n_tokens", *((F.lit(prior[i]) + soft * F.coalesce(f"s{i}", F.lit(0.0))).alias(f"l{i}") for i in range(count)))
    top = F.greatest(*(F.col(f"l{i}") for i in range(count))) if count > 1 else F.col("l0")
    powers = logits.select("id", "n_tokens", *(F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in range(count)))
    total = sum((F.col(f"e{i}") for i in range(count)), F.lit(0.0))
    return powers.select("id", "n_tokens", *((F.col(f"e{i}") / total).alias(f"p{i}") for i in range(count)))


def fit_rates(tables: Tables, members: DataFrame, shares: list[float], budget: float | None = None, pull: float = 0.001, most: float | None = None, steps: int = 200, close: float = 1e-8) -> DataFrame:
    """`members` (id, n_tokens, p0, p1, ...) with a column rate, fitted on all of them.

    `shares` are the targets, `budget` the wanted number of tokens (None: as
    many as there are), `pull` the weight that keeps rates near 1, `most` an
    upper bound. No tokens give a rate of 1. Prices are settled when no total
    differs from what they ask for by more than `close` of the target; if they
    are not after `steps` steps, that is an error.
    """
    shares = [float(s) for s in shares]
    domains = range(len(shares))
    part = [F.col(f"p{i}") * F.col("n_tokens") for i in domains]
    sums = members.agg(F.sum("n_tokens"), *(F.sum(x) for x in part)).first()
    budget = float(budget or sums[0] or 0)
    if not budget:
        return members.withColumn("rate", F.lit(1.0))
    soft = np.array([max((sums[1 + i] or 0.0) / budget, 1e-9) for i in domains])
    target = np.array(shares)

    def rates(prices: np.ndarray) -> tuple[Column, Column]:
        free = F.lit(1.0) - sum((F.col(f"p{i}") * F.lit(float(prices[i] / pull)) for i in domains), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), free)
        return free, rate if most is None else F.least(F.lit(float(most)), rate)

    def look(prices: np.ndarray) -> tuple[float, np.ndarray]:
        """The dual objective, and its gradient: each total less its target and what its price asks for."""
        free, rate = rates(prices)
        # The least of a row's pull and price, less what a rate of 0 has.
        cost = F.col("n_tokens") * F.col("rate") * (F.col("rate") / 2 - F.col("free"))
        row = members.select("*", free.alias("free"), rate.alias("rate")).agg(F.sum(cost), *(F.sum(F.col("rate") * x) for x in part)).first()
        found = np.array([float(x or 0) / budget for x in row])
        return float(pull * found[0] - prices @ target - prices @ (soft * prices) / 2), found[1:] - target - soft * prices

    # Sums are exact to some 1e-12 only.
    near = max(close, 1e-12) * np.maximum(target, 1e-6)
    # The totals answer to the prices by at most this much.
    metric = np.diag(1 / (soft * (1 + 1 / pull)))
    prices = _settled(look, metric, near, steps)
    return members.select("*", rates(prices)[1].alias("rate"))


def _settled(look: Callable, metric: np.ndarray, near: np.ndarray, steps: int) -> np.ndarray:
    """The prices at which the slope is `near` zero; `look` gives the concave objective and its slope.

    Close to the end a step gains less than the sums are exact to. There the
    slope along the step tells whether it went too far: its size has to fall.
    """
    prices = np.zeros(len(near))
    value, slope = look(prices)
    for _ in range(steps):
        if (np.abs(slope) <= near).all():
            return prices
        move, length = metric @ slope, 1.0
        gain, noise = slope @ move, NOISE * max(1.0, abs(value))

        def short(tried: tuple[float, np.ndarray], length: float) -> bool:
            rose = tried[0] >= value + 1e-4 * length * gain
            return not rose and (tried[0] < value - noise or abs(tried[1] @ move) > 0.9 * gain)

        tried = look(prices + move)
        while short(tried, length) and length > 1e-6:
            length /= 4
            tried = look(prices + length * move)
        moved, fell = length * move, slope - tried[1]
        prices, (value, slope) = prices + moved, tried
        bend = moved @ fell
        if bend > 0:
            keep = np.eye(len(near)) - np.outer(moved, fell) / bend
            metric = keep @ metric @ keep.T + np.outer(moved, moved) / bend
    raise RuntimeError(f"rates are not settled after {steps} steps: totals are off by {np.abs(slope).max():.3g}")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", most: float | None = None, budget: float | None = None) -> DataFrame:
    """(id, n_tokens, p_<domain> ..., rate, copies): one row per id.

    `copies` is the rate rounded up or down by a draw that depends on the id
    alone, so expected copies are the rate. Null ids are one document; empty
    texts have no tokens and the prior's rate. Domains without a labelled
    document get a small posterior. No rows give no rows.
    """
    domains = list(targets)
    tables = Tables(docs.sparkSession, "mixing")
    weights, prior = fit_domains(docs, labelled, domains, id_col, text_col)
    weights = tables.save("weights", weights)
    members = tables.save("members", posteriors(docs, weights, prior, id_col, text_col))
    rated = fit_rates(tables, members, [targets[d] for d in domains], budget, most=most)
    draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    return rated.select(
        F.col("id").alias(id_col), "n_tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies")
    )


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) from quality and toxicity labels: toxic, clean or low."""
    rows = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") >= 0.5, "clean").when(F.col("q").isNotNull(), "low")
    return rows.select(id_col, domain.alias("domain")).where("domain is not null")


def resample(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs`, each as often as `mixed` says; null ids meet null ids."""
    # Numbered columns: none of the input's names can clash with those used here.
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = f"c{docs.columns.index(id_col)}"
    copies = mixed.select(F.col(id_col).alias("mixed_id"), "copies").where("copies > 0")
    joined = numbered.join(copies, F.col(own).eqNullSafe(F.col("mixed_id")))
    drawn = joined.select(*numbered.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return drawn.toDF(*docs.columns)
