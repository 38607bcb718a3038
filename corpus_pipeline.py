"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, cotraining, minhash, mixing, pii
from ledgerline.llm.common import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TARGETS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together hold for good; the others go."""
    model = cotraining.train(docs, _labels(spark, sf_dir))
    return cotraining.keep_good(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the least id; documents without words stay."""
    return minhash.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    changed = pii.redact(docs.select(*COLUMNS), pii.train(docs))
    return changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their rates, each at most once.

    The token budget is all that is there, so good documents, of which there are
    too few for their share, keep a rate of one.
    """
    mixed = mixing.mix(docs, mixing.label_domains(_labels(spark, sf_dir)), TARGETS, most=1.0)
    return mixing.resample(docs, mixed).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with their digest and that of the text decoded from them."""
    return bpe.encode_with_digests(docs, VOCABULARY, public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: Trained models and character positions are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, started from the documents table."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = tables.save(f"stage-{number}", stage(spark, docs, sf_dir))
        if number:
            tables.drop(f"stage-{number - 1}")
    return docs
