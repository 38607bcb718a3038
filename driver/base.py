"""Registry of the driver queries and access to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ledgerline import session
from ledgerline.sources import tables

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query under `name`; `oracle` is its SQL on the same tables."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts; small input of few row groups is spread over all cores."""
    return tables.spread_small(table(spark, sf_dir, name))


def view(spark: SparkSession, sf_dir: str, sql: str, orders: DataFrame | None = None, slow: str | None = None) -> DataFrame:
    """A SELECT over the given tables; its wording is valid in both engines.

    `orders` (l_orderkey) names the orders whose line items are asked for: the
    others are left out before they meet other tables. `slow` names a table whose
    rows are slow to work on; it is spread over all cores before they are.
    """
    for name in TABLES:
        if f"{name} " in sql.replace("\n", " ") + " ":
            rows = table(spark, sf_dir, name)
            if name == "lineitem":
                if orders is not None:
                    rows = rows.join(orders, "l_orderkey", "left_semi")
                # Joins and windows over line items all use the order key.
                rows = session.spread(rows, "l_orderkey")
            if name == slow:
                rows = tables.spread_small(rows)
            rows.createOrReplaceTempView(name)
    return spark.sql(sql)


_STORED: dict[tuple, object] = {}


def _still_there(spark: SparkSession, made) -> bool:
    """Whether the first file behind each frame can still be found."""
    frames = made.values() if isinstance(made, dict) else [made]
    try:
        for frame in frames:
            for file in frame.inputFiles()[:1]:
                spark.read.format("binaryFile").load(file)
    except AnalysisException:
        return False
    return True


def stored(build: Callable) -> Callable:
    """What `build` (spark, sf_dir) makes is written once in a session and read by every query; it is made anew where its files are gone."""

    def once(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, build.__module__, build.__name__)
        if key not in _STORED or not _still_there(spark, _STORED[key]):
            _STORED[key] = build(spark, sf_dir)
        return _STORED[key]

    return once
