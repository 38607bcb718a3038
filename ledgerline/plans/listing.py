"""Listings, pages and lookups. A limit here is part of what is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ledgerline.functions import diff as D
from ledgerline.functions import text as T
from ledgerline.operators import ordered
from ledgerline.session import shared_path


def _size(limit: int | None, most: int | None) -> int:
    size = max(1, 100 if limit is None else limit)
    return size if most is None else min(size, most)


def newest(
    df: DataFrame,
    order: list[str],
    limit: int | None = None,
    most: int | None = None,
    **equal: object,
) -> DataFrame:
    """The newest `limit` rows (100) that match the given column values; `most` bounds the limit."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(_size(limit, most))


def round_robin(df: DataFrame, source: str, order: list[str], limit: int) -> DataFrame:
    """`limit` rows, the newest first, with the sources taking turns.

    Every source is asked: no source can put more than `limit` rows into the
    listing, so Spark keeps that many of each before the shuffle, and a
    distributed top-k leaves `limit` rows for the numbering.
    """
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*[F.col(c).desc() for c in order]))
    newest = df.groupBy(source).agg(F.max(F.struct(*order)).alias("_newest"))
    turns = df.withColumn("_turn", turn).filter(F.col("_turn") <= limit).join(newest, source)
    top = turns.orderBy("_turn", F.col("_newest").desc()).limit(limit)
    shown = F.row_number().over(Window.orderBy("_turn", F.col("_newest").desc()))
    return top.withColumn("shown", shown).drop("_turn", "_newest")


def page(df: DataFrame, order: list[str], offset: int, limit: int, most: int | None = None) -> DataFrame:
    """Rows `offset` to `offset + limit` with the total and the next offset.

    Spark keeps `offset + limit` rows per task and never sorts the whole table.
    """
    start, size = max(0, offset), _size(limit, most)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = df.orderBy(*order).offset(start).limit(size).withColumn("total", total)
    after = F.lit(start + size)
    return rows.withColumn("next_offset", F.when(after < F.col("total"), after))


class Pages:
    """A table kept in order, so that any page of it is read from the parts that hold it.

    The rows are range-sorted by `order` (names; nulls first) and written, one
    folder per part. The index has one row per part: its rows, and its first and
    last place in the order. A page at any offset reads the parts that the counts
    name, usually one; a page after a cursor those whose last row is beyond it.
    Rows that agree in `order` must agree altogether or their order is free.
    """

    def __init__(self, df: DataFrame, order: list[str], parts: int | None = None):
        spark = df.sparkSession
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.order, self.schema, self.path, self.spark = order, df.schema, shared_path(spark, "pages"), spark
        dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
        dealt.sortWithinPartitions(*order).write.partitionBy("_part").parquet(self.path)
        place = F.struct(*order)
        kept = spark.read.schema(dealt.schema).parquet(self.path).groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.max(place).alias("last"))
        self.index = sorted(kept.collect(), key=lambda row: row["_part"])
        self.total = sum(row["rows"] for row in self.index)

    def _read(self, parts: list[int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/_part={part}" for part in parts])

    def page(self, offset: int, limit: int | None = None, most: int | None = None) -> DataFrame:
        """As `page`: rows `offset` to `offset + limit` with the total and the next offset."""
        start, size = max(0, offset), _size(limit, most)
        chosen, before, skipped = [], 0, None
        for row in self.index:
            if before + row["rows"] > start and before < start + size:
                skipped = before if skipped is None else skipped
                chosen.append(row["_part"])
            before += row["rows"]
        rows = self._read(chosen).orderBy(*self.order).offset(start - (skipped or 0)).limit(size)
        after = start + size
        return rows.withColumns({"total": F.lit(self.total).cast("long"), "next_offset": F.lit(after if after < self.total else None).cast("int")})

    def after(self, cursor: tuple, limit: int | None = None, most: int | None = None) -> DataFrame:
        """The first rows beyond `cursor`, the order's values of the last row seen; needs no offset."""
        size = _size(limit, most)
        at = F.struct(*[F.lit(value).cast(self.schema[name].dataType).alias(name) for name, value in zip(self.order, cursor)])
        beyond = self.spark.createDataFrame([(row["_part"], row["last"], row["rows"]) for row in self.index], _index_schema(self.schema, self.order))
        chosen, held = [], 0
        # One row per part.
        for row in beyond.filter(F.col("last") > at).orderBy("part").collect():
            chosen.append(row["part"])
            held += row["rows"] if len(chosen) > 1 else 0
            if held >= size:
                break
        return self._read(chosen).filter(F.struct(*self.order) > at).orderBy(*self.order).limit(size)


def _index_schema(schema: Ty.StructType, order: list[str]) -> Ty.StructType:
    last = Ty.StructType([schema[name] for name in order])
    return Ty.StructType().add("part", Ty.LongType()).add("last", last).add("rows", Ty.LongType())


def by_id(df: DataFrame, column: str, value: object) -> DataFrame:
    """Point lookup; the predicate reaches the Parquet scan."""
    return df.filter(F.col(column) == value)


def timeline(actions: DataFrame, sponsors: DataFrame, amendments: DataFrame) -> DataFrame:
    """Actions newest first, sponsors by role and name, amendments newest first, per bill."""
    rows = [
        actions.select("bill_id", F.lit("action").alias("entry"), F.col("action_date").alias("label"),
                       F.col("text").alias("detail"),
                       (-F.unix_date(T.iso_date(F.col("action_date")))).cast("long").alias("a"),
                       F.lit("").alias("b"), (-F.col("action_id")).alias("c")),
        sponsors.select("bill_id", F.lit("sponsor"), F.col("full_name"), F.col("role"),
                        F.lit(0).cast("long"), F.concat("role", F.lit("|"), "full_name"), F.col("seq")),
        amendments.select("bill_id", F.lit("amendment"), F.col("amendment_date"), F.col("search_text"),
                          F.lit(0).cast("long"), F.lit(""), -F.col("amendment_id")),
    ]
    union = rows[0]
    for part in rows[1:]:
        union = union.union(part)
    return ordered.positions(union, ["bill_id", "entry"], ["a", "b", "c"], "place").drop("a", "b", "c")


def latest_pairs(versions: DataFrame) -> DataFrame:
    """The two newest versions of each bill that has two; undated ones count as newest."""
    undated = F.col("issued_on").isNull()
    lean = ordered.first_rows(
        versions.select("bill_id", "version_id", "version_code", "issued_on").withColumn("_u", undated),
        ["bill_id"],
        [F.col("_u").desc(), F.col("issued_on").desc(), F.col("version_id").desc()],
        2,
    )
    at = F.struct(F.col("_u"), F.col("issued_on"), F.col("version_id"))
    return (
        lean.groupBy("bill_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by(F.struct("version_id", "version_code"), at).alias("new"),
            F.min_by(F.struct("version_id", "version_code"), at).alias("old"),
        )
        .filter("n = 2")
        .select(
            "bill_id",
            F.col("old.version_id").alias("old_id"), F.col("old.version_code").alias("old_code"),
            F.col("new.version_id").alias("new_id"), F.col("new.version_code").alias("new_code"),
        )
    )


def latest_diff(versions: DataFrame, most: int | None = None) -> DataFrame:
    """Line summary and unified diff of the two newest versions of each bill; `most` cuts the diff."""
    pair, texts = latest_pairs(versions), versions.select("version_id", "text")
    whole = D.unified_diff("old_text", "new_text", "old_code", "new_code")
    return (
        pair.join(texts.select(F.col("version_id").alias("old_id"), F.col("text").alias("old_text")), "old_id")
        .join(texts.select(F.col("version_id").alias("new_id"), F.col("text").alias("new_text")), "new_id")
        .withColumn("change", D.line_change("old_text", "new_text"))
        .withColumn("diff", whole if most is None else F.substring(whole, 1, most))
        .select("bill_id", "old_id", "old_code", "new_id", "new_code", "change.*", "diff")
    )
