"""Windows that survive a hot key.

A plain window sorts all rows of a key in one task. Here the rows of keys with
more than `rows_per_task` rows are range-partitioned by the key and the whole
order, so a slice is a stretch of the order whatever its columns are; every slice
is a window of its own and the slices are stitched by one small row per slice.
Keys below the bound, found by a count over the key columns only, use the plain
window. Results are the same either way; only ties of the whole order are free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import checkpointed

ROWS_PER_TASK = 2_000_000


def _hot_keys(df: DataFrame, keys: list[str], rows_per_task: int) -> tuple[DataFrame, int] | None:
    """Keys above the bound and the number of slices that bring all of them below it."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpointed(counts.filter(F.col("_n") > rows_per_task))
    rows = hot.agg(F.sum("_n")).first()[0]
    return None if rows is None else (hot.drop("_n"), -(-2 * rows // rows_per_task))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _sliced(df: DataFrame, keys: list[str], hot: tuple[DataFrame, int], order: list[Column]) -> DataFrame:
    """Rows with a slice number that ascends with the order of their key.

    Slices are the partitions of a range sort. They are written, since a number
    taken from a partition must not change when a task is repeated.
    """
    known, slices = hot
    many = df.join(known, _same(df, known, keys), "left_semi").repartitionByRange(slices, *[F.col(k).asc_nulls_first() for k in keys], *order)
    few = df.join(known, _same(df, known, keys), "left_anti").withColumn("_slice", F.lit(0))
    return checkpointed(many.withColumn("_slice", F.spark_partition_id())).unionByName(few)


def _stitch(rows: DataFrame, per_slice: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, "_slice"]
    renamed = per_slice.select(
        *[F.col(n).alias(f"_s_{n}") for n in names],
        *[c for c in per_slice.columns if c not in names],
    )
    condition = F.lit(True)
    for name in names:
        condition = condition & rows[name].eqNullSafe(renamed[f"_s_{name}"])
    return rows.join(renamed, condition, "left").drop(*[f"_s_{n}" for n in names])


def positions(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    name: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """1-based place of each row within its key; `order` holds names and orderings."""
    by_order = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    hot = _hot_keys(df, keys, rows_per_task)
    if hot is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by_order)))
    rows = _sliced(df, keys, hot, by_order)
    local = Window.partitionBy(*keys, "_slice").orderBy(*by_order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_skip", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    placed = _stitch(rows.withColumn("_at", F.row_number().over(local)), offsets, keys)
    return placed.withColumn(name, (F.col("_at") + F.col("_skip")).cast("int")).drop(
        "_at", "_skip", "_slice"
    )


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds, for each new name, the value its column had one row earlier."""
    by_order = [F.col(c).asc() for c in order]
    hot = _hot_keys(df, keys, rows_per_task)
    if hot is None:
        whole = Window.partitionBy(*keys).orderBy(*by_order)
        return df.withColumns({new: F.lag(old).over(whole) for new, old in columns.items()})
    rows = _sliced(df, keys, hot, by_order)
    local = Window.partitionBy(*keys, "_slice").orderBy(*by_order)
    across = Window.partitionBy(*keys).orderBy("_slice")
    kept = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    tails = (
        rows.groupBy(*keys, "_slice")
        .agg(F.max_by(kept, F.struct(*order)).alias("_tail"))
        .withColumn("_tail", F.lag("_tail").over(across))
    )
    marked = rows.withColumns(
        {"_at": F.row_number().over(local), "_lag": F.lag(kept).over(local)}
    )
    stitched = _stitch(marked, tails, keys)
    value = F.when(F.col("_at") == 1, F.col("_tail")).otherwise(F.col("_lag"))
    return (
        stitched.withColumn("_value", value)
        .withColumns({new: F.col("_value")[new] for new in columns})
        .drop("_at", "_lag", "_tail", "_value", "_slice")
    )


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    column: str,
    name: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds the latest non-NULL value of `column` up to and including each row."""
    by_order = [F.col(c).asc() for c in order]
    hot = _hot_keys(df, keys, rows_per_task)
    if hot is None:
        upto = Window.partitionBy(*keys).orderBy(*by_order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(column, ignorenulls=True).over(upto))
    rows = _sliced(df, keys, hot, by_order)
    local = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*by_order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col(column).isNotNull(), F.struct(*order))
    tails = (
        rows.groupBy(*keys, "_slice")
        .agg(F.max_by(column, place).alias("_tail"))
        .withColumn("_tail", F.last("_tail", ignorenulls=True).over(before))
    )
    carried = rows.withColumn("_here", F.last(column, ignorenulls=True).over(local))
    return (
        _stitch(carried, tails, keys)
        .withColumn(name, F.coalesce("_here", "_tail"))
        .drop("_here", "_tail", "_slice")
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column], count: int = 1) -> DataFrame:
    """The first `count` rows of each key.

    The rank filter lets Spark cut every key to `count` rows before the shuffle,
    so a hot key sends at most `count` rows per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")

