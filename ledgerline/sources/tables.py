"""Reading and writing the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_small(df: DataFrame) -> DataFrame:
    """Scanned rows over all cores if the input has too few files to fill them.

    Input of at least one file per core is left as it was read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def as_json(df: DataFrame, keys: list[str], name: str = "document") -> DataFrame:
    """Key columns and everything else as one JSON text per row, NULL fields kept."""
    rest = [F.col(c) for c in df.columns if c not in keys]
    options = {"ignoreNullFields": "false"}
    return df.select(*keys, F.to_json(F.struct(*rest), options).alias(name))
