"""Tables written between steps, settings for the time of a step, and byte-level helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerline import session

STEP = {
    # Files of a finished step's exchanges go at once; its table stays.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Texts can be long: few rows at a time reach a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed for the time of a step."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Tables:
    """Parquet tables of one run below the folder in spark.checkpoint.dir.

    A step that fails is repeated from the table before it, not from the input.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = session.shared_path(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame, by: str | None = None, **conf: str) -> DataFrame:
        """`df`, written and read again; `by` names a partition column."""
        with settings(self.spark, {**STEP, **conf}):
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Tables that no later step reads give their space back."""
        empty = self.spark.range(0).select("id")
        for name in names:
            empty.write.mode("overwrite").parquet(self.path(name))


ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
    "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema of plain columns."""
    return pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in T.StructType.fromDDL(schema)])


def arrow_map(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """`make` turns each batch into the columns named in `schema`."""
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            columns = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in ((f, made[f.name]) for f in fields)]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


#: White space between words: the blank and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Base of the positional hash, an odd number, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the base and its inverse, kept as long as the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums whose differences, shifted back, identify any stretch of bytes."""
    up, _ = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from `start` up to `end`; equal bytes, equal hash."""
    _, down = POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of `data`."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(text: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word."""
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = LOWER[data]
    start, end = word_bounds(data)
    return stretch_hash(prefix_hash(data), start, end), start, end


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + words[k : k + n]
    return mix(total)
