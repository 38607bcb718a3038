"""Pairs of texts that are alike by the ratio of their matching characters.

The ratio is 2 * M / T: M characters in matching blocks, T characters together.
Only bounds that cannot lose a pair come before it: lengths, characters in
common, and triples in common. With U = T - 2 * M unmatched characters there are
at most U + 1 blocks, and a block of n characters holds n - 2 triples, so texts
share at least M - 2 * (U + 1) of them.
"""

from __future__ import annotations

import difflib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline import session

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts and characters of a block; one longer text is a block of its own.
BLOCK_TEXTS, BLOCK_CHARS = 64, 1 << 18
#: Rows of two blocks reach a task few at a time.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}


class _Profile:
    """What the bounds need to know of a text."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.letters = np.bincount((codes % np.uint64(256)).astype(np.int64), minlength=256)
        triples = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:] if len(codes) > 2 else codes[:0]
        self.triples, self.times = np.unique(triples, return_counts=True)

    def may_reach(self, other: _Profile, floor: float) -> bool:
        total = len(self.text) + len(other.text)
        if 2 * min(len(self.text), len(other.text)) < floor * total:
            return False
        if 2 * int(np.minimum(self.letters, other.letters).sum()) < floor * total:
            return False
        _, mine, theirs = np.intersect1d(self.triples, other.triples, assume_unique=True, return_indices=True)
        shared = int(np.minimum(self.times[mine], other.times[theirs]).sum())
        return 2 * (shared + 2 * total + 2) >= 5 * floor * total


def ratios(old: list[str], new: list[str], floor: float) -> Iterator[tuple[int, int, float]]:
    """Places and ratio of each pair whose ratio is at least `floor`."""
    before, after = [_Profile(t) for t in old], [_Profile(t) for t in new]
    matcher = difflib.SequenceMatcher(None)
    for j, b in enumerate(after):
        matcher.set_seq2(b.text)
        for i, a in enumerate(before):
            if a.text == b.text:
                yield i, j, 1.0
            elif a.may_reach(b, floor):
                matcher.set_seq1(a.text)
                ratio = matcher.ratio()
                if ratio >= floor:
                    yield i, j, ratio


def _blocks(texts: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Texts of a key in blocks of like length."""
    upto = Window.partitionBy(*keys).orderBy("size", "sha")
    number = F.floor(F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)) / BLOCK_CHARS + F.row_number().over(upto) / BLOCK_TEXTS)
    sized = texts.withColumn("size", F.length("text")).withColumn("block", number)
    return sized.groupBy(*keys, F.col("block").alias(f"{side}_block")).agg(
        F.min("size").alias(f"{side}_least"), F.max("size").alias(f"{side}_most"),
        F.collect_list("sha").alias(f"{side}_shas"), F.collect_list("text").alias(f"{side}_texts"),
    )


def alike_pairs(old: DataFrame, new: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """`keys`, old_sha, new_sha, ratio: all pairs of texts of a key that are at least `floor` alike.

    old, new: `keys`, sha, text; one row per key and sha. Both sides come in
    blocks ordered by length; blocks meet where their lengths allow the ratio,
    and every meeting is one row, so a key with very many texts is compared in
    many tasks of bounded size.
    """
    least = floor / (2 - floor)
    left, right = _blocks(old, keys, "old"), _blocks(new, keys, "new")
    met = left.join(right, keys).filter((F.col("old_least") * least <= F.col("new_most")) & (F.col("new_least") * least <= F.col("old_most")))
    rows = session.spread(met, *keys, "old_block", "new_block").select(*keys, "old_shas", "old_texts", "new_shas", "new_texts")
    schema = old.select(*keys, F.col("sha").alias("old_sha"), F.col("sha").alias("new_sha"), F.lit(0.0).alias("ratio")).schema
    n = len(keys)
    shas = to_arrow_schema(schema).field("old_sha").type

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                old_shas, old_texts, new_shas, new_texts = row[n:]
                found = list(ratios(old_texts, new_texts, floor))
                columns = [pa.array([value] * len(found), batch.schema.field(k).type) for k, value in enumerate(row[:n])]
                columns += [pa.array([old_shas[i] for i, _, _ in found], shas), pa.array([new_shas[j] for _, j, _ in found], shas)]
                columns.append(pa.array([r for *_, r in found], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n], "old_sha", "new_sha", "ratio"])

    return session.checkpointed(rows.mapInArrow(score, schema), **FEW)


def first_choices(old: DataFrame, new: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, old_number, new_number, similarity: each old number, in order, takes the closest free new one.

    old, new: `keys`, number, sha; one row per number. pairs: as `alike_pairs`
    makes them. Of equally close ones the least number is taken. The choice
    depends on the order, so a key's pairs pass through one task as a sorted
    stream of numbers and hashes; it remembers the new numbers of the key, no
    pairs and no texts.
    """
    n = len(keys)
    offers = new.join(pairs.select(*keys, F.col("new_sha").alias("sha")).distinct(), [*keys, "sha"]).select(*keys, F.lit(0).alias("kind"), "number", "sha", F.lit(0.0).alias("ratio"))
    asked = old.withColumnRenamed("sha", "old_sha").join(pairs, [*keys, "old_sha"]).select(*keys, F.lit(1).alias("kind"), "number", F.col("new_sha").alias("sha"), "ratio")
    rows = offers.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "number", F.desc("ratio"), "sha")
    numbers = F.lit("").alias("old_number"), F.lit("").alias("new_number"), F.lit(0.0).alias("similarity")
    schema = old.select(*keys, *numbers).schema
    target = to_arrow_schema(schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free, asking, best = None, {}, None, None

        def settled() -> list[tuple]:
            """What the number that asked last takes: the least free number among the closest texts."""
            if best is None:
                return []
            ratio, _, sha = best
            return [(*key, asking, free[sha].pop(), round(ratio, 4))]

        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                own, (kind, number, sha, ratio) = row[:n], row[n:]
                if own != key or kind == 0 or number != asking:
                    out += settled()
                    best = None
                    if own != key:
                        key, free, asking = own, {}, None
                if kind == 0:
                    free.setdefault(sha, []).append(number)
                    continue
                if asking is None:  # offers are complete: the least number is taken first
                    for offered in free.values():
                        offered.reverse()
                asking = number
                if free.get(sha) and (best is None or ratio == best[0] and free[sha][-1] < best[1]):
                    best = (ratio, free[sha][-1], sha)
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in out], schema=target)
        yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in settled()], schema=target)

    return rows.mapInArrow(choose, schema)
