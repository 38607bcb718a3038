"""Nearest neighbours by collision counting over single projections.

Rows are dealt into shards of a few thousand vectors by a hash of the id. A
shard keeps one sorted array per random projection. A query opens a window round
its own projection in every array; a vector that is met in a threshold of the
windows is verified by its distance. At a half width equal to a radius, a vector
of that distance is met in a window with a probability of 0.683. With 352 windows
and a threshold of 1.64 standard deviations below the mean it is missed in 5 % of
the cases, one a tenth nearer in 0.01 %.

A pilot finds each query's radius: in the first shard, a hash sample of the
rows, all windows of a query are widened together (virtual rehashing: a wider
window is the bucket of a coarser hash, nothing is rebuilt) until the k-th
verified distance is within the radius the windows stand for. That distance
bounds the k-th distance over all rows, so the other shards open their windows
once, at that radius, and verify the few vectors that pass the threshold. Query
blocks meet shards, never queries rows; each meeting yields at most k rows per
query, and the best k over all shards remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Tables, arrow_schema

PROJECTIONS = 352
#: The probability that a window of half width r meets a vector of distance r, and the windows that have to.
MET = 0.6827
THRESHOLD = int(PROJECTIONS * MET - 1.64 * (PROJECTIONS * MET * (1 - MET)) ** 0.5)
#: Growth of the radius from step to step of the pilot.
GROWTH = 1.1


class Shard:
    """Vectors of a shard with one sorted array per projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.lines = np.random.default_rng(vectors.shape[1]).normal(size=(vectors.shape[1], PROJECTIONS))
        projected = self.vectors @ self.lines
        self.order = np.argsort(projected.T, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        self.verified = 0
        # What rounding may move a projection.
        self.slack = 1e-9 * (1 + np.abs(projected).max(initial=0))

    def _windows(self, near: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in every array."""
        low, high = (np.empty((len(near), PROJECTIONS), np.int64) for _ in range(2))
        for j in range(PROJECTIONS):
            low[:, j] = np.searchsorted(self.sorted[j], near[:, j] - reach - self.slack, "left")
            high[:, j] = np.searchsorted(self.sorted[j], near[:, j] + reach + self.slack, "right")
        return low, high

    def _count(self, *windows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How many of the windows (begin and end in every array) meet each vector."""
        places = [self.order[j, x:y] for low, high in windows for j, (x, y) in enumerate(zip(low.tolist(), high.tolist())) if x < y]
        return np.bincount(np.concatenate(places), minlength=len(self.ids)) if places else np.zeros(len(self.ids), np.int64)

    def _verify(self, query: np.ndarray, places: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of `best` and the vectors at `places`, ties to the smaller id."""
        self.verified += len(places)
        far = np.sqrt(((self.vectors[places] - query) ** 2).sum(axis=1))
        places, far = np.r_[best[0], places], np.r_[best[1], far]
        pick = np.lexsort((self.ids[places], far))[:k]
        return places[pick], far[pick]

    def first_radius(self, near: np.ndarray) -> np.ndarray:
        """For each query the radius whose windows hold a tenth of the shard, typically."""
        places = np.stack([np.searchsorted(self.sorted[j], near[:, j]) for j in range(PROJECTIONS)], axis=1)
        n, reach = len(self.ids), max(1, len(self.ids) // 20)
        lines = np.arange(PROJECTIONS)
        low = self.sorted[lines, np.clip(places - reach, 0, n - 1)]
        high = self.sorted[lines, np.clip(places + reach, 0, n - 1)]
        return np.maximum(np.median(np.maximum(near - low, high - near), axis=1), 1e-12)

    def radius(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query the k-th verified distance; infinite if the shard has fewer vectors."""
        queries = queries.astype(np.float64)
        near = queries @ self.lines
        radius, out = self.first_radius(near), np.full(len(ids), np.inf)
        met = np.zeros((len(ids), len(self.ids)), np.int64)
        # A vector is never its own neighbour: it counts as verified from the start.
        seen = self.ids[None, :] == ids[:, None]
        none = np.zeros(0, np.int64), np.zeros(0)
        best = [none for _ in ids]
        low = high = np.zeros((len(ids), PROJECTIONS), np.int64)
        running, fresh = np.arange(len(ids)), True
        while len(running):
            wide = self._windows(near[running], radius[running])
            going = []
            for i, q in enumerate(running):
                # Only what the wider windows add.
                met[q] += self._count((wide[0][i], wide[1][i])) if fresh else self._count((wide[0][i], low[i]), (high[i], wide[1][i]))
                more = np.flatnonzero((met[q] >= THRESHOLD) & ~seen[q])
                if len(more):
                    seen[q, more] = True
                    best[q] = self._verify(queries[q], more, best[q], k)
                if len(best[q][1]) == k and best[q][1][-1] <= radius[q]:
                    out[q] = best[q][1][-1]
                elif not seen[q].all():
                    going.append(i)
                elif len(best[q][1]) == k:
                    out[q] = best[q][1][-1]
            low, high = wide[0][going], wide[1][going]
            running, fresh = running[going], False
            radius[running] *= GROWTH
        return out

    def search(self, ids: np.ndarray, queries: np.ndarray, radius: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and distances of its k nearest within windows of its radius."""
        queries = queries.astype(np.float64)
        low, high = self._windows(queries @ self.lines, radius)
        found, none, whole = [], np.zeros(PROJECTIONS, np.int64), np.full(PROJECTIONS, len(self.ids))
        for q in range(len(ids)):
            if (high[q] - low[q]).sum() * 2 <= PROJECTIONS * len(self.ids):
                met = self._count((low[q], high[q]))
            else:  # wide windows: fewer places lie outside
                met = PROJECTIONS - self._count((none, low[q]), (high[q], whole))
            near = np.flatnonzero((met >= THRESHOLD) & (self.ids != ids[q]))
            found.append(self._verify(queries[q], near, (np.zeros(0, np.int64), np.zeros(0)), k))
        return found


PACKED = "dim int, part int, ids binary, vectors binary"


def _pack(rows: DataFrame, parts: int, tables: Tables, name: str) -> DataFrame:
    """One row per part: its ids and its vectors, end to end."""
    schema = arrow_schema(PACKED)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy(), kind="stable")
        vectors = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)
        values = [[key[0].as_py()], [key[1].as_py()], [group.column("id").to_numpy()[order].tobytes()], [vectors[order].tobytes()]]
        return pa.table([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    dealt = rows.withColumn("dim", F.size("v")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(31)), F.lit(parts)).cast("int"))
    return tables.save(name, dealt.groupBy("dim", "part").applyInArrow(pack, PACKED))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, block_rows: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by Euclidean distance.

    `queries` are rows of the same columns; a row is no neighbour of its own id.
    Vectors that are null, empty or zero or hold null or non-finite components
    take no part, nor do rows without id; vectors of another length are never
    compared. Of rows that repeat an id the one with the least vector counts, by
    its components in order. Fewer than k candidates: all of them. No rows or no
    queries give no rows. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "ann")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
        sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return rows.where(sound).groupBy("id").agg(F.min("v").alias("v"))

    rows, asked = usable(vectors), usable(queries)
    shards, blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-queries.count() // block_rows))
    packed = _pack(rows, shards, tables, "shards")
    asking = _pack(asked, blocks, tables, "blocks").withColumnsRenamed({"part": "block", "ids": "q_ids", "vectors": "q"})
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2"}

    # The pilot is one shard per vector length: at most shard_rows vectors, whatever the table holds.
    pilot = packed.where("part = 0").select("dim", "ids", "vectors")
    radii_schema = arrow_schema("dim int, block int, radii binary")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shard = None
        for batch in batches:
            for dim, block, q_ids, q, ids, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if dim != key:
                    key, shard = dim, Shard(np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim))
                radii = shard.radius(np.frombuffer(q_ids, np.int64), np.frombuffer(q).reshape(-1, dim), k)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((dim, block, radii.tobytes()), radii_schema)], schema=radii_schema)

    spread = asking.repartition(blocks, "block").join(F.broadcast(pilot), "dim").select("dim", "block", "q_ids", "q", "ids", "vectors")
    radii = tables.save("radii", spread.mapInArrow(measure, "dim int, block int, radii binary"), **few)

    # A block meets a shard: rows of at most a megabyte, as many as blocks times shards.
    meetings = asking.join(radii, ["dim", "block"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    joined = meetings.join(packed, ["dim", "part"]).sortWithinPartitions("dim", "part").select("dim", "part", "ids", "vectors", "q_ids", "q", "radii")
    schema = arrow_schema("query_id bigint, vec_id bigint, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shard = None
        for batch in batches:
            for dim, part, ids, data, q_ids, q, radii in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (dim, part) != key:
                    key, shard = (dim, part), Shard(np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim))
                q_ids = np.frombuffer(q_ids, np.int64)
                # No vector of this length in the pilot: every window holds everything.
                radius = np.full(len(q_ids), np.inf) if radii is None else np.frombuffer(radii)
                best = shard.search(q_ids, np.frombuffer(q).reshape(-1, dim), radius, k)
                columns = [np.repeat(q_ids, [len(p) for p, _ in best]), shard.ids[np.concatenate([p for p, _ in best])], np.concatenate([d for _, d in best])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = tables.save("found", joined.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), **few)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
