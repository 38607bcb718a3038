import numpy as np
import pytest

from ledgerline.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim int"


def brute(ids, x, query, k):
    far = np.sqrt(((x.astype(float) - x[query].astype(float)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), far[i]) for i in order]


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(rows, rows.where("vec_id % 100 = 0"), shard_rows=700, block_rows=7).toPandas()
    table = rows.toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding)
    hits = total = 0
    for query in np.flatnonzero(ids % 100 == 0):
        mine = got[got.query_id == ids[query]].sort_values("rank")
        want = brute(ids, x, query, 10)
        assert list(mine["rank"]) == list(range(1, 11))
        hits += len(set(mine.vec_id) & {i for i, _ in want})
        total += 10
    assert hits / total >= 0.98


@pytest.mark.parametrize("kind", ["uniform", "line", "copies"])
def test_recall_on_other_shapes(kind):
    draw = np.random.default_rng(3)
    x = draw.random((900, 32))
    if kind == "line":
        x = np.outer(np.arange(900.0), np.ones(32)) + draw.normal(size=(900, 32)) * 1e-3
    if kind == "copies":
        x[:400] = x[0]
    ids = np.arange(900)
    shard = ann.Shard(ids, x)
    best = shard.search(ids[::50], x[::50], shard.radius(ids[::50], x[::50], 10), 10)
    hits = 0
    for q, (places, far) in zip(ids[::50], best):
        want = brute(ids, x, q, 10)
        hits += len(set(places) & {i for i, _ in want})
        assert np.allclose(far, np.sqrt(((x[places] - x[q]) ** 2).sum(1)))
    assert hits >= 0.95 * 10 * len(best)
    if kind == "copies":
        assert list(best[0][0]) == list(range(1, 11))


def test_few_vectors_are_verified_and_none_of_the_nearest_lost():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, asked = np.arange(12_000), np.arange(0, 12_000, 400)
    shards = [ann.Shard(ids[k::4], x[k::4]) for k in range(4)]
    radius = shards[0].radius(ids[asked], x[asked], 10)
    best = [[] for _ in asked]
    for shard in shards:
        shard.verified = 0
        for found, (places, far) in zip(best, shard.search(ids[asked], x[asked], radius, 10)):
            found += zip(far, shard.ids[places])
    assert sum(s.verified for s in shards) < 0.1 * len(asked) * len(ids)
    hits = sum(len({i for _, i in sorted(found)[:10]} & {i for i, _ in brute(ids, x, q, 10)}) for q, found in zip(asked, best))
    assert hits >= 0.95 * 10 * len(asked)


def test_a_pilot_with_too_few_vectors_bounds_nothing():
    shard = ann.Shard(np.arange(3), np.eye(3))
    radius = shard.radius(np.array([0, 9]), np.eye(3)[:2], 3)
    assert radius[0] == np.inf and np.isclose(radius[1], 2**0.5)
    assert [list(places) for places, _ in shard.search(np.array([0]), np.eye(3)[:1], radius[:1], 3)] == [[1, 2]]


def test_of_rows_that_repeat_an_id_the_least_vector_counts(spark):
    rows = [(1, [5.0, 0.0]), (1, [2.0, 9.0]), (1, [2.0, 3.0]), (100, [2.0, 4.0]), (None, [1.0, 1.0])]
    schema = "vec_id bigint, embedding array<double>, id int, v int, part int, block int, q int, radii int, ids int"
    vectors = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6, 7) for i, v in rows], schema)
    for parts in (1, 5):
        got = ann.nearest(vectors.repartition(parts), vectors.where("vec_id = 100")).collect()
        assert [tuple(r) for r in got] == [(100, 1, 1, 1.0)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [1.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in ann.nearest(vectors, vectors.where("vec_id % 100 = 0 OR vec_id = 9")).collect())
    root = 2**0.5
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, root), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, root)]
    assert ann.nearest(vectors.limit(0), vectors).collect() == [] and ann.nearest(vectors, vectors.limit(0)).collect() == []
