"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidate edges.

A document's set holds its distinct 5-word shingles (words split at white space,
A-Z lower-cased). One hash of each shingle gives both a bin and a value; a bin
keeps its least value and an empty bin borrows from the first occupied one in a
random order of its own (optimal densification). 128 bins in 32 bands of 4 miss
a pair at similarity 0.75 with a probability of 5e-6.

Equal sets are one class from the start, so copies never meet in pairs. In each
bucket the class with the least id is the centre and is compared with every
other member: a star, as many pairs as members. Links are confirmed on the full
sets. A bucket whose members are in one component by then is settled; the others
are given sixty-four times as many centres from round to round, compared only
across components, until every member has been one. So no link between classes
that share a bucket is lost, and pairs grow with unsettled members only.

After the star, a set's items that no set of another component holds are set
aside: no overlap across components can hold them, so pairs whose other items
are too few are left out, which is exact.
A pair is made only if its sizes allow a similarity of 0.75 and its outlines
agree: 1024 bins, one bit each, drawn anew in every bin, also where bins borrow
the same item. At similarity 0.75 they agree in 896 bins on average, with a
deviation of up to 11.7 (sets of 32 to 256 items, simulated); 841 are asked for,
which fails about as rarely (1e-6) as the bands do. Half of the bins are looked at
first. With fewer items one bin more or less says too much: sets of up to 42
travel whole, and a pair of two such sets is made if the sets are alike, which is
exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BASE, Tables, arrow_map, mix, utf8, window_hashes, word_hashes
from ledgerline.llm.components import connected

BINS, ROWS, WORDS = 128, 4, 5
BIN_BITS = np.uint64(64 - 7)
EDGES = np.arange(BINS, dtype=np.uint64) << BIN_BITS


def _orders(bins: int) -> np.ndarray:
    """For each bin an order of all bins, drawn by a hash; it begins with the bin itself."""
    drawn = mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(bins)).reshape(bins, bins)
    drawn[np.arange(bins), np.arange(bins)] = 0
    return np.argsort(drawn, axis=1)


ORDER = _orders(BINS)
FINE = 1024
FINE_EDGES = np.arange(FINE, dtype=np.uint64) << np.uint64(64 - 10)
FINE_ORDER, FINE_ROWS = _orders(FINE), np.arange(FINE)
FINE_SALT = FINE_ROWS.astype(np.uint64) + np.uint64(1)
AGREE, COARSE, COARSE_AGREE = 841, 512, 407
#: Sets of so many items travel whole; a pair with one larger set has 32 items at least on either side.
FEW = 42
BAND = np.arange(BINS // ROWS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; a shorter text is one shingle."""
    words, _, _ = word_hashes(text, lower=True)
    return np.unique(window_hashes(words, min(WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


def signature(sorted_hashes: np.ndarray) -> np.ndarray:
    """Least value of each bin, empty bins filled."""
    first = np.searchsorted(sorted_hashes, EDGES)
    filled = np.diff(np.append(first, len(sorted_hashes))) > 0
    source = ORDER[np.arange(BINS), filled[ORDER].argmax(axis=1)]
    return sorted_hashes[first[source]]


def outline(sorted_hashes: np.ndarray) -> np.ndarray:
    """One bit of the least value in each of 1024 further bins, packed into numbers.

    The bit depends on the bin too, so bins that borrow one value are no copies of each other.
    """
    values = np.sort(mix(sorted_hashes + np.uint64(BASE)))
    first = np.searchsorted(values, FINE_EDGES)
    filled = np.diff(np.append(first, len(values))) > 0
    step, empty = np.zeros(FINE, np.int64), FINE_ROWS
    for reach in (16, 128, FINE):  # few bins have to look far
        near = filled[FINE_ORDER[empty, :reach]]
        step[empty] = near.argmax(axis=1)
        empty = empty[~near.any(axis=1)]
        if not len(empty):
            break
    bits = mix(values[first[FINE_ORDER[FINE_ROWS, step]]] + FINE_SALT) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bands(sorted_hashes: np.ndarray) -> np.ndarray:
    rows = signature(sorted_hashes).reshape(-1, ROWS)
    key = mix(BAND + np.uint64(1))
    for k in range(ROWS):
        key = key * np.uint64(BASE) + rows[:, k]
    return mix(key)


def _digest(sorted_hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_hashes.tobytes(), digest_size=16).digest()


def _sketch(batch: pa.RecordBatch) -> dict:
    sets = [shingles(t) for t in utf8(batch.column("text"))]
    return {
        "id": batch.column("id"),
        "key": batch.column("key"),
        "n": [len(s) for s in sets],
        "node": [_digest(s) if len(s) else None for s in sets],
        "outline": [outline(s) if len(s) else None for s in sets],
        "few": [s.view(np.int64) if 0 < len(s) <= FEW else None for s in sets],
        "bands": [bands(s).view(np.int64) if len(s) else None for s in sets],
    }


def _sets(batch: pa.RecordBatch) -> dict:
    sets = [shingles(t) for t in utf8(batch.column("text"))]
    return {"node": [_digest(s) for s in sets], "n": [len(s) for s in sets], "items": [s.view(np.int64) for s in sets]}


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have similarity of at least 0.75."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= 75 * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _shared(tables: Tables, sets: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """(node, shared): how many of a set's items are also in a set of another component."""
    items = tables.save(f"items-{label}", sets.join(nodes, "node").select("node", "root", F.explode("items").alias("item")))
    crossing = items.groupBy("item").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("item")
    crossing = tables.save(f"crossing-{label}", crossing)
    return tables.save(f"shared-{label}", items.join(crossing, "item", "left_semi").groupBy("node").agg(F.count("*").alias("shared")))


def _joined(tables: Tables, roots: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """The roots after further links: components are joined by their roots alone."""
    ends = links.select(F.col("a").alias("node"), F.col("a").alias("root")).union(links.select("b", "b"))
    known = tables.save(f"known-{label}", roots.union(ends).groupBy("node").agg(F.min("root").alias("root")))
    first, second = (known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("a", "b"))
    between = links.join(first, "a").join(second, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    merged = connected(tables, between, f"graph-{label}").select(F.col("node").alias("root"), F.col("root").alias("least"))
    return tables.save(f"roots-{label}", known.join(merged, "root", "left").select("node", F.coalesce("least", "root").alias("root")))


def _components(tables: Tables, docs: DataFrame) -> DataFrame:
    """(id, key, n, root) for each row of `docs` (id, key, text); rows of one component have one root, rows without shingles none."""
    texts = docs.select("id", "text")
    schema = "id bigint, key binary, n bigint, node binary, outline array<bigint>, few array<bigint>, bands array<bigint>"
    sketches = tables.save("sketches", arrow_map(docs.withColumn("id", F.col("id").cast("bigint")), schema, _sketch))

    last = F.lit((1 << 63) - 1)
    classes = sketches.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in ("n", "outline", "few", "bands")))
    classes = tables.save("classes", classes)
    rows = tables.save("rows", classes.select("node", F.coalesce("id", last).alias("first"), F.posexplode("bands").alias("band", "bucket")))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("first", "node")).alias("centre")).where("size > 1")
    buckets = tables.save("buckets", buckets.select("bucket", "size", "centre.node").withColumnRenamed("node", "centre"))
    members = rows.drop("first").join(buckets, "bucket").join(classes.select("node", "n", "outline", "few", "bands"), "node")
    members = tables.save("members", members)
    tables.drop("rows")

    wanted = tables.save("wanted", members.select("node").distinct().join(classes.select("node", "id"), "node"))
    texts_of = texts.join(wanted.select(F.col("id").alias("want")).distinct(), F.col("id").eqNullSafe(F.col("want")), "left_semi")
    sets = arrow_map(texts_of, "node binary, n bigint, items array<bigint>", _sets).where("n > 0").groupBy("node")
    sets = tables.save("sets", sets.agg(F.any_value("n").alias("n"), F.any_value("items").alias("items")))

    coarse = sum((F.bit_count(F.get("outline", F.lit(i)).bitwiseXOR(F.get("centre_outline", F.lit(i)))) for i in range(COARSE // 64)), F.lit(0))
    fine = F.aggregate(F.zip_with("outline", "centre_outline", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    whole = F.expr("few IS NOT NULL AND centre_few IS NOT NULL")
    exact = F.expr("175 * size(array_intersect(few, centre_few)) >= 75 * (n + m)")
    likely = (coarse <= COARSE - COARSE_AGREE) & (fine <= FINE - AGREE)
    alike = F.expr("75 * greatest(n, m) <= 100 * least(n, m)") & F.when(whole, exact).otherwise(likely)
    centre = [F.col("node").alias("centre"), F.col("n").alias("m"), F.col("outline").alias("centre_outline"), F.col("few").alias("centre_few")]
    # Of all buckets that two sets share, the first one makes the pair.
    once = F.array_position(F.zip_with("bands", "centre_bands", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1
    middle = buckets.select(F.col("centre").alias("node")).distinct().join(classes, "node").select(*centre)
    star = members.where("node <> centre").select("node", "n", "outline", "few", "centre").distinct().join(middle, "centre").where(alike)
    links = tables.save("links-0", _links(star.select(F.col("node").alias("a"), F.col("centre").alias("b")), sets))
    roots = connected(tables, links, "graph-0")
    step, centres, tried = 0, 64, 0
    while True:
        step += 1
        placed = members.drop("centre").where(f"size > greatest(2, {tried})").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = tables.save(f"placed-{step}", placed)
        unsettled = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        unsettled = tables.save(f"unsettled-{step}", unsettled)
        if unsettled.isEmpty():
            break
        left = tables.save(f"left-{step}", placed.join(unsettled, "bucket", "left_semi"))
        tables.drop(f"placed-{step}")
        shared = _shared(tables, sets, left.select("node", "root").distinct(), str(step))
        # A set that shares less than its part with all other components has no link to come.
        left = tables.save(f"open-{step}", left.join(shared, "node").where("100 * shared >= 75 * n"))
        tables.drop(f"left-{step}", f"items-{step}", f"crossing-{step}")
        # Every member has a rank by hash; the first `centres` of them, on average, are centres by now.
        rank = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30)) / float(1 << 30) * F.col("size")
        left = left.withColumn("rank", rank)
        chosen = tables.save(f"chosen-{step}", left.where((F.col("rank") < centres) & (F.col("rank") >= tried)).select("bucket", *centre, F.col("bands").alias("centre_bands"), F.col("shared").alias("centre_shared"), F.col("root").alias("centre_root")))
        enough = F.expr("root <> centre_root AND 175 * least(shared, centre_shared) >= 75 * (n + m)")
        # A pair has been made already if the member was a centre before, and is made once if both are centres now.
        new = F.expr(f"rank >= {tried} AND (rank >= {centres} OR node < centre)")
        pairs = left.join(chosen, "bucket").where(new & enough & alike & once)
        pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        pairs = tables.save(f"pairs-{step}", pairs)
        found = tables.save(f"links-{step}", _links(pairs, sets))
        if not found.isEmpty():
            roots = _joined(tables, roots, found, str(step))
        tried, centres = centres, 64 * centres

    placed = sketches.select("id", "key", "n", "node").join(roots, "node", "left")
    placed = tables.save("components", placed.select("id", "key", "n", F.coalesce("root", "node").alias("root")))
    tables.drop("classes", "sets", "members")
    return placed


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of `docs`.

    component_id is the least id reachable over links, kept says whether the row
    is that document. Null and empty texts have no shingles and are linked with
    nothing. Rows that repeat an id are one document as far as ids tell; rows
    without id take part and are kept only where nothing with an id is alike.
    Other columns are not read. No rows give no rows.
    """
    tables = Tables(docs.sparkSession, "minhash")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.lit(None).cast("binary").alias("key"), F.col(text_col).alias("text"))
    placed = _components(tables, rows).drop("key")
    least = tables.save("least", placed.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("c")).where("c > 1"))
    result = placed.join(least.drop("c"), "root", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return result.select(
        F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(id_type), F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one row of each component, and all rows without shingles.

    The row with the least id stays, one without id only where no other is alike;
    of several under that id the one with the least digest. A row goes by its id
    and a digest of its text and other columns, so rows that repeat an id or have
    none are rows of their own.
    """
    tables = Tables(docs.sparkSession, "one-of-each")
    # Numbered columns: none of the input's names can clash with those used here.
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    others = F.xxhash64(F.lit(0), *(F.col(c) for c in names if c not in (own, text)))
    numbered = docs.toDF(*names)
    marked = numbered.withColumn("key", F.unhex(F.concat(F.coalesce(F.md5(text), F.lit("0" * 32)), F.lpad(F.hex(others), 16, "0"))))
    placed = _components(tables, marked.select(F.col(own).alias("id"), "key", F.col(text).alias("text")))
    best = placed.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    best = tables.save("best", best.select(F.col("best.id").alias("best_id"), F.col("best.key").alias("best_key")))
    worded = F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    same = (F.col("key") == F.col("best_key")) & F.col(own).cast("bigint").eqNullSafe(F.col("best_id"))
    # Rows that agree in all columns are one row here.
    kept = marked.where(worded).join(best, same, "left_semi").dropDuplicates([own, "key"])
    return kept.drop("key").unionByName(numbered.where(~worded)).toDF(*docs.columns)
