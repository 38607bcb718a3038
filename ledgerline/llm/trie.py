"""Shared prefixes of conversations as a trie, kept in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns and is named by a digest of 128
bits: a polynomial over the digests of its turns, so every prefix of a
conversation follows from running sums.

1. Turns are put in order by a range sort of the whole table. Tasks number and
   sum what they hold; conversations that run over a partition's border (at most
   one per border) get the sums of the partitions before.
2. Prefixes (conversation, depth, digest) are dealt into shards by conversation
   and by bands of depth, so neither many conversations nor a very long one
   outgrow a shard. A shard enumerates its distinct digests, gives each a slot
   by a minimal perfect hash that is verified against the stored digest, and
   scatters counts into flat arrays by slot; parents are slots too.
3. Shards' nodes with equal digests are summed. A node is represented by its
   smallest member. Below a node, all nodes with the same representative lie on
   that conversation's path; so each node's own value goes to its
   representative's shard alone, is scattered by slot and accumulated through
   the parent slots, deepest first. What a conversation represents in deeper
   bands enters at the last node of the band above. The sums of equal digests
   over all shards are the subtree totals.

Distinct digests are the only rows that a hot turn or a hot conversation sends
on from a shard, once per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ARROW, STEP, Tables, mix, settings

#: Depths in a band, prefixes in a shard, and ids in one piece of a list.
BAND, SHARD_ROWS, PIECE = 1 << 14, 200_000, 50_000
#: The two lanes' bases, odd numbers, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
MASK = (1 << 64) - 1
WORD = r"[^\x20\x09-\x0D]+"


def plain_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema of plain columns, without a session."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, f.type) for c, f in zip(columns, schema)], schema=schema)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys of two numbers, without empty ones.

    Each level hashes the keys that are left into twice as many places; keys
    alone in their place get its rank among the taken ones, the others go on.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        taken = [int(bits.sum()) for bits in levels]
        self.first = np.cumsum([0, *taken])
        self.ranks = [np.cumsum(bits) - 1 for bits in levels]

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + np.uint64(level * BASES[1] & MASK))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        left, levels = np.arange(len(a)), []
        while len(left):
            if len(levels) == 64:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-2 * len(left) // 8) * 8
            places = cls._places(a[left], b[left], len(levels), size)
            levels.append(np.bincount(places, minlength=size) == 1)
            left = left[~levels[-1][places]]
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that is none of the built ones gets any slot or -1."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, bits in enumerate(self.levels):
            places = self._places(a[left], b[left], level, len(bits))
            hit = bits[places]
            out[left[hit]] = self.first[level] + self.ranks[level][places[hit]]
            left = left[~hit]
        return out

    def verified(self, a: np.ndarray, b: np.ndarray, held_a: np.ndarray, held_b: np.ndarray) -> np.ndarray:
        """The slot of each key whose stored digest is the key itself, else -1."""
        at = self.slots(a, b)
        if not len(held_a):
            return at
        return np.where((at >= 0) & (held_a[at] == a) & (held_b[at] == b), at, -1)

    def pack(self) -> tuple[bytes, bytes]:
        return np.array([len(b) for b in self.levels], np.int64).tobytes(), b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        return cls(np.split(flat, np.cumsum(np.frombuffer(sizes, np.int64))[:-1]) if sizes else [])


ORDERED = "part int, conv_id bigint, place bigint, xa bigint, xb bigint, sa bigint, sb bigint, words bigint"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and running sums of each conversation, counted from where the partition's rows of it begin."""
    schema, part = plain_schema(ORDERED), TaskContext.get().partitionId()
    last, place, sums, power = None, 0, [0, 0], [1, 1]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(n, 2)
        new = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        carried = ~np.maximum.accumulate(new)  # rows of the conversation that the batch before ended with
        at = np.arange(n) - start
        out = []
        for lane in (0, 1):
            up = _powers(BASES[lane], int(at.max()) + 1)[at]
            terms = x[:, lane] * np.where(carried, up * np.uint64(power[lane]), up)
            total = np.cumsum(terms, dtype=np.uint64)
            total -= np.where(carried, np.uint64(0), total[start] - terms[start])
            total[carried] += np.uint64(sums[lane])
            out.append(total)
        at = at + np.where(carried, place, 0)
        last, place = conv[-1], int(at[-1]) + 1
        sums, power = [int(s[-1]) for s in out], [pow(b, place, 1 << 64) for b in BASES]
        yield _batch(schema, [np.full(n, part, np.int32), conv, at, x[:, 0].copy(), x[:, 1].copy(), *out, batch.column(2).to_numpy()])


def ordered_turns(tables: Tables, table: DataFrame) -> DataFrame:
    """(conv_id, place, xa, xb, sa, sb, words): each turn's digest, and the sums up to it.

    Turns follow by turn (null first), then role, then text; repeated rows are
    turns of their own. Null roles and texts are empty; rows without conv_id are
    left out.
    """
    rows = table.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256), 1, 32))
    rows = rows.where("conv_id is not null").select("conv_id", "turn", "role", "text", digest.alias("x"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32))
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "x", "words")
    part = tables.save("ordered", dealt.mapInArrow(_number, ORDERED))

    # Conversations in several partitions: at most one per border.
    held = part.groupBy("conv_id", "part").agg(F.max(F.struct("place", "sa", "sb")).alias("m"))
    split = held.select("conv_id", "part", "m", F.count("*").over(Window.partitionBy("conv_id")).alias("parts")).where("parts > 1")
    carries: dict[int, list[tuple[int, int, int, int]]] = {}
    conv, count, sums = None, 0, [0, 0]
    for row in split.select("conv_id", "part", "m.*").orderBy("conv_id", "part").collect():
        if row.conv_id != conv:
            conv, count, sums = row.conv_id, 0, [0, 0]
        elif count:
            carries.setdefault(row.part, []).append((conv, count, *sums))
        sums = [(s + pow(b, count, 1 << 64) * (own & MASK)) & MASK for s, b, own in zip(sums, BASES, (row.sa, row.sb))]
        count += row.place + 1
    if not carries:
        return part.drop("part")
    schema = plain_schema(ORDERED)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, conv, place = (batch.column(i).to_numpy() for i in range(3))
            place, sa, sb = place.copy(), _u64(batch.column(5)).copy(), _u64(batch.column(6)).copy()
            for p in np.unique(parts):
                for key, count, a, b in carries.get(int(p), ()):
                    at = (parts == p) & (conv == key)
                    place[at] += count
                    for lane, s, before in ((0, sa, a), (1, sb, b)):
                        s[at] = s[at] * np.uint64(pow(BASES[lane], count, 1 << 64)) + np.uint64(before)
            yield _batch(schema, [parts, conv, place, _u64(batch.column(3)), _u64(batch.column(4)), sa, sb, batch.column(7).to_numpy()])

    return part.mapInArrow(carry, ORDERED).drop("part")


PREFIX = "conv_id bigint, depth bigint, a bigint, b bigint, pa bigint, pb bigint, words bigint, last boolean"


def _with_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests at each depth from (conv_id, depth, xa, xb, sa, sb, words, last, cut, ha, hb, oa, ob).

    A prefix is a head of other turns (sums ha, hb) followed by own turns after
    the first ones (sums oa, ob), moved by `cut` places; the parent lacks the
    last turn.
    """
    schema = plain_schema(PREFIX)
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, cut = batch.column(1).to_numpy(), batch.column(8).to_numpy()
        lanes = []
        for lane in (0, 1):
            x, s, head, own = (_u64(batch.column(i + lane)) for i in (2, 4, 9, 11))
            back = np.array([pow(INVERSES[lane], k, 1 << 64) for k in range(int(cut.max()) + 1)], np.uint64)
            kinds, at = np.unique(depth, return_inverse=True)
            up = np.array([pow(BASES[lane], int(d) - 1, 1 << 64) for d in kinds], np.uint64)[at]
            digest = head + back[cut] * (s - own)
            lanes.append((digest, digest - x * up))
        (a, parent_a), (b, parent_b) = lanes
        yield _batch(schema, [batch.column(0).to_numpy(), depth, a, b, parent_a, parent_b, batch.column(6).to_numpy(), batch.column(7).to_numpy(zero_copy_only=False)])


def prefixes(tables: Tables, turns: DataFrame, forks: DataFrame | None = None) -> DataFrame:
    """One row per conversation and depth, the empty prefix included: its digest and its parent's.

    `forks` (conv_id, base, heads; heads at most 3, one row per conversation)
    rebuilds conversations: the first `heads` turns of conversation `base`, as
    many as there are, and then the conversation's own turns after its first
    `heads`.
    """
    turns = tables.save("turns", turns)
    sums = [F.max(F.when(F.col("place") == k, F.struct("sa", "sb", "xa", "xb", "words"))).alias(f"at{k}") for k in range(3)]
    convs = tables.save("convs", turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array(*sums).alias("own")))
    zero = F.lit(0).cast("bigint")
    if forks is None:
        forks = convs.select("conv_id", F.col("conv_id").alias("base"), zero.alias("heads"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("own").alias("base_turns"))
    plan = convs.join(forks, "conv_id").join(bases, "base", "left")
    plan = plan.withColumn("taken", F.least("heads", F.coalesce("base_n", zero)))

    def sums_at(turns_col: str, count: str, lane: str):
        """The sum over the first `count` turns; none where `count` is 0 or beyond the turns."""
        return F.coalesce(F.get(F.col(turns_col), (F.col(count) - 1).cast("int"))[lane], zero)

    plan = tables.save("plan", plan.select(
        "conv_id", "heads", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("heads"), zero)).alias("length"), (F.col("heads") - F.col("taken")).alias("cut"), "base_turns",
        sums_at("base_turns", "taken", "sa").alias("ha"), sums_at("base_turns", "taken", "sb").alias("hb"), sums_at("own", "heads", "sa").alias("oa"), sums_at("own", "heads", "sb").alias("ob"),
    ))
    last = F.col("depth") == F.col("length")
    head = plan.select("conv_id", "length", F.posexplode(F.slice("base_turns", F.lit(1), F.col("taken").cast("int"))).alias("at", "t"))
    head = head.select("conv_id", (F.col("at") + 1).cast("bigint").alias("depth"), "length", "t.xa", "t.xb", "t.sa", "t.sb", "t.words", *(zero.alias(c) for c in ("cut", "ha", "hb", "oa", "ob")))
    tail = turns.join(plan, "conv_id").where("place >= heads").select("conv_id", (F.col("place") + 1 - F.col("cut")).alias("depth"), "length", "xa", "xb", "sa", "sb", "words", "cut", "ha", "hb", "oa", "ob")
    columns = ["conv_id", "depth", "xa", "xb", "sa", "sb", "words", last.alias("last"), "cut", "ha", "hb", "oa", "ob"]
    made = head.select(*columns).union(tail.select(*columns)).mapInArrow(_with_parents, PREFIX)
    roots = plan.select("conv_id", *(zero.alias(c) for c in ("depth", "a", "b", "pa", "pb", "words")), (F.col("length") == 0).alias("last"))
    return made.union(roots)


NODE_TABLE = "shard int, sizes binary, bits binary, a binary, b binary, pa binary, pb binary, parent binary, depth binary, words binary, conv binary, n binary"


def _node_table(group: pa.Table) -> pa.Table:
    """The flat arrays of one shard, by slot."""
    group = group.combine_chunks()
    shard = group.column("shard")[0].as_py()
    a, b, parent_a, parent_b = (_u64(group.column(c).chunk(0)) for c in ("a", "b", "pa", "pb"))
    depth, words, conv, top = (group.column(c).to_numpy() for c in ("depth", "words", "conv_id", "top"))
    order = np.lexsort((b, a))
    a, b, parent_a, parent_b, depth, words, conv, top = (x[order] for x in (a, b, parent_a, parent_b, depth, words, conv, top))
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    for x in (parent_a, parent_b, depth, words):
        if (~new[1:] & (x[1:] != x[:-1])).any():
            raise ValueError("two prefixes share a digest")
    first = np.flatnonzero(new)
    perfect = PerfectHash.build(a[first], b[first])
    slot = perfect.slots(a, b)
    size = len(first)
    count = np.bincount(slot, minlength=size)
    least = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    flat = {}
    for name, x in (("a", a), ("b", b), ("pa", parent_a), ("pb", parent_b), ("depth", depth), ("words", words), ("top", top)):
        flat[name] = np.empty(size, x.dtype)
        flat[name][slot[first]] = x[first]
    parent = perfect.verified(flat["pa"], flat["pb"], flat["a"], flat["b"])
    if ((parent < 0) & ~flat["top"]).any():
        raise ValueError("a prefix without its parent")
    parent[flat["top"]] = -1
    arrays = [flat["a"], flat["b"], flat["pa"], flat["pb"], parent, flat["depth"], flat["words"], least, count.astype(np.int64)]
    values = [[shard], *([x] for x in perfect.pack()), *([x.tobytes()] for x in arrays)]
    schema = plain_schema(NODE_TABLE)
    return pa.table([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


LOCAL = "a bigint, b bigint, pa bigint, pb bigint, depth bigint, words bigint, conv_id bigint, n bigint"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = plain_schema(LOCAL)
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            yield _batch(schema, [np.frombuffer(x, np.int64) for x in row])


SUMS = "a bigint, b bigint, saved bigint, leaves bigint"


def _accumulate(tables: pa.Table, values: pa.Table) -> pa.Table:
    """Subtree sums of one shard's nodes: values go to their slots and on to the parents, deepest first."""
    schema = plain_schema(SUMS)
    if not tables.num_rows:
        return schema.empty_table()
    row = tables.slice(0, 1).to_pylist()[0]
    perfect = PerfectHash.unpack(row["sizes"], row["bits"])
    a, b = (np.frombuffer(row[c], np.uint64) for c in ("a", "b"))
    parent, depth = (np.frombuffer(row[c], np.int64) for c in ("parent", "depth"))
    flat = np.zeros((2, len(a)), np.int64)
    if values.num_rows:
        values = values.combine_chunks()
        at = perfect.verified(*(_u64(values.column(c).chunk(0)) for c in ("a", "b")), a, b)
        if (at < 0).any():
            raise ValueError("a value for a prefix that the shard does not hold")
        for k, c in enumerate(("saved", "leaves")):
            np.add.at(flat[k], at, values.column(c).to_numpy())
    order = np.argsort(depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[::-1]:
        level = level[parent[level] >= 0]
        for k in (0, 1):
            np.add.at(flat[k], parent[level], flat[k][level])
    return pa.table([pa.array(x, f.type) for x, f in zip((a.view(np.int64), b.view(np.int64), *flat), schema)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv_id) as joined decimals, one piece per node and at most PIECE ids."""
    schema = plain_schema("a bigint, b bigint, first bigint, ids string")
    for batch in batches:
        a, b, conv = (batch.column(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        texts = [",".join(map(str, x.tolist())) for x in np.split(conv, starts[1:])] if len(a) else []
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(conv[starts]), pa.array(texts, pa.string())], schema=schema)


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, one after the other, in order."""
    schema = plain_schema("a bigint, b bigint, ends_sha256 string")
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, digest.hexdigest()), schema)], schema=schema)

    for batch in batches:
        for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (a, b) == key:
                digest.update(b"," + text.encode())
                continue
            if key is not None:
                yield row()
            key, digest = (a, b), hashlib.sha256(text.encode())
    if key is not None:
        yield row()


def ends(tables: Tables, rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): digest of the ids that end at each node.

    A digest of a list has to be taken in order, so a node's list meets one
    task, as text pieces that stream through it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("a", "b", "conv_id").repartitionByRange(parts, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    # The size of a batch is the size of a piece.
    pieces = tables.save("pieces", dealt.mapInArrow(_pieces, "a bigint, b bigint, first bigint, ids string"), **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(PIECE)})
    sorted_pieces = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return tables.save("ends", sorted_pieces.mapInArrow(_digest_pieces, "a bigint, b bigint, ends_sha256 string"))


def build(tables: Tables, rows: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie over `rows` as `prefixes` makes them."""
    spark: SparkSession = rows.sparkSession
    rows = tables.save("prefixes", rows)
    shards = max(1, -(-rows.count() // shard_rows))

    def shard_of(conv: str):
        return F.pmod(F.xxhash64(conv, F.floor(F.col("depth") / band)), F.lit(shards)).cast("int").alias("shard")

    dealt = rows.select(shard_of("conv_id"), "conv_id", "depth", "a", "b", "pa", "pb", "words", (F.col("depth") % band == 0).alias("top"))
    held = tables.save("shards", dealt.groupBy("shard").applyInArrow(_node_table, NODE_TABLE))

    with settings(spark, {**STEP, "spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        local = tables.save("local", held.select("a", "b", "pa", "pb", "depth", "words", "conv", "n").mapInArrow(_nodes, LOCAL), **{"spark.sql.execution.arrow.maxRecordsPerBatch": "4"})
    same = F.struct("pa", "pb", "depth", "words")
    checked = F.when(F.min("same") == F.max("same"), F.max("same")).otherwise(F.raise_error(F.lit("two prefixes share a digest")))
    nodes = local.withColumn("same", same).groupBy("a", "b").agg(checked.alias("same"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))
    nodes = tables.save("distinct", nodes.select("a", "b", "same.*", "conv_id", "n_convs"))

    # Children are counted where their parent is, in one exchange with the nodes themselves.
    none = F.lit(None).cast("struct<pa:bigint,pb:bigint,depth:bigint,words:bigint,conv_id:bigint,n_convs:bigint>")
    own = nodes.select("a", "b", F.struct("pa", "pb", "depth", "words", "conv_id", "n_convs").alias("own"), F.lit(0).cast("bigint").alias("child"))
    below = nodes.where("depth > 0").select(F.col("pa").alias("a"), F.col("pb").alias("b"), none.alias("own"), F.lit(1).cast("bigint").alias("child"))
    counted = own.union(below).groupBy("a", "b").agg(F.max("own").alias("own"), F.sum("child").alias("n_children"))
    counted = tables.save("counted", counted.select("a", "b", "own.*", "n_children"))

    own_value = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    values = counted.select("a", "b", "conv_id", "depth", own_value, (F.col("n_children") == 0).cast("bigint").alias("leaves")).where("saved <> 0 or leaves <> 0")
    # What a conversation represents below a band enters at its last node of that band.
    below_band = values.where(F.col("depth") >= band).groupBy("conv_id", F.floor(F.col("depth") / band).alias("band")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    doors = rows.where(F.col("depth") % band == band - 1).select("conv_id", F.floor(F.col("depth") / band).alias("band"), "a", "b", "depth")
    doors = doors.join(below_band.select("conv_id").distinct(), "conv_id", "leftsemi")
    after = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    steps = doors.join(below_band, ["conv_id", "band"], "full").select("conv_id", "a", "b", "depth", F.sum("saved").over(after).alias("saved"), F.sum("leaves").over(after).alias("leaves"))
    steps = steps.where("a is not null and saved is not null")
    sent = values.select(shard_of("conv_id"), "a", "b", "saved", "leaves").union(steps.select(shard_of("conv_id"), "a", "b", "saved", "leaves"))
    sent = tables.save("values", sent)
    sums = held.drop("pa", "pb", "words", "conv", "n").groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(_accumulate, SUMS)
    sums = tables.save("sums", sums)

    totals = tables.save("totals", sums.groupBy("a", "b").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    listed = ends(tables, rows.where("last"))
    parents = counted.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("above"))
    out = counted.join(totals, ["a", "b"]).join(listed, ["a", "b"], "left")
    out = out.join(parents, (out["pa"] == parents["pa"]) & (out["pb"] == parents["pb"]) & (F.col("above") == F.col("depth") - 1), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def prefix_trie(table: DataFrame, forks: DataFrame | None = None, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct prefix of the conversations in `table` (conv_id, turn, role, text).

    A node is named by its smallest member and its depth. Its columns:
    parent_conv_id (null at the root), n_convs (members), n_children, n_leaves
    (nodes without children in its subtree, itself included), saved_tokens (over
    its subtree, members but one times the words of the last text), ends_sha256
    (digest of the ids of members that end here). Order and nulls as in
    `ordered_turns`, rebuilding as in `prefixes`. Other columns are not read,
    whatever their names. No rows give no rows, not even a root.
    """
    tables = Tables(table.sparkSession, "trie")
    with settings(table.sparkSession, STEP):
        return build(tables, prefixes(tables, ordered_turns(tables, table), forks), band, shard_rows)


def crc_forks(table: DataFrame) -> DataFrame:
    """Forks that give each conversation up to three first turns of the first one of its block of twenty."""
    ids = table.select(F.col("conv_id").cast("bigint").alias("conv_id")).where("conv_id is not null").distinct()
    return ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 4).alias("heads"))


SQL = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, step, c) AS (
  SELECT conv_id, 0, xor(4294967295, ascii(substr(conv_id::VARCHAR, 1, 1)))::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, step + 1,
         CASE WHEN (step + 1) % 8 = 0 AND (step + 1) // 8 < length(conv_id::VARCHAR)
              THEN xor(xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), ascii(substr(conv_id::VARCHAR, (step + 1) // 8 + 1, 1)))
              ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END::BIGINT
  FROM crc WHERE step < 8 * length(conv_id::VARCHAR)
), forks AS (
  SELECT conv_id, xor(c, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM crc WHERE step = 8 * length(conv_id::VARCHAR)
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), parts AS (
  SELECT f.conv_id, 0 AS piece, o.place, o.role, o.text FROM forks f JOIN own o ON o.conv_id = f.base AND o.place <= f.h
  UNION ALL SELECT f.conv_id, 1, o.place, o.role, o.text FROM forks f JOIN own o ON o.conv_id = f.conv_id AND o.place > f.h
), turns AS (
  SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^ \t-\r]+')) AS words,
         sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY piece, place)) AS key
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY piece, place)
), paths AS (
  SELECT conv_id, depth, words, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS above, depth = count(*) OVER (PARTITION BY conv_id) AS ends FROM turns
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM parts) FROM ids
), nodes AS (
  SELECT key, any_value(above) AS above, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY key
), children AS (
  SELECT above AS key, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), valued AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes n LEFT JOIN children c USING (key)
), sums AS (
  SELECT p.key, sum(v.saved) AS saved_tokens, sum((v.n_children = 0)::INT) AS n_leaves
  FROM valued v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.key
)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s USING (key) LEFT JOIN nodes u ON u.key = v.above
"""
