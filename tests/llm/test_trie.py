import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm import trie


def brute(rows, fork=True):
    """Rows of the trie from dictionaries of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if fork else 0
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    draw = random.Random(5)
    texts = ["", None, "one", "two words", "a b \x0b c", "x " * 500, "one|", "tie"]
    rows = []
    for c in [*range(0, 70), 100, 105, 119, -7, -40, 2**60 + 3]:
        if c in (20, 43):
            continue
        for turn in range(draw.randint(1, 7)):
            rows.append((c, draw.choice([turn, turn, None]), draw.choice(["user", "assistant", None, ""]), draw.choice(texts[:4] if turn < 3 else texts)))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(4)]
    rows += [(61, 3, "user", "tie"), (61, 3, "user", "tie"), (None, 1, "user", "no conversation")]
    draw.shuffle(rows)
    return rows


def nodes(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("band, shard_rows", [(trie.BAND, trie.SHARD_ROWS), (2, 40)])
def test_equals_dictionaries_of_prefixes(spark, band, shard_rows):
    rows = fixture()
    schema = "conv_id bigint, turn bigint, role string, text string, depth int, a string, shard int, place int, n_convs int, heads int"
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], schema).repartition(5)
    assert nodes(trie.prefix_trie(table, trie.crc_forks(table), band, shard_rows)) == brute(rows)


def test_a_long_conversation_and_many_copies(spark):
    rows = [(7, t, "user", f"w{t % 9}") for t in range(900)] + [(c, t, "user", f"w{t % 9}") for c in range(100, 300) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    turns = trie.ordered_turns(trie.Tables(spark, "t"), table)
    assert sorted(r.place for r in turns.where("conv_id = 7").collect()) == list(range(900))
    assert nodes(trie.prefix_trie(table, None, 64, 100)) == brute(rows, fork=False)


def test_no_rows(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert nodes(trie.prefix_trie(table, trie.crc_forks(table))) == []


def test_slots_are_minimal_and_verified():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    perfect = trie.PerfectHash.unpack(*trie.PerfectHash.build(a, b).pack())
    slots = perfect.slots(a, b)
    assert sorted(slots) == list(range(5000))
    held_a, held_b = np.empty_like(a), np.empty_like(b)
    held_a[slots], held_b[slots] = a, b
    assert (perfect.verified(a, b, held_a, held_b) == slots).all()
    assert (perfect.verified(a, b + np.uint64(1), held_a, held_b) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        trie.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))
