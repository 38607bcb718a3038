import random
import re

import numpy as np
import pytest

from ledgerline.llm import minhash

SCHEMA = "doc_id bigint, text string, id string, n int"


def brute(rows):
    """Links by full sets of word tuples, components by repeated merging."""
    sets = []
    for _, text, *_ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i), []).append(row[0])
    return sorted((row[0], len(sets[i]), min(out[find(i)]), row[0] == min(out[find(i)])) for i, row in enumerate(rows))


def corpus(seed, families, copies, words=60):
    draw = random.Random(seed)
    vocabulary = [f"W{i}" if i % 7 else f"ö{i}" for i in range(400)]
    rows = []
    for _ in range(families):
        text = [draw.choice(vocabulary) for _ in range(words)]
        for _ in range(draw.randint(1, copies)):
            rows.append(list(text))
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(words)] = draw.choice(vocabulary)
    draw.shuffle(rows)
    return [(i, draw.choice([" ", "\n", "\t "]).join(w.lower() if draw.random() < 0.3 and w.isascii() else w for w in r), "x", 1) for i, r in enumerate(rows)]


def run(spark, rows):
    return sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize("seed,families,copies", [(1, 40, 6), (2, 3, 80)])
def test_components_equal_brute_force(spark, seed, families, copies):
    rows = corpus(seed, families, copies)
    assert run(spark, rows) == brute(rows)


def test_empty_short_null_and_repeated_rows(spark):
    rows = [
        (3, "same words", "a", 1), (4, "SAME\twords ", "a", 1), (5, "", "a", 1), (6, None, "a", 1), (7, " \n", "a", 1),
        (8, "one two three four five six", "a", 1), (8, "one two three four five six", "a", 1), (9, "word " * 50000, None, None), (10, "word " * 9, None, None),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    lone = spark.createDataFrame([(None, "a b c", "a", 1), (2, "a b c", "a", 1), (None, "d", "a", 1)], SCHEMA)
    got = {tuple(r) for r in minhash.near_duplicates(lone).collect()}
    assert got == {(None, 1, 2, False), (2, 1, 2, True), (None, 1, None, True)}


def test_signature_agreement_estimates_similarity():
    draw = np.random.default_rng(5)
    for size in (12, 300, 5000):
        items = np.unique(draw.integers(0, 2**63, 2 * size).astype(np.uint64))
        a, b = np.sort(items[: int(size * 1.75)]), np.sort(items[int(size * 0.25) :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.2


def test_chain_without_a_common_centre(spark):
    """Neighbours in a chain are alike, its ends are not: one component all the same."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 80]), "x", 1) for i in range(20)]
    assert run(spark, rows) == brute(rows)

def short_families(seed, families):
    """Texts of 6 to 25 words with neighbours just at, above and below the limit: words are cut from the end."""
    draw = random.Random(seed)
    rows = []
    for f in range(families):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(8, 25))]
        shingles = len(words) - 4
        cut = draw.choice([shingles // 4, shingles // 4, shingles // 4 + 1])
        rows += [words, words[: len(words) - cut]]
    draw.shuffle(rows)
    return [(i, " ".join(r), "x", 1) for i, r in enumerate(rows)]


def test_short_texts_equal_brute_force(spark):
    rows = short_families(7, 600)
    assert run(spark, rows) == brute(rows)


def test_outline_bits_of_borrowing_bins_are_independent():
    """A subset of three quarters agrees in 896 bins, with a deviation of binomial size, however few the items are."""
    draw = np.random.default_rng(11)
    for size in (8, 40, 400):
        agree = []
        for _ in range(300):
            items = draw.integers(0, 2**63, size).astype(np.uint64)
            a, b = (minhash.outline(np.sort(s)) for s in (items, items[: size * 3 // 4]))
            agree.append(minhash.FINE - sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)))
        assert abs(np.mean(agree) - 896) < 4 and np.std(agree) < 14


def test_one_of_each_whatever_the_further_columns_are(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, base), (1, base), (None, base), (7, "quite another text of more than five words"), (7, "quite another text of more than five words"), (8, None), (9, " ")]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = minhash.one_of_each(plain)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8, 9]
    names = ["key", "_key", "best_id", "_best_id", "best_key", "id", "root", "n", "node", "none", "best", "c0", "c1", "worded"]
    wide = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = minhash.one_of_each(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect()) == [1, 7, 8, 9]
