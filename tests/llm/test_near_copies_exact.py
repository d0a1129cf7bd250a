"""The pipeline's near-dedup stage against all pairs of short texts, where fingerprints miss many."""

import random

import numpy as np
from pyspark.sql import functions as F

from voxelloom.llm import near_dedup


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_no_link_is_left_out(spark):
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    common = [" ".join(new(9)) for _ in range(3)]
    rows = []
    for i in range(250):
        words = new(rng.randint(8, 40))
        if i % 5 == 0:
            words += common[i % 3].split()
        rows.append(" ".join(words))
        for _ in range(rng.randint(1, 2)):  # one in ten of the texts grows at its ends
            extra = new(max(1, len(words) // rng.randint(8, 11)))
            words = words + extra if rng.random() < 0.5 else extra + words
            rows.append(" ".join(words))
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect())
    assert kept == sorted({root(i) for i in range(len(rows))})


# One word more leaves Jaccard 0.8, and 38 to 40 of 128 bits of the fingerprints differ.
FAR = [
    ("w1888 w4400 w2998 w3945 w2019 w1912 w4560 w7812", "x7426"), ("w4235 w7969 w806 w8585 w3636 w6751 w2292 w1652", "x4959"),
    ("w4195 w1282 w8585 w1830 w7232 w6666 w8670 w6308", "x4944"),
]


def test_links_of_far_fingerprints_are_found(spark):
    texts = [t for text, more in FAR for t in (text, f"{text} {more}")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect()) == [0, 2, 4]


def test_prefixes_meet_in_any_order():
    rng = np.random.default_rng(2)
    for _ in range(300):
        size = int(rng.integers(4, 60))
        a = rng.choice(500, size, replace=False)
        gone = int(rng.integers(0, max(1, size // 9) + 1))
        b = np.concatenate([a[gone:], rng.integers(1000, 2000, int(rng.integers(0, max(1, size // 9) + 1)))])
        a, b = np.unique(a).astype(np.uint64), np.unique(b).astype(np.uint64)
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if share < 0.8:
            continue
        often = np.unique(rng.choice(500, 100)).astype(np.uint64)
        counts = rng.integers(3, 50, len(often))
        found, ends, parity = near_dedup.prefixes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), often, counts, 0.8)
        assert set(found[: ends[1]]) & set(found[ends[1] :])
        assert np.bitwise_count(parity[0] ^ parity[1]).sum() <= len(np.setxor1d(a, b))


def test_remaining_links_are_those_between_groups(spark):
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i])) for i in range(4)] + [(9, "something else that nobody else has ever said")]
    texts = spark.createDataFrame(rows, "node long, text string")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    found = near_dedup.remaining_links(texts, roots, 5)
    assert sorted(map(tuple, found.collect())) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert near_dedup.remaining_links(texts.where(F.lit(False)), roots, 0).count() == 0


def test_sketches_bound_the_difference_at_any_size():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 31, 33, 900, 1024, 1025)]
    sets += [np.concatenate([s[: len(s) // 2], rng.integers(0, 2**64, len(s) // 3 + 1, dtype=np.uint64)]) for s in sets]
    sketched = near_dedup.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])).to_pylist()
    for x, i in zip(sketched, sets):
        assert near_dedup.sketched_apart(x, x) == 0
        for y, j in zip(sketched, sets):
            apart = len(set(i.tolist()) ^ set(j.tolist()))
            assert near_dedup.sketched_apart(x, y) <= apart and near_dedup.sketched_apart(x, y) % 2 == apart % 2


def test_whole_sets_are_kept_only_of_close_pairs(spark, monkeypatch):
    """Long texts with Jaccard 0.75 are told apart by their sketches; 256 parities say nothing of them."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    most, close = new(2570), new(2400)
    rows = [" ".join(most + new(430)) for _ in range(12)] + [" ".join(close + new(120)) for _ in range(2)]
    stored = {}

    def store(df, name, keep=near_dedup.store):
        stored[name] = keep(df, name)
        return stored[name]

    monkeypatch.setattr(near_dedup, "store", store)
    texts = spark.createDataFrame(list(enumerate(rows)), "node long, text string")
    alone = spark.createDataFrame([], "node long, root long")
    assert [tuple(r) for r in near_dedup.remaining_links(texts, alone, len(rows)).collect()] == [(12, 13)]
    assert stored["near-pairs"].count() > 1
    assert sorted(r.node for r in stored["near-sets"].collect()) == [12, 13]
