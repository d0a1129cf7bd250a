"""The pipeline's exact search for links: which pairs it makes, and what the bounds on them allow."""

import random

import numpy as np
from pyspark.sql import functions as F

from voxelloom.llm import near_dedup


def test_nodes_meet_once_and_unlike_pairs_are_not_made(spark, monkeypatch):
    """Texts of Jaccard 0.69 share 20 shingles of their prefixes, and 256 parities say nothing of 1,046 shingles."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    most, close = new(860), new(960)
    rows = [" ".join(most + new(190)) for _ in range(6)] + [" ".join(close + new(90)) for _ in range(2)]
    stored = {}

    def store(df, name, keep=near_dedup.store):
        stored[name] = keep(df, name)
        return stored[name]

    monkeypatch.setattr(near_dedup, "store", store)
    texts = spark.createDataFrame(list(enumerate(rows)), "node long, text string")
    alone = spark.createDataFrame([], "node long, root long")
    assert [tuple(r) for r in near_dedup.remaining_links(texts, alone, len(rows)).collect()] == [(6, 7)]
    assert stored["near-tokens"].count() == 8
    assert [tuple(r) for r in stored["near-pairs"].collect()] == [(6, 7)]


def test_coarse_bits_bound_the_difference(spark):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 3, 512, 513, 1000, 1024, 1025, 2040, 2060, 9000)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**64, len(s) // 8, dtype=np.uint64)]) for s in sets]
    bits = near_dedup.coarse_bits(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])).to_pylist()
    assert [len(b) > 0 for b in bits] == [len(s) > 512 for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))]
    assert any(bits[i] and bits[j] and len(bits[i]) != len(bits[j]) for i, j in pairs)
    rows = spark.createDataFrame([(i, j, bits[i], bits[j]) for i, j in pairs], "i int, j int, x array<long>, y array<long>")
    for i, j, apart in rows.select("i", "j", near_dedup.coarsely_apart(F.col("x"), F.col("y"))).collect():
        true = len(set(sets[i].tolist()) ^ set(sets[j].tolist()))
        assert apart <= true and (i != j or apart == 0)
        assert not (bits[i] and bits[j]) or apart % 2 == true % 2


def test_an_order_sample_grows_with_the_texts(spark, monkeypatch):
    """A passage in one text of 40 is put last, also when the least sample is far smaller than the table."""
    n = 6_000
    passage = " ".join(f"p{i}" for i in range(6))
    own = F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id").cast("string")) for c in "abcdefghijkl"])
    texts = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") % 40 == 0, F.concat(F.lit(passage + " "), own)).otherwise(own).alias("text"))
    stored = {}

    def store(df, name, keep=near_dedup.store):
        stored[name] = keep(df, name)
        return stored[name]

    monkeypatch.setattr(near_dedup, "store", store)
    monkeypatch.setattr(near_dedup, "ORDER_SAMPLE", 20)
    assert near_dedup.remaining_links(texts, spark.createDataFrame([], "node long, root long"), n).count() == 0
    assert stored["near-tokens"].count() == 0
