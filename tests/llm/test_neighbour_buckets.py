"""Buckets of several polytopes, blocks of crowded buckets, and the best pairs a task keeps."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import cross_polytope


def test_bucket_count_follows_the_rows_and_the_probed_share_falls():
    shares = []
    for rows in (1_000, 60_000, 1_000_000, 10**9):
        counts = cross_polytope.axis_counts(128, rows)
        buckets = int(np.prod([2 * c for c in counts]))
        assert rows / buckets <= cross_polytope.BUCKET and all(c <= 128 for c in counts)
        shares.append(cross_polytope.probe_count(counts, rows) / buckets)
    assert shares == sorted(shares, reverse=True) and shares[-1] < shares[0] / 20
    assert cross_polytope.axis_counts(2, 10**6)[:3] == [2, 2, 2]
    assert cross_polytope.probe_count([1], 1) == 2  # never more than there are


@pytest.mark.parametrize("counts", [[8], [8, 2], [8, 8, 4]])
def test_nearest_buckets_equal_all_buckets_sorted(counts):
    x = np.random.default_rng(3).normal(size=(5, 8))
    found = cross_polytope.axes(x, 1, counts, 30)
    sides = []
    for number, count in enumerate(counts):
        turned = cross_polytope.rotate(x, 1 + 1000 * number)[:, :count]
        sides.append(np.concatenate([turned, -turned], axis=1))
    for row in range(len(x)):
        far = {}
        for pick in itertools.product(*[range(2 * c) for c in counts]):
            code = 0
            for side, at, count in zip(sides, pick, counts):
                code = code * 2 * count + at
            far[code] = sum((side[row].max() - side[row][at]) ** 2 for side, at in zip(sides, pick))
        want = sorted(far.values())[: found.shape[1]]
        assert found.shape[1] == min(30, len(far)) and len(set(found[row])) == found.shape[1]
        assert np.allclose([far[c] for c in found[row].tolist()], want)
    assert (cross_polytope.axes(x, 1, counts, 1)[:, 0] == found[:, 0]).all()


def test_best_pairs_of_a_task():
    query, lead = np.array([2, 1, 1, 1, 1, 2]), np.array([9, 5, 4, 5, 7, 8])
    score = np.array([0.1, 3.0, 3.0, 3.0, 9.0, 0.2])
    got = list(zip(*(a.tolist() for a in cross_polytope.best_of(query, lead, score, 2))))
    assert got == [(1, 7, 9.0), (1, 4, 3.0), (2, 8, 0.2), (2, 9, 0.1)]
    assert all(len(a) == 0 for a in cross_polytope.best_of(*(np.zeros(0, int) for _ in range(3)), 2))


def test_crowded_key_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 50)
    rows = spark.range(1000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("key"), "id", F.lit(b"v").alias("vec"))
    blocks = cross_polytope.packed(rows, ["key"], cross_polytope.crowded(rows, ["key"], "test-crowded"))
    plan = blocks._jdf.queryExecution().toString()
    assert "hashpartitioning(key" in plan and "REPARTITION_BY_COL" in plan
    got = blocks.select("key", "part", F.size("ids").alias("n"), F.explode("ids").alias("id")).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and max(r.n for r in got) < 90
    assert len({r.part for r in got if r.key == 0}) > 10


def test_small_held_pairs_change_nothing(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 20 = 0")
    wide = sorted(map(tuple, cross_polytope.nearest(vectors, asked, 5).collect()))
    monkeypatch.setattr(cross_polytope, "HELD", 40)
    assert sorted(map(tuple, cross_polytope.nearest(vectors, asked, 5).collect())) == wide


def test_single_precision_gives_the_scores_of_its_numbers(spark):
    x = np.random.default_rng(9).normal(size=(60, 8)).astype("<f4")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert cross_polytope.stored_kind(vectors) == "<f4"
    wide = x.astype(float)
    for r in cross_polytope.nearest(vectors, vectors.where("vec_id < 3"), 4).collect():
        assert r.score == pytest.approx(wide[r.query_id] @ wide[r.vec_id], rel=1e-12)
