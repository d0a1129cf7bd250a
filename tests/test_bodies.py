"""Bodies that cross z-blocks, and the graph step on its own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import bodies

RNG = np.random.default_rng(31)


def flooded(mask):
    labels = np.zeros(mask.shape, int)
    for number, start in enumerate(np.ndindex(*mask.shape)):
        if not mask[start] or labels[start]:
            continue
        todo = [start]
        while todo:
            at = todo.pop()
            if all(0 <= i < n for i, n in zip(at, mask.shape)) and mask[at] and not labels[at]:
                labels[at] = number + 1
                todo += [tuple(i + d * (k == axis) for k, i in enumerate(at)) for axis in range(3) for d in (-1, 1)]
    return labels


@pytest.mark.parametrize("block", [1, 2, 50])
def test_bodies_equal_a_flood_fill(stack, volume_of, block):
    noise = RNG.random((9, 7, 8)) < 0.45
    snake = np.zeros((9, 7, 8), bool)  # up one end, down the other: its parts meet only in the first and last block
    snake[:, 1, 1] = snake[:, 1, 6] = snake[:, 5, 3] = True
    snake[8, 1, 1:7] = True
    snake[0, 1:6, 6] = snake[0, 5, 3:7] = True
    slices = stack({"noise": noise.astype(np.uint8), "snake": snake.astype(np.uint8), "none": np.zeros((3, 2, 2), np.uint8)})
    slices = slices.withColumn("z", (F.col("z") + 4).cast("int"))
    labels = bodies.label_volume(slices, block)
    for name, mask in (("noise", noise), ("snake", snake)):
        assert np.array_equal(volume_of(labels, name), flooded(mask))
    sizes = {(r.volume_id, r.label): r["size"] for r in bodies.body_sizes(labels).collect()}
    found, counts = np.unique(flooded(noise), return_counts=True)
    assert {k: v for k, v in sizes.items() if k[0] == "noise"} == {("noise", int(f)): int(c) for f, c in zip(found, counts) if f}
    assert [v for k, v in sizes.items() if k[0] == "snake"] == [snake.sum()]


def test_smallest_reachable(spark):
    rng = random.Random(3)
    edges = [("p", i, i + 1) for i in range(100, 160)] + [("p", 7, rng.randrange(200, 400)) for _ in range(300)]
    edges += [("q", rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [("p", 5, 5)]
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for k, a, b in edges:
        if a != b:
            x, y = sorted((find((k, a)), find((k, b))))
            root[y] = x
    frame = spark.createDataFrame(edges, "k string, a long, b long")
    found = {(r.k, r.node): r.root for r in bodies.smallest_reachable(frame, ["k"]).collect()}
    assert found == {n: find(n)[1] for n in root}
    assert bodies.smallest_reachable(frame.limit(0), ["k"]).count() == 0
