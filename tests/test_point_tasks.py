"""Tasks of the neighbour search grow in number with the points."""

import math
import random

from voxelloom.operators import meshes


def test_points_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    rng = random.Random(6)
    points = [[("c", *(rng.uniform(-5, 5) for _ in "xyz")) for _ in range(n)] for n in (200, 90)]
    a, b = (spark.createDataFrame(p, "cloud string, x double, y double, z double") for p in points)
    partitions = []

    def cut(df, keep=meshes.cut_lineage):
        out = keep(df)
        partitions.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(meshes, "cut_lineage", cut)
    monkeypatch.setattr(meshes, "TASK_POINTS", 4, raising=False)
    got = {(r.x, r.y, r.z): r.distance for r in meshes.nearest_neighbour_distance(a, b).collect()}
    assert max(partitions) >= 50
    assert all(math.isclose(got[p[1:]], min(math.dist(p[1:], q[1:]) for q in points[1])) for p in points[0])
