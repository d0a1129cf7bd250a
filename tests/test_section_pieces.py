"""Section areas of any triangles against the plain rule, one triangle and plane at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxelloom.operators import meshes
from voxelloom.sources import testdata

NAMES = [f"{p}{d}" for p in "abc" for d in "xyz"]


def ends(triangle, axis, u, v, pos):
    """Where the rising and the falling edge meet the plane; corners count half-open."""
    found = {}
    for p, q in ((0, 1), (1, 2), (2, 0)):
        hp, hq = triangle[p][axis], triangle[q][axis]
        for name, low, high in (("rising", hp, hq), ("falling", hq, hp)):
            if low < pos <= high:
                t = (pos - hp) / (hq - hp)
                found[name] = [triangle[p][d] + (triangle[q][d] - triangle[p][d]) * t for d in (u, v)]
    return found


@pytest.mark.parametrize("axis", ["x", "y", "z"])
def test_any_triangles(spark, axis):
    rng = random.Random(ord(axis))
    k = "xyz".index(axis)
    u, v = {0: (1, 2), 1: (2, 0), 2: (0, 1)}[k]
    meshes_of = {f"m{m}": [[[rng.choice([rng.uniform(-9, 9), rng.randint(-3, 3)]) for _ in "xyz"] for _ in "abc"] for _ in range(40)] for m in range(3)}
    rows = [(m, *map(float, sum(t, []))) for m, ts in meshes_of.items() for t in ts]
    table = spark.createDataFrame(rows, "mesh_id string, " + ", ".join(f"{c} double" for c in NAMES))
    n, margin = 11, 0.25
    got = {(r.mesh_id, r.plane): (r.position, r.area) for r in meshes.mesh_section_area(table, n, axis, margin).collect()}
    want = {}
    for m, triangles in meshes_of.items():
        lo, hi = min(c[k] for t in triangles for c in t) + margin, max(c[k] for t in triangles for c in t) - margin
        for plane in range(n):
            pos = hi if plane == n - 1 else lo + plane * ((hi - lo) / (n - 1))
            for t in triangles:
                found = ends(t, k, u, v, pos)
                if found:
                    f, r = found["falling"], found["rising"]
                    want[m, plane] = (pos, want.get((m, plane), (pos, 0.0))[1] + (f[0] * r[1] - f[1] * r[0]) / 2)
    assert got.keys() == want.keys()
    for key, (position, area) in want.items():
        assert math.isclose(got[key][0], position) and math.isclose(got[key][1], area, rel_tol=1e-9, abs_tol=1e-9)


def test_a_missing_height_keeps_its_planes(spark):
    table = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 1.0, 0.0, None, 0.0, 1.0, 4.0)], "mesh_id string, " + ", ".join(f"{c} double" for c in NAMES))
    assert [(r.plane, r.area) for r in meshes.mesh_section_area(table, 3, "z", 0.5).orderBy("plane").collect()] == [(0, None), (1, None), (2, None)]


def test_triangles_of_equal_heights_are_one_row(spark, sf_dir):
    """The sides of a box are added up before any shuffle: meshes of one height have one row, however many triangles."""
    triangles = testdata.box_triangles(spark, sf_dir)
    pieces = meshes._section_pieces(triangles, "z", "x", "y")
    heights = testdata.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax").distinct().count()
    assert pieces.count() == heights < triangles.count() / 10
    assert pieces.select(F.max("from")).first()[0] == 0.0
