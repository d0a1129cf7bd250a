"""Point distances with nothing to compare with."""

from voxelloom.operators import meshes

POINTS = "cloud string, x double, y double, z double"


def test_null_coordinates_null_keys_and_empty_sides(spark):
    a = spark.createDataFrame([("c", 0.0, 0.0, 0.0), ("c", 0.0, 0.0, 0.0), ("c", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], POINTS)
    b = spark.createDataFrame([("c", 0.0, 3.0, 4.0), ("c", 0.0, None, 0.0), (None, 1.0, 1.0, 1.0)], POINTS)
    found = meshes.nearest_neighbour_distance(a, b).collect()
    assert sorted(((r.cloud, r.x, r.n, r.distance) for r in found), key=repr) == [
        ("c", 0.0, 2, 5.0), ("c", None, 1, None), (None, 1.0, 1, None),
    ]
    assert {r.distance for r in meshes.nearest_neighbour_distance(a, b.limit(0)).collect()} == {None}
    assert meshes.nearest_neighbour_distance(a.limit(0), b).count() == 0
