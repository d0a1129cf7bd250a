"""Stacks that start anywhere, have gaps, or hold other pixel types; complete results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_sources import png
from voxelloom import layouts
from voxelloom.operators import histograms, meshes, porosity, rotation, slabs
from voxelloom.plans import analyses
from voxelloom.sources import images as image_sources
from voxelloom.streaming import slices as stream

RNG = np.random.default_rng(3)


def moved(slices, first):
    return slices.withColumn("z", (F.col("z") + first).cast("int"))


@pytest.mark.parametrize("first", [1, 6, 967, -3])
def test_stencils_do_not_depend_on_the_first_slice(stack, volume_of, first):
    volume = (RNG.random((7, 6, 5)) > 0.4).astype(np.uint8)
    slices = stack({"a": volume})
    for operator in (slabs.binary_erode, slabs.binary_dilate, slabs.binary_open, slabs.binary_close, slabs.gaussian_blur_3d, slabs.smooth_rethreshold):
        expected = volume_of(operator(slices, block=4), "a")
        found = operator(moved(slices, first), block=4)
        assert np.array_equal(volume_of(found, "a"), expected), operator.__name__
        assert sorted(r.z for r in found.select("z").collect()) == list(range(first, first + 7))


def test_turned_and_segmented_stacks_do_not_depend_on_the_first_slice(stack, volume_of):
    slices = stack({"a": RNG.integers(0, 256, (6, 5, 8)).astype(np.uint8)})
    for operator in (rotation.rotate_plane, analyses.segment_volume):
        assert np.array_equal(volume_of(operator(moved(slices, 4)), "a"), volume_of(operator(slices), "a"))


def test_gaps_and_mixed_sizes_raise(spark, stack):
    slices = stack({"a": RNG.integers(0, 2, (6, 5, 8)).astype(np.uint8)})
    broken = [slices.where("z <> 3"), slices.withColumn("z", F.when(F.col("z") == 3, 2).otherwise(F.col("z")))]
    sizes = slices.where("z < 3").union(moved(stack({"a": np.zeros((3, 8, 5), np.uint8)}), 3))
    for bad in [*broken, sizes]:
        for operator in (slabs.binary_erode, rotation.rotate_plane, layouts.extent):
            with pytest.raises(Exception, match="slices"):
                operator(bad).collect()
    with pytest.raises(Exception, match="8-bit"):
        rotation.rotate_plane(stack({"a": np.zeros((2, 3, 4), np.uint16)})).collect()


def test_sixteen_bit_and_fractional_pixels(stack):
    volume = RNG.integers(1, 60000, (2, 4, 4)).astype(np.uint16)
    slices = stack({"a": volume})
    counted = {(r.z, r.v): r.n for r in layouts.slices_to_hist(slices).collect()}
    assert sum(counted.values()) == 32 and counted[0, int(volume[0, 0, 0])] == (volume[0] == volume[0, 0, 0]).sum()
    assert sorted(r.v for r in layouts.slices_to_voxels(slices).collect()) == sorted(volume.ravel().tolist())
    joint = porosity.joint_hist_of_slices(slices, stack({"a": (volume > 30000).astype(np.float64)})).collect()
    assert sum(r.n for r in joint) == 32 and all(r.region == (r.v > 30000) for r in joint)
    pores = histograms.otsu_pores(slices, layouts.slices_to_hist(slices)).orderBy("z").collect()
    assert all(r.dtype == "uint8" and len(r.data) == 16 for r in pores)
    for read in (layouts.slices_to_hist, layouts.slices_to_voxels):
        with pytest.raises(Exception, match="whole numbers"):
            read(stack({"a": RNG.random((2, 3, 3))})).collect()


def test_folders_of_one_name_are_two_volumes(spark, tmp_path):
    for parent in ("a", "b"):
        (tmp_path / parent / "stack").mkdir(parents=True)
        for i in range(3):
            (tmp_path / parent / "stack" / f"{i}.png").write_bytes(png(RNG.integers(0, 256, (3, 4)).astype(np.uint8)))
    expected = [(f"{p}/stack", z, f"{z}.png") for p in "ab" for z in range(3)]
    for path in (f"{tmp_path}/*/stack", [f"{tmp_path}/a/stack", f"{tmp_path}/b/stack"], f"{tmp_path}/*/stack/*.png"):
        found = image_sources.read_slice_folder(spark, path).select("volume_id", "z", "name").collect()
        assert sorted(map(tuple, found)) == expected
    (tmp_path / "top.png").write_bytes(png(np.zeros((2, 2), np.uint8)))
    tree = image_sources.read_slice_tree(spark, str(tmp_path)).select("volume_id", "z", "name").collect()
    assert sorted(map(tuple, tree)) == [(v, z, f"{v}/{n}") for v, z, n in expected] + [(tmp_path.name, 0, "top.png")]


def test_results_are_complete(spark, tmp_path):
    values = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("b", 9.0), ("c", None)], "k string, v double")
    found = histograms.edge_histogram(values, ["k"], "v", [0.0, 1.0, 1.5, 2.0]).collect()
    assert sorted(map(tuple, found)) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 1), *[(k, i, 0) for k in "bc" for i in range(3)]]
    points = "cloud string, x double, y double, z double"
    a = spark.createDataFrame([("both", 0.0, 0.0, 0.0), ("left", 1.0, 0.0, 0.0)], points)
    b = spark.createDataFrame([("both", 3.0, 4.0, 0.0), ("right", 1.0, 0.0, 0.0)], points)
    assert sorted(map(tuple, meshes.chamfer_hausdorff(a, b).collect())) == [
        ("both", 5.0, 5.0, "ok"), ("left", None, None, "one_sided"), ("right", None, None, "one_sided"),
    ]
    with pytest.raises(ValueError, match="auto"):
        stream.write_slice_porosity(None, str(tmp_path), str(tmp_path), encoding="auto")
