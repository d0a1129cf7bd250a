"""Stencils on tiles against the same kernels on whole volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import slabs
from voxelloom.plans import analyses

RNG = np.random.default_rng(12)
OPERATORS = [slabs.binary_dilate, slabs.binary_erode, slabs.binary_open, slabs.binary_close, slabs.gaussian_blur_3d, slabs.smooth_rethreshold, slabs.clean_solid]


def pixels_of(slices):
    return {(r.volume_id, r.z): np.frombuffer(r.data, r.dtype).reshape(r.h, r.w) for r in slices.collect()}


@pytest.mark.parametrize("block, tile", [(4, 5), (3, 64)])
def test_tiles_equal_whole_slices(stack, block, tile):
    solid = (RNG.random((9, 13, 11)) > 0.35).astype(np.uint8)
    slices = stack({"a": solid, "b": solid[:1, :2, :2]}).withColumn("z", (F.col("z") + 5).cast("int"))
    for operator in OPERATORS:
        whole, cut = pixels_of(operator(slices, block=50)), pixels_of(operator(slices, block=block, tile=tile))
        assert whole.keys() == cut.keys() and all(np.allclose(whole[k], cut[k]) for k in whole), operator.__name__


def test_fused_chain_equals_its_steps(stack, volume_of):
    solid = (RNG.random((7, 9, 10)) > 0.3).astype(np.uint8)
    slices = stack({"a": solid})
    steps = slabs.smooth_rethreshold(slabs.binary_close(slabs.binary_open(slices)))
    assert np.array_equal(volume_of(slabs.clean_solid(slices), "a"), volume_of(steps, "a"))


def test_group_bytes_do_not_depend_on_the_slice(spark, stack):
    """The largest group of pieces is bounded by block, tile and halo, however large the slices are."""
    sizes = []
    for side in (40, 120):
        pieces = slabs.cut_tiles(stack({"a": np.zeros((3, side, side), np.uint8)}), 16, 7, [])
        groups = pieces.groupBy("volume_id", "_ty", "_tx").agg(F.sum(F.length("_piece")).alias("n"))
        sizes.append(groups.agg(F.max("n")).first()[0])
    assert sizes[0] == sizes[1] == 3 * 30 * 30


@pytest.mark.parametrize("tile", [None, 4])
def test_segmentation_exchanges_the_stencils_once(spark, stack, volume_of, tile):
    slices = stack({"a": RNG.integers(0, 256, (6, 7, 8)).astype(np.uint8)})
    result = analyses.segment_volume(slices, block=4, tile=tile)
    plan = result._jdf.queryExecution().executedPlan().toString()
    # Two rotations and one stencil group their rows by Python kernels.
    assert plan.count("FlatMapGroupsInPandas") == 3
    assert np.array_equal(volume_of(result, "a"), volume_of(analyses.segment_volume(slices, block=50), "a"))


def test_adjusting_in_tiles(spark, stack, volume_of):
    volume = (RNG.random((6, 7, 8)) > 0.6).astype(np.uint8)
    targets = spark.createDataFrame([("up", 0.9), ("down", 0.01)], "volume_id string, target double")
    slices = stack({"up": volume, "down": volume})
    for name in ("up", "down"):
        found = [volume_of(slabs.adjust_porosity(slices, targets, 2, block=b, tile=t), name) for b, t in ((50, None), (2, 3))]
        assert np.array_equal(*found)
