"""Regions, boxes and normalisation on packed slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import images, porosity, roi
from voxelloom.plans import analyses

RNG = np.random.default_rng(8)


def test_the_region_is_the_brightest_value_of_the_mask_volume(stack, volume_of):
    volume = RNG.integers(0, 256, (3, 4, 5)).astype(np.uint8)
    gray = np.zeros((3, 4, 5), np.uint8)
    gray[:, 1:3, :] = 40
    gray[1:, 1:3, 1:3] = 90
    masks = stack({"a": gray, "b": gray * 0})
    found = analyses.analyze_region_porosity(stack({"a": volume, "b": volume}), masks).collect()
    rows = {r.volume_id: r for r in found}
    assert rows["a"].highlighted_voxels == 8 and rows["b"].highlighted_voxels == 0 and rows["b"].porosity == 0
    limit = volume.astype(float).mean() * 0.8
    assert rows["a"].pore_voxels == ((volume > limit) & (gray == 90)).sum()
    assert np.array_equal(volume_of(porosity.region_slices(masks), "a"), gray == 90)
    wide = analyses.analyze_region_porosity(stack({"a": volume}), stack({"a": gray}), region_above=0).collect()[0]
    assert wide.highlighted_voxels == 30
    # A boolean mask is its own region.
    flags = analyses.analyze_region_porosity(stack({"a": volume}), stack({"a": gray > 0})).collect()[0]
    assert flags.highlighted_voxels == 30


def test_no_pixel_row_crosses_an_exchange(stack):
    volume = RNG.integers(0, 256, (3, 40, 50)).astype(np.uint8)
    joint = porosity.joint_hist_of_slices(stack({"a": volume}), stack({"a": volume // 90}), None)
    plan = joint._jdf.queryExecution().executedPlan().toString()
    assert "mapInPandas" in plan or "MapInPandas" in plan
    assert joint.count() <= 3 * 256
    assert "Exchange" not in roi.bounding_box(stack({"a": volume}))._jdf.queryExecution().executedPlan().toString()


def test_boxes(stack):
    volume = np.zeros((3, 6, 7), np.uint8)
    volume[1, 2:4, 3:6] = 5
    volume[2, 5, 0] = 1
    found = {r.z: tuple(r)[2:] for r in roi.bounding_box(stack({"a": volume})).collect()}
    assert found == {0: (None, None, None, None, True), 1: (2, 3, 3, 5, False), 2: (5, 5, 0, 0, False)}
    assert {r.z: r.empty for r in roi.bounding_box(stack({"a": volume}), 1).collect()} == {0: True, 1: False, 2: True}


@pytest.mark.parametrize("scope", ["slice", "volume"])
def test_fractional_and_wide_slices_become_bytes(stack, volume_of, scope):
    for volume in (RNG.normal(size=(3, 4, 5)) * 1e3, RNG.integers(0, 60000, (3, 4, 5)).astype(np.uint16)):
        volume[1] = 7
        found = volume_of(images.normalize_slices(stack({"a": volume}), scope), "a")
        for z, image in enumerate(volume):
            ends = image if scope == "slice" else volume
            low, high = float(ends.min()), float(ends.max())
            expected = ((image.astype(float) - low) / (high - low) * 255).astype(np.uint8) if high > low else image * 0
            assert found.dtype == np.uint8 and np.array_equal(found[z], expected)
    odd = np.array([[[np.nan, 1.0, 3.0, np.inf]]])
    assert volume_of(images.normalize_slices(stack({"a": odd}), scope), "a").tolist() == [[[0, 0, 255, 0]]]


def test_pairs_flip_alike(stack, volume_of):
    volume = RNG.integers(0, 256, (40, 3, 4)).astype(np.uint8)
    left, right = images.flip_pair(stack({"a": volume}), stack({"a": volume + 1}), 0.5, 0.3, seed=4)
    a, b = volume_of(left, "a"), volume_of(right, "a")
    assert np.array_equal(a + 1, b)
    mirrored = sum(np.array_equal(a[z], volume[z][:, ::-1]) or np.array_equal(a[z], volume[z][::-1, ::-1]) for z in range(40))
    assert 10 < mirrored < 30 and np.array_equal(volume_of(images.flip_pair(stack({"a": volume}), stack({"a": volume}), 0, 0)[0], "a"), volume)
