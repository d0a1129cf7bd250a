"""Linear distance transforms, circles radius by radius, and slices that fail without ending the job."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom import layouts
from voxelloom.operators import images
from voxelloom.plans import analyses

RNG = np.random.default_rng(21)


def test_lower_envelope_equals_all_pairs():
    for n, high in ((1, 5), (2, 9), (17, 3), (40, 400), (33, 2000)):
        heights = RNG.integers(0, high, (12, n)).astype(np.int64) ** 2
        heights[3] = images.UNREACHED
        i = np.arange(n)
        brute = ((i[:, None] - i) ** 2 + heights[:, None, :]).min(axis=2)
        assert np.array_equal(images.lower_envelope(heights), brute)
    assert images.lower_envelope(np.zeros((0, 4), np.int64)).shape == (0, 4)


@pytest.mark.parametrize("share", [0.5, 0.99, 0.9995])
def test_distances_of_far_pixels(share):
    mask = RNG.random((40, 90)) < share
    mask[7, 80] = False
    y, x = np.indices(mask.shape)
    zeros = np.argwhere(~mask)
    brute = ((y[..., None] - zeros[:, 0]) ** 2 + (x[..., None] - zeros[:, 1]) ** 2).min(axis=-1)
    assert np.array_equal(images.squared_distance(mask), brute)
    covered = np.zeros(mask.shape)
    for cy, cx in np.argwhere(mask):
        disc = (y - cy) ** 2 + (x - cx) ** 2 < brute[cy, cx]
        covered[disc] = np.maximum(covered[disc], 2 * np.sqrt(brute[cy, cx]))
    assert np.allclose(images.thickness(mask), covered)


def test_distance_time_is_linear_in_the_width():
    def seconds(width):
        mask = np.ones((64, width), bool)
        mask[:, 0] = False
        best = 1e9
        for _ in range(3):
            started = time.perf_counter()
            found = images.squared_distance(mask)
            best = min(best, time.perf_counter() - started)
        assert found[5, -1] == (width - 1) ** 2
        return best

    assert seconds(4000) < 8 * seconds(1000)


def test_distance_in_three_dimensions(stack, volume_of):
    volume = (RNG.random((7, 6, 9)) < 0.93).astype(np.uint8)
    volume[:3] = 1
    slices = stack({"a": volume, "full": np.ones((3, 2, 2), np.uint8)}).withColumn("z", (F.col("z") + 4).cast("int"))
    z, y, x = np.indices(volume.shape)
    holes = np.argwhere(volume == 0)
    brute = sum((i[..., None] - holes[:, k]) ** 2 for k, i in enumerate((z, y, x))).min(axis=-1)
    for group_bytes in (1, 500, 1 << 20):
        found = images.edt_3d(slices, group_bytes)
        assert np.allclose(volume_of(found, "a"), np.sqrt(brute))
        lost = found.where("volume_id = 'full'").collect()
        assert [r.error for r in lost] == ["no background voxel"] * 3 and all(r.data is None for r in lost)


def test_slices_without_background_have_a_status(stack):
    slices = stack({"a": np.stack([np.ones((5, 6), np.uint8), np.eye(5, 6, dtype=np.uint8)])})
    for operator in (images.edt, images.local_thickness, images.diameters):
        rows = {r.z: r for r in operator(slices).collect()}
        assert rows[0].data is None and rows[0].error == "no background pixel" and rows[1].error is None and rows[1].data is not None
    for method in ("thickness", "distance"):
        assert {r.z for r in analyses.pore_sizes(slices, method=method).collect()} == {1}


def test_one_bad_slice_leaves_the_rest(stack):
    volume = RNG.integers(0, 256, (5, 12, 14)).astype(np.uint8)
    slices = stack({"a": volume})
    cut = slices.withColumn("data", F.when(F.col("z") == 2, F.col("data").substr(1, 50)).when(F.col("z") == 3, F.lit(None)).otherwise(F.col("data")))
    whole = {r.z: bytes(r.data) for r in analyses.preprocess_image(slices).collect()}
    found = analyses.preprocess_image(cut, status=True)
    rows = {r.z: r for r in found.collect()}
    assert sorted(rows) == list(range(5)) and all(bytes(rows[z].data) == whole[z] and rows[z].error is None for z in (0, 1, 4))
    assert rows[2].error == "data does not fill the slice" and rows[3].error == "no data" and rows[2].data is None
    assert sorted(tuple(r) for r in layouts.failures(found).collect()) == [("a", "data does not fill the slice", 1, 2), ("a", "no data", 1, 3)]
    sizes = {(r.z, r.bin): r.p for r in analyses.pore_sizes(found).collect()}
    expected = {(r.z, r.bin): r.p for r in analyses.pore_sizes(analyses.preprocess_image(slices)).collect() if r.z in (0, 1, 4)}
    assert sizes == expected
    # Errors pass through later kernels and pairs.
    again = images.drop_failed(layouts.map_slices(found, lambda image: 1 - image, status=True))
    assert sorted(r.z for r in again.collect()) == [0, 1, 4]
    pairs = layouts.zip_slices(found, layouts.check_slices(cut), lambda a, b: a + (b > 9), status=True).collect()
    assert sorted((r.z, r.error) for r in pairs if r.error) == [(2, "data does not fill the slice"), (3, "no data")]
    with pytest.raises(Exception, match="cannot reshape"):
        layouts.map_slices(cut.where("z = 2"), lambda image: image).collect()
