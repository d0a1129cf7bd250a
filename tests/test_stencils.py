"""Neighbourhood operators against plain loops on small volumes."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelloom.operators import images, rotation, slabs
from voxelloom.plans import analyses

RNG = np.random.default_rng(5)
CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def at(volume, *index):
    return bool(volume[index]) if all(0 <= i < n for i, n in zip(index, volume.shape)) else False


def looped(volume, rule):
    out = np.zeros(volume.shape, np.uint8)
    for index in np.ndindex(*volume.shape):
        out[index] = rule(at(volume, *(i + o for i, o in zip(index, offset))) for offset in CROSS)
    return out


@pytest.mark.parametrize("block", [1, 2, 5, 16])
def test_dilate_and_erode_do_not_depend_on_the_block(stack, volume_of, block):
    volume = (RNG.random((7, 6, 5)) > 0.35).astype(np.uint8)
    slices = stack({"a": volume, "b": volume[:3]})
    for operator, rule in ((slabs.binary_dilate, any), (slabs.binary_erode, all)):
        expected = looped(looped(volume, rule), rule)
        assert np.array_equal(volume_of(operator(slices, 2, block), "a"), expected)
        assert np.array_equal(volume_of(operator(slices, 1, block), "b"), looped(volume[:3], rule))


@pytest.mark.parametrize("block", [2, 16])
def test_open_and_close(stack, volume_of, block):
    volume = (RNG.random((8, 6, 6)) > 0.3).astype(np.uint8)
    slices = stack({"a": volume})
    assert np.array_equal(volume_of(slabs.binary_open(slices, 1, block), "a"), looped(looped(volume, all), any))
    assert np.array_equal(volume_of(slabs.binary_close(slices, 1, block), "a"), looped(looped(volume, any), all))


def test_larger_ball():
    solid = np.zeros((7, 7, 7), bool)
    solid[3, 3, 3] = True
    grown = slabs.spread_ball(solid, 2)
    z, y, x = np.indices(solid.shape) - 3
    assert np.array_equal(grown, z * z + y * y + x * x <= 4)
    assert np.array_equal(slabs.shrink_ball(grown, 2), solid)


@pytest.mark.parametrize("block", [2, 3, 16])
def test_gaussian_blur_3d_mirrors_the_ends(stack, volume_of, block):
    volume = RNG.integers(0, 256, (5, 6, 7)).astype(np.uint8)
    taps = slabs.gaussian_weights(0.7)
    radius = len(taps) // 2
    expected = np.zeros(volume.shape)
    mirrored = np.pad(volume.astype(float), radius, mode="symmetric")
    for dz, dy, dx in itertools.product(range(len(taps)), repeat=3):
        part = mirrored[dz : dz + 5, dy : dy + 6, dx : dx + 7]
        expected += taps[dz] * taps[dy] * taps[dx] * part
    blurred = volume_of(slabs.gaussian_blur_3d(stack({"a": volume}), 0.7, block), "a")
    assert np.allclose(blurred, expected)
    assert abs(taps.sum() - 1) < 1e-12 and radius == 3


def test_gradient_wrap(stack, volume_of):
    slices = stack({"a": np.array([[[100, 90]]], np.uint8)})
    assert volume_of(slabs.forward_gradient(slices), "a").tolist() == [[[0, -10]]]
    assert volume_of(slabs.forward_gradient(slices, wrap=True), "a").tolist() == [[[0, 246]]]


def test_integer_blur_truncates_after_each_axis():
    image = RNG.integers(0, 256, (5, 6)).astype(np.uint8)
    weights = slabs.gaussian_weights(0.8)
    first = slabs.blur_axis(image, weights, 0, integer=True)
    assert first.dtype == np.uint8
    assert np.array_equal(first, np.floor(slabs.blur_axis(image, weights, 0)).astype(np.uint8))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.floats(0.05, 0.95), st.integers(1, 9), st.integers(1, 9))
def test_labels_and_distances_equal_brute_force(seed, share, h, w):
    mask = np.random.default_rng(seed).random((h, w)) < share
    labels = images.label_components(mask)
    seen = np.zeros(mask.shape, int)
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        number, queue = start[0] * w + start[1] + 1, [start]
        while queue:
            y, x = queue.pop()
            if 0 <= y < h and 0 <= x < w and mask[y, x] and not seen[y, x]:
                seen[y, x] = number
                queue += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    assert np.array_equal(labels, seen)
    if (~mask).any():
        y, x = np.indices(mask.shape)
        zeros = np.argwhere(~mask)
        brute = ((y[..., None] - zeros[:, 0]) ** 2 + (x[..., None] - zeros[:, 1]) ** 2).min(axis=-1)
        assert np.array_equal(images.squared_distance(mask), brute)
        thick = np.zeros(mask.shape)
        for cy, cx in np.argwhere(mask):
            disc = ((y - cy) ** 2 + (x - cx) ** 2 < brute[cy, cx]) & mask
            thick[disc] = np.maximum(thick[disc], 2 * np.sqrt(brute[cy, cx]))
        assert np.allclose(images.thickness(mask), thick)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**31))
def test_erosion_is_inside_and_opening_repeats(seed):
    mask = np.random.default_rng(seed).random((4, 6, 6)) < 0.6
    opened = slabs.spread_cross(slabs.shrink_cross(mask))
    assert not (slabs.shrink_cross(mask) & ~mask).any() and not (mask & ~slabs.spread_cross(mask)).any()
    assert np.array_equal(slabs.spread_cross(slabs.shrink_cross(opened)), opened)


def test_adjusting_moves_each_volume_to_its_target(spark, stack, volume_of):
    volume = (RNG.random((6, 7, 8)) > 0.6).astype(np.uint8)
    near = float(volume.mean())
    targets = spark.createDataFrame([("up", 0.9), ("down", 0.01), ("stay", near + 0.001)], "volume_id string, target double")
    moved = slabs.adjust_porosity(stack({"up": volume, "down": volume, "stay": volume}), targets, rounds=3, block=2)
    grown = volume.astype(bool)
    for _ in range(3):
        share = grown.mean()
        grown = grown if abs(share - 0.9) < 0.002 else slabs.spread_cross(grown) if share < 0.9 else slabs.shrink_cross(grown)
    assert np.array_equal(volume_of(moved, "up"), grown)
    shrunk = volume.astype(bool)
    for _ in range(3):
        share = shrunk.mean()
        shrunk = shrunk if abs(share - 0.01) < 0.002 else slabs.spread_cross(shrunk) if share < 0.01 else slabs.shrink_cross(shrunk)
    assert np.array_equal(volume_of(moved, "down"), shrunk)
    assert np.array_equal(volume_of(moved, "stay"), volume)


def turned(volume, angle, binary):
    """Rotation in (z, x), one output voxel at a time."""
    (oz, ox), at_z, at_x = rotation.turned_geometry(volume.shape[0], volume.shape[2], angle)
    out = np.zeros((oz, volume.shape[1], ox))
    for z, y, x in np.ndindex(out.shape):
        sz, sx = at_z[z, x], at_x[z, x]
        if not (0 <= sz <= volume.shape[0] - 1 and 0 <= sx <= volume.shape[2] - 1):
            continue
        for iz, ix in itertools.product((int(sz), int(sz) + 1), (int(sx), int(sx) + 1)):
            if iz < volume.shape[0] and ix < volume.shape[2]:
                out[z, y, x] += volume[iz, y, ix] * (1 - abs(sz - iz)) * (1 - abs(sx - ix))
    return (out > 0.5).astype(np.uint8) if binary else np.floor(out + 0.5).astype(np.uint8)


@pytest.mark.parametrize("lines, tile", [(1, 1024), (4, 3), (4, 5)])
def test_rotation_and_swaps(stack, volume_of, lines, tile):
    volume = RNG.integers(0, 256, (5, 6, 7)).astype(np.uint8)
    slices = stack({"a": volume})
    plain = volume_of(rotation.rotate_plane(slices, 52, lines=lines, tile=tile), "a")
    assert np.array_equal(plain, turned(volume, 52, False))
    swapped = volume_of(rotation.rotate_plane(slices, 52, swap_after=True, lines=lines, tile=tile), "a")
    assert np.array_equal(swapped, plain.transpose(2, 1, 0))
    mask = (volume > 99).astype(np.uint8)
    before = volume_of(rotation.rotate_plane(stack({"a": mask}), -52, binary=True, swap_before=True), "a")
    assert np.array_equal(before, turned(mask.transpose(2, 1, 0), -52, True))


def test_quarter_turn_is_exact(stack, volume_of):
    volume = RNG.integers(0, 256, (4, 3, 4)).astype(np.uint8)
    result = volume_of(rotation.rotate_plane(stack({"a": volume}), 90), "a")
    assert np.array_equal(result, np.rot90(volume, 1, axes=(0, 2)))


@pytest.mark.parametrize("compat", [False, True])
def test_segment_volume_equals_the_steps_in_memory(stack, volume_of, compat):
    z, y, x = np.indices((9, 6, 8))
    noise = RNG.integers(0, 60, (9, 6, 8))
    volume = np.where((x - 4) ** 2 + (z - 4) ** 2 < 10, 30, 190).astype(int) + noise + z
    volume = np.clip(volume, 0, 255).astype(np.uint8)

    reference = volume[len(volume) // 2]
    values, counts = np.unique(reference, return_counts=True)
    quantiles = np.cumsum(counts) / reference.size
    matched = np.zeros_like(volume)
    for i, image in enumerate(volume):
        own, inverse, n = np.unique(image, return_inverse=True, return_counts=True)
        matched[i] = np.interp(np.cumsum(n) / image.size, quantiles, values)[inverse.reshape(image.shape)]
    aligned = turned(matched, 52, False).transpose(2, 1, 0)
    solid = np.stack([analyses.segment_slice(np.ascontiguousarray(image), compat) for image in aligned]).astype(bool)
    opened = slabs.spread_cross(slabs.shrink_cross(solid))
    closed = slabs.shrink_cross(slabs.spread_cross(opened)).astype(float)
    for axis in range(3):
        closed = slabs.blur_axis(closed, slabs.gaussian_weights(0.7), axis)
    expected = turned((closed > 0.5).astype(np.uint8).transpose(2, 1, 0), -52, True)

    restored = analyses.segment_volume(stack({"a": volume}), compat=compat, block=4)
    assert np.array_equal(volume_of(restored, "a"), expected)
    window = analyses.segment_volume(stack({"a": volume}), compat=compat, first=2, count=3)
    assert np.array_equal(volume_of(window, "a"), expected[2:5])
