"""The three end-to-end analyses: porosity, pore sizes, segmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import pixels
from voxelloom.layouts import check_slices, extent_of_hist, map_slices, slices_to_hist
from voxelloom.operators import histograms, images, porosity, psd, rotation, slabs
from voxelloom.operators.training import ref_slice
from voxelloom.session import broadcast_if_small, cut_lineage


TILE = 512  # side of a stencil tile; slices up to its square travel whole


def analyze_porosity(slices: DataFrame, encoding: str = "auto", percent: bool = True, **rule) -> DataFrame:
    """Porosity of every volume with the spread over its slices; the pixels are read once.

    With ``auto`` the largest value of a volume decides first, so the (small) histogram is stored.
    """
    hist = slices_to_hist(slices)
    if encoding == "auto":
        hist = cut_lineage(hist)
    return porosity.volume_stats(porosity.pore_mask(hist, encoding=encoding, **rule), percent)


def analyze_region_porosity(
    slices: DataFrame, masks: DataFrame, pore_is_white: bool = True, factor: float = 0.8, region_above: float | None = None
) -> DataFrame:
    """Porosity inside a region of mask slices: what is as bright as the mask volume's brightest pixel (a boolean mask: what is
    set), or above ``region_above``.

    The threshold needs the volume mean first; the joint counts are stored so that stack and mask meet once.
    """
    joint = cut_lineage(porosity.joint_hist_of_slices(slices, masks, region_above))
    return porosity.region_porosity(porosity.region_pore_mask(joint, pore_is_white, factor))


def preprocess_image(slices: DataFrame, min_size: int = 10, hole: int = 10, status: bool = False) -> DataFrame:
    """Pore masks: darker than each slice's Otsu threshold, small objects and holes removed.

    With ``status``, slices whose data does not fill them, or that a step fails on, come back without data and with
    an ``error``; the others are not touched by them.
    """
    def clean(image: np.ndarray) -> np.ndarray:
        kept = images.drop_small(image != 0, min_size)
        return ~images.drop_small(~kept, hole)

    if not status:
        return map_slices(histograms.otsu_pores(slices, cut_lineage(slices_to_hist(slices))), clean)
    checked = check_slices(slices)
    good = checked.where("error IS NULL")
    cleaned = map_slices(histograms.otsu_pores(good, cut_lineage(slices_to_hist(good))), clean, status=True)
    lost = checked.where("error IS NOT NULL").select(*cleaned.columns)
    return cleaned.unionByName(lost)


def pore_sizes(masks: DataFrame, bins: int = 8, voxel_size: float = 10.0, method: str = "thickness") -> DataFrame:
    """Pore-size distribution of every mask slice: by inscribed circles, or with ``method='distance'`` by twice the distances.

    Slices that failed before, or have no background, give no rows; ``local_thickness`` and ``diameters`` tell why.
    """
    maps = {"thickness": images.local_thickness, "distance": images.diameters}[method](masks)
    return psd.pore_size_distribution(maps, bins, voxel_size)


def segment_slice(image: np.ndarray, compat: bool) -> np.ndarray:
    """Blur, forward gradient and the two-threshold rule of one image, 1 = solid."""
    weights = slabs.gaussian_weights(0.8)
    smooth = image
    for axis in (0, 1):
        smooth = slabs.blur_axis(smooth, weights, axis, integer=compat)
    smooth = np.round(smooth.astype(np.float64), 9)  # equal sums compare equal in any order
    slope = np.zeros(smooth.shape)
    slope[:, 1:] = np.round(np.diff(smooth, axis=1), 9)
    if compat:
        slope %= 256
    return np.where(smooth > 170, True, np.where(smooth < 40, False, slope > 15.0)).astype(np.uint8)


def segment_volume(
    slices: DataFrame, angle: float = 52, radius: int = 1, first: int | None = None, count: int | None = None,
    compat: bool = False, block: int = slabs.BLOCK, tile: int | None = None,
) -> DataFrame:
    """Rule-based segmentation of 8-bit stacks to 0/1 stacks in the original orientation.

    Histogram matching to the middle slice, turn and reslice along the streaks, per-slice rule, opening, closing and
    smoothing in one exchange, turn back, optional window of slices. ``compat`` keeps byte arithmetic in the
    blur and lets the gradient wrap at 256. A stack may start at any z; the result starts at 0. ``tile`` cuts the stencils'
    blocks in y and x as well; by default they are cut where a turned slice is larger than ``TILE`` squared.
    """
    hist = cut_lineage(slices_to_hist(slices, sizes=True))
    volumes = cut_lineage(extent_of_hist(hist).select("volume_id", "first_z", "n_slices", "h_max", "w_max"))
    starts = broadcast_if_small(volumes.select("volume_id", "first_z"), 500_000)

    def from_zero(rows: DataFrame) -> DataFrame:
        return rows.join(starts, "volume_id").withColumn("z", F.col("z") - F.col("first_z")).drop("first_z")

    table = histograms.match_histogram(cut_lineage(from_zero(hist.drop("h", "w"))), ref_slice(volumes))
    matched = histograms.apply_lookup(from_zero(slices), table)
    aligned = rotation.rotate_plane(matched, angle, swap_after=True, volumes=volumes)
    solid = map_slices(aligned, lambda image: segment_slice(image, compat))
    turned = rotation.turned_depth(volumes, angle, swap_after=True)
    if tile is None:
        largest = turned.join(volumes.select("volume_id", "h_max"), "volume_id").agg(F.max(F.col("h_max").cast("long") * F.col("w_max"))).first()[0]
        tile = TILE if largest and largest > TILE * TILE else None
    smooth = slabs.clean_solid(solid, radius, block=block, tile=tile)
    restored = rotation.rotate_plane(smooth, -angle, binary=True, swap_before=True, volumes=turned)
    if first is None:
        return restored
    kept = restored.where(F.col("z") >= first)
    if count is not None:
        kept = kept.where(F.col("z") < first + count)
    return kept.withColumn("z", F.col("z") - first)


def named(slices: DataFrame, prefix: str = "slice") -> DataFrame:
    """Slices with their standard file names."""
    return slices.withColumn("name", pixels.slice_file_name(F.lit(prefix), "z"))
