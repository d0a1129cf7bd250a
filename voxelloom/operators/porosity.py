"""Porosity of volumes, slices and regions, all computed on value histograms.

A histogram row ``(volume_id, z, v, n)`` stands for ``n`` pixels, so every statistic here shuffles a few
hundred rows per slice and never a pixel. Any of the two other layouts is reduced to it first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA, image_of, small_batches, whole_pixels
from voxelloom.session import broadcast_if_small, cut_lineage

VOLUME = ["volume_id"]
SLICE = ["volume_id", "z"]


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """scale * part / whole, null when the whole is empty. Only the division rounds: a share that ends in few digits is exact."""
    return part.cast("double") * F.lit(scale) / F.nullif(whole, F.lit(0)).cast("double")


def mean_share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """Mean of the shares of a group's rows, empty wholes left out. Added up with 18 decimals, so that neither the order of
    the rows nor the rounding of each share moves a mean that lies on a rounding limit."""
    scaled = (part.cast("long") * F.lit(int(scale))).cast("decimal(20,0)")
    return F.avg(scaled / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")).cast("double")


def _spread_of_counts(scale: float) -> list[Column]:
    """min, max, mean and population deviation of the shares ``pores / total`` of a group's rows."""
    p = share(F.col("pores"), F.col("total"), scale)
    return [
        F.min(p).alias("min_porosity"), F.max(p).alias("max_porosity"),
        mean_share(F.col("pores"), F.col("total"), scale).alias("mean_porosity"), F.stddev_pop(p).alias("std_porosity"),
    ]


def solid_rule(v: str = "v", v_max: str = "v_max", encoding: str = "auto", threshold: float | None = None) -> Column:
    """Is a value solid (bright)?

    ``bool``: non-zero. ``unit``: above 0.5. ``u8``: above ``threshold`` (127 when not given). ``auto``
    takes ``unit`` for volumes whose largest value is at most 1, else ``u8``.
    """
    unit = F.col(v) > 0.5
    u8 = F.col(v) > F.lit(127.0 if threshold is None else float(threshold))
    rules = {"bool": F.col(v) != 0, "unit": unit, "u8": u8}
    if encoding != "auto":
        return rules[encoding]
    return F.when(F.col(v_max) <= 1, unit).otherwise(u8)


def pore_mask(
    values: DataFrame,
    v: str = "v",
    encoding: str = "auto",
    pores_are_black: bool = True,
    threshold: float | None = None,
) -> DataFrame:
    """Add ``pore`` (boolean) to a histogram or voxel table."""
    if encoding == "auto":
        tops = values.groupBy("volume_id").agg(F.max(v).alias("v_max"))
        values = values.join(tops, "volume_id")
    solid = solid_rule(v, "v_max", encoding, threshold)
    marked = values.withColumn("pore", ~solid if pores_are_black else solid)
    return marked.drop("v_max") if encoding == "auto" else marked


def pore_counts(marked: DataFrame, keys: list[str] = SLICE, n: str = "n") -> DataFrame:
    """Pore and total pixel counts per key."""
    return marked.groupBy(*keys).agg(
        F.sum(F.when(F.col("pore"), F.col(n)).otherwise(0)).alias("pores"), F.sum(n).alias("total")
    )


def volume_porosity(marked: DataFrame, percent: bool = True) -> DataFrame:
    """Pore share of all pixels of a volume."""
    scale = 100.0 if percent else 1.0
    counts = pore_counts(marked, VOLUME)
    return counts.select("volume_id", share(F.col("pores"), F.col("total"), scale).alias("porosity"))


def slice_porosity(marked: DataFrame, axis: str = "z", percent: bool = True) -> DataFrame:
    """Pore share per slice along an axis (``x`` and ``y`` need a voxel table with ``n`` = 1)."""
    scale = 100.0 if percent else 1.0
    counts = pore_counts(marked, ["volume_id", axis])
    return counts.select("volume_id", axis, share(F.col("pores"), F.col("total"), scale).alias("porosity"))


def spread(per_slice: DataFrame, value: str = "porosity") -> DataFrame:
    """min, max, mean and population deviation over the slices of each volume."""
    return per_slice.groupBy("volume_id").agg(
        F.min(value).alias("min_porosity"),
        F.max(value).alias("max_porosity"),
        F.avg(value).alias("mean_porosity"),
        F.stddev_pop(value).alias("std_porosity"),
        F.count(value).alias("n_slices"),
    )


def slice_porosity_stats(marked: DataFrame, axis: str = "z", percent: bool = True) -> DataFrame:
    """Spread of the slice porosity along an axis; the series itself is ``slice_porosity``."""
    counts = pore_counts(marked, ["volume_id", axis])
    valid = F.count(F.nullif(F.col("total"), F.lit(0))).alias("n_slices")
    return counts.groupBy("volume_id").agg(*_spread_of_counts(100.0 if percent else 1.0), valid)


def volume_stats(marked: DataFrame, percent: bool = True) -> DataFrame:
    """Volume porosity and its spread over slices, from one aggregation of the input."""
    scale = 100.0 if percent else 1.0
    return pore_counts(marked).groupBy("volume_id").agg(
        share(F.sum("pores"), F.sum("total"), scale).alias("porosity"), *_spread_of_counts(scale),
        F.count(F.nullif(F.col("total"), F.lit(0))).alias("n_slices"),
    )


def volume_and_slice_report(marked: DataFrame) -> DataFrame:
    """Volume rows (z null) and slice rows in one job.

    The pixels are counted once per slice; the rollup then runs over those few rows.
    """
    return (
        pore_counts(marked)
        .rollup("volume_id", "z")
        .agg(F.sum("pores").alias("pores"), F.sum("total").alias("total"), F.grouping_id().alias("level"))
        .where("level < 3")
        .select(
            "volume_id", "z", F.when(F.col("level") == 0, "slice").otherwise("volume").alias("level"), "pores", "total",
            share(F.col("pores"), F.col("total"), 100.0).alias("porosity"),
        )
    )


def sum_porosity(hist: DataFrame) -> DataFrame:
    """Sum of values over pixel count, in percent (only meaningful for 0/1 data)."""
    return hist.groupBy("volume_id").agg(
        share(F.sum(F.col("v") * F.col("n")), F.sum("n"), 100.0).alias("porosity")
    )


def solid_fraction(marked: DataFrame) -> DataFrame:
    """Share of solid pixels per volume."""
    return volume_porosity(marked, percent=False).select("volume_id", (F.lit(1.0) - F.col("porosity")).alias("solid"))


def slice_summary(hist: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """min, max, mean and population deviation of the values per slice, from counts."""
    v, n = F.col("v").cast("double"), F.col("n").cast("double")
    sums = hist.groupBy(*keys).agg(
        F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.sum("n").alias("n_pixels"),
        F.sum(v * n).alias("_s1"), F.sum(v * v * n).alias("_s2"),
    )
    mean = F.col("_s1") / F.col("n_pixels")
    variance = F.greatest(F.lit(0.0), F.col("_s2") / F.col("n_pixels") - mean * mean)
    return sums.select(*keys, "v_min", "v_max", "n_pixels", mean.alias("v_mean"), F.sqrt(variance).alias("v_std"))


def highlight_mask(voxels: DataFrame, v: str = "v") -> DataFrame:
    """Add ``region``: pixels equal to the largest value of their volume, none if that value is 0."""
    tops = voxels.groupBy("volume_id").agg(F.max(v).alias("_top"))
    return (
        voxels.join(tops, "volume_id")
        .withColumn("region", (F.col(v) == F.col("_top")) & (F.col("_top") > 0))
        .drop("_top")
    )


def highlight_threshold(voxels: DataFrame, v: str = "v", threshold: float = 0) -> DataFrame:
    """Add ``region``: pixels above a threshold."""
    return voxels.withColumn("region", F.col(v) > F.lit(threshold))


def volume_tops(slices: DataFrame) -> DataFrame:
    """(volume_id, top): the largest pixel of every volume; each slice gives one number."""
    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            tops = [float(image_of(row).max(initial=0)) for row in batch.itertuples(index=False)]
            yield pd.DataFrame({"volume_id": batch["volume_id"], "top": tops})

    per_slice = slices.where("data IS NOT NULL").select("volume_id", "h", "w", "dtype", "data").mapInPandas(largest, "volume_id string, top double")
    return per_slice.groupBy("volume_id").agg(F.max("top").alias("top"))


def _inside(image: np.ndarray, top: float | None, above: float | None) -> np.ndarray:
    """Region pixels: above a value; else non-zero ones of a boolean mask, the brightest ones of any other (none if all are 0)."""
    if above is not None:
        return image > above
    return image if image.dtype == bool else (image == top) & (image > 0)


def _with_tops(masks: DataFrame, above: float | None) -> DataFrame:
    if above is not None:
        return masks.withColumn("top", F.lit(None).cast("double"))
    return masks.join(broadcast_if_small(cut_lineage(volume_tops(masks)), 500_000), "volume_id", "left")


def region_slices(masks: DataFrame, above: float | None = None) -> DataFrame:
    """Packed 0/1 regions of a mask stack: what is as bright as its volume's brightest pixel, or above a value.

    The brightest value needs a pass of its own over the masks; one number a slice leaves the scan.
    """
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            packed = [_inside(image_of(row), row.top, above).astype(np.uint8).tobytes() for row in batch.itertuples(index=False)]
            yield batch[SLICE_COLUMNS].assign(dtype="uint8", data=packed)

    return _with_tops(masks.select(*SLICE_COLUMNS), above).mapInPandas(mark, SLICE_SCHEMA)


def joint_hist_of_slices(stack: DataFrame, mask: DataFrame, region_above: float | None = 0) -> DataFrame:
    """Counts per (volume, slice, value, in region): one row per slice crosses the shuffle instead of its pixels.

    Mask values above ``region_above`` are inside; with None those as bright as the mask volume's brightest one (see
    ``region_slices``). Both images are cut to their common size.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            for row in batch.itertuples(index=False):
                h, w = min(row.h, row.mask_h), min(row.w, row.mask_w)
                image = whole_pixels(row)[:h, :w].astype(np.int64)
                marks = np.frombuffer(row.mask, np.dtype(row.mask_dtype)).reshape(row.mask_h, row.mask_w)[:h, :w]
                cell, counts = np.unique(2 * image + _inside(marks, row.top, region_above), return_counts=True)
                yield pd.DataFrame(
                    {"volume_id": row.volume_id, "z": np.int32(row.z), "v": cell // 2, "region": cell % 2 == 1, "n": counts}
                )

    masks = _with_tops(mask.select(*SLICE_COLUMNS), region_above).select(
        "volume_id", "z", F.col("h").alias("mask_h"), F.col("w").alias("mask_w"), F.col("dtype").alias("mask_dtype"), F.col("data").alias("mask"), "top"
    )
    pairs = stack.select("volume_id", "z", "h", "w", "dtype", "data").join(masks, ["volume_id", "z"])
    return pairs.mapInPandas(count, "volume_id string, z int, v int, region boolean, n bigint")


def region_pore_mask(joint: DataFrame, pore_is_white: bool = True, factor: float = 0.8) -> DataFrame:
    """Add ``pore``: value above (white) or below (dark) the volume mean times ``factor``, inside the region."""
    v, n = F.col("v").cast("double"), F.col("n").cast("double")
    limits = joint.groupBy("volume_id").agg((F.sum(v * n) / F.sum(n) * F.lit(factor)).alias("_limit"))
    hit = F.col("v") > F.col("_limit") if pore_is_white else F.col("v") < F.col("_limit")
    return joint.join(limits, "volume_id").withColumn("pore", hit & F.col("region")).drop("_limit")


def porosity_profile(region_marked: DataFrame) -> DataFrame:
    """Region porosity and region size of every slice that has region pixels."""
    counts = pore_counts(region_marked.where("region"))
    return counts.select(
        "volume_id", "z", share(F.col("pores"), F.col("total"), 100.0).alias("porosity"),
        F.col("pores").alias("pore_voxels"), F.col("total").alias("region_voxels"),
    )


def region_porosity(region_marked: DataFrame) -> DataFrame:
    """Region porosity per volume with its spread over slices; zeros where a volume has no region pixel.

    Slices without region pixels keep their volume in the result but not in the spread.
    """
    inside = F.when(F.col("region"), F.col("n")).otherwise(0)
    per_slice = region_marked.groupBy("volume_id", "z").agg(
        F.sum(F.when(F.col("pore"), inside).otherwise(0)).alias("pores"), F.sum(inside).alias("total")
    )
    return per_slice.groupBy("volume_id").agg(
        share(F.sum("pores"), F.sum("total"), 100.0).alias("porosity"), *_spread_of_counts(100.0),
        F.sum("total").alias("highlighted_voxels"), F.sum("pores").alias("pore_voxels"),
    ).na.fill(0)


def side_by_side(left_hist: DataFrame, right_hist: DataFrame) -> DataFrame:
    """Value statistics of two stacks aligned by slice, up to the shorter one."""
    a, b = slice_summary(left_hist), slice_summary(right_hist)
    stats = ["v_min", "v_max", "v_mean", "v_std"]
    a = a.select("volume_id", "z", *[F.col(c).alias(f"left_{c}") for c in stats])
    b = b.select("volume_id", "z", *[F.col(c).alias(f"right_{c}") for c in stats])
    return a.join(b, ["volume_id", "z"])


def _report(stats: DataFrame, head: list[Column], slices_title: str) -> DataFrame:
    """Numbered text lines per volume: a head, then the spread over slices."""
    parts = [("Min", "min_porosity"), ("Max", "max_porosity"), ("Mean", "mean_porosity"), ("StdDev", "std_porosity")]
    spread_lines = [F.format_string(f"  {name}: %.4f%%", F.col(column)) for name, column in parts]
    lines = F.array(*head, F.lit(slices_title), *spread_lines)
    return stats.select("volume_id", F.posexplode(lines).alias("line_no", "line"))


def format_report(stats: DataFrame, label: str) -> DataFrame:
    """The text lines of a porosity report, numbered per volume, four decimals."""
    title = F.lit(f"=== {label} Porosity Analysis ===")
    overall = F.format_string("Overall porosity: %.4f%%", F.col("porosity"))
    return _report(stats, [title, F.lit(""), overall], "Slice porosity:")


def format_region_report(stats: DataFrame, label: str) -> DataFrame:
    """The same for a region, with its voxel counts."""
    head = [
        F.lit(f"=== {label} Region Porosity Analysis ==="),
        F.lit(""),
        F.format_string("Total highlighted voxels: %d", F.col("highlighted_voxels")),
        F.format_string("Pore voxels within highlighted regions: %d", F.col("pore_voxels")),
        F.format_string("Overall region porosity: %.4f%%", F.col("porosity")),
    ]
    return _report(stats, head, "Slice porosity within highlighted regions:")
