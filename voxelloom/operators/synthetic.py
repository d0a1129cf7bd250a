"""Synthetic-volume specifications: size bins, per-bin porosities, matching of targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.pixels import linspace, lognormal_params, lognormal_pdf, nm_to_vox
from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA
from voxelloom.sources.specs import DEFAULT_SPEC, float_list, setting

# Fallback bins of a spec without a usable list.
FALLBACK_MEAN_NM, FALLBACK_STD_NM, FALLBACK_FLOOR_NM = 150.0, 40.0, 10.0
FALLBACK_WEIGHTS = [0.25, 0.5, 0.25]


def psd_lists(specs: DataFrame, *more: Column) -> DataFrame:
    """(spec, sizes, weights, voxel): the spec's bins as two arrays, weights scaled to sum 1.

    Without two non-empty lists of equal length, three bins around the mean size are used. All of it
    happens inside the spec's own row.
    """
    mean = F.coalesce(setting("psd_mean_nm").cast("double"), F.lit(FALLBACK_MEAN_NM))
    std = F.coalesce(setting("psd_std_nm").cast("double"), F.lit(FALLBACK_STD_NM))
    three = F.array(*[F.greatest(F.lit(FALLBACK_FLOOR_NM), m) for m in (mean - std, mean, mean + std)])
    listed = (F.size("given_sizes") > 0) & (F.size("given_sizes") == F.size("given_weights"))
    given = specs.select(
        "spec", float_list(setting("psd_bins_nm")).alias("given_sizes"), float_list(setting("psd_weights")).alias("given_weights"),
        three.alias("three"), F.coalesce(setting("voxel_size_nm").cast("double"), F.lit(10.0)).alias("voxel"), *more,
    )
    rest = [name for name in given.columns if name not in ("spec", "given_sizes", "given_weights", "three")]
    used = given.select(
        "spec", *rest, F.when(listed, F.col("given_sizes")).otherwise(F.col("three")).alias("sizes"),
        F.when(listed, F.col("given_weights")).otherwise(F.array(*[F.lit(w) for w in FALLBACK_WEIGHTS])).alias("raw"),
    )
    total = F.aggregate("raw", F.lit(0.0), lambda acc, w: acc + w)
    return used.withColumn("total", total).select(
        "spec", *rest, "sizes", F.transform("raw", lambda w: w / F.col("total")).alias("weights")
    )


def psd_bins(specs: DataFrame) -> DataFrame:
    """(spec, bin, diameter_nm, diameter_vox, weight), one row per size bin."""
    bins = psd_lists(specs).select("spec", "voxel", F.posexplode(F.arrays_zip("sizes", "weights")).alias("bin", "b"))
    return bins.select(
        "spec", "bin", F.col("b.sizes").alias("diameter_nm"), nm_to_vox("b.sizes", "voxel").alias("diameter_vox"),
        F.col("b.weights").alias("weight"),
    )


def solve_bin_porosities(weights: str | Column, target: str | Column, steps: int = 60) -> Column:
    """Per-bin porosities s*w whose independent union has the target porosity (weights summing to 1).

    The scale s comes from bisection on [0, 0.999], as a fold over the step numbers inside one row.
    """
    w = F.col(weights) if isinstance(weights, str) else weights
    goal = F.col(target) if isinstance(target, str) else target

    def union_at(s: Column) -> Column:
        return 1.0 - F.aggregate(w, F.lit(1.0), lambda acc, each: acc * (1.0 - s * each))

    def narrow(state: Column, _: Column) -> Column:
        half = state["width"] * 0.5
        kept = F.when(union_at(state["lo"] + half) < goal, half).otherwise(0.0)
        return F.struct((state["lo"] + kept).alias("lo"), half.alias("width"))

    def shares(state: Column) -> Column:
        return F.transform(w, lambda each: (state["lo"] + state["width"]) * each)

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(0.999).alias("width"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, narrow, shares)


def bin_porosities(specs: DataFrame) -> DataFrame:
    """(spec, bin, porosity): the porosity each size bin should get so that all together reach the target."""
    target = F.coalesce(setting("overall_porosity").cast("double"), F.lit(DEFAULT_SPEC["overall_porosity"]))
    lists = psd_lists(specs, target.alias("target"))
    return lists.select("spec", F.posexplode(solve_bin_porosities("weights", "target")).alias("bin", "porosity"))


def lognormal_curve(
    rows: DataFrame, keys: list[str], mean: str, std: str, low: float = 20.0, high: float = 500.0, points: int = 500
) -> DataFrame:
    """Log-normal density per row on an even grid, scaled to unit trapezoid area: (keys, i, x, pdf).

    The area is worked out on the row's own array before the grid is exploded, so nothing shuffles.
    """
    mu, sigma = lognormal_params(mean, std)
    grid = rows.select(*keys, mu.alias("mu"), sigma.alias("sigma"), linspace(F.lit(low), F.lit(high), points).alias("x"))
    curves = grid.select(*keys, "x", F.transform("x", lambda p: lognormal_pdf(p, F.col("mu"), F.col("sigma"))).alias("raw"))
    step = (high - low) / (points - 1)
    ends = (F.element_at("raw", 1) + F.element_at("raw", points)) / 2
    area = (F.aggregate("raw", F.lit(0.0), lambda acc, p: acc + p) - ends) * step
    scaled = curves.select(*keys, "x", "raw", area.alias("area"))
    exploded = scaled.select(*keys, "area", F.posexplode(F.arrays_zip("x", "raw")).alias("i", "p"))
    return exploded.select(*keys, "i", F.col("p.x").alias("x"), (F.col("p.raw") / F.col("area")).alias("pdf"))


def discrete_mean_std(bins: DataFrame, keys: list[str], x: str, weight: str) -> DataFrame:
    """Mean and deviation of a weighted list, weights scaled to sum 1."""
    v, w = F.col(x), F.col(weight)
    sums = bins.groupBy(*keys).agg(F.sum(w).alias("sw"), F.sum(w * v).alias("s1"), F.sum(w * v * v).alias("s2"))
    mean = F.col("s1") / F.col("sw")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("sw") - mean * mean))
    return sums.select(*keys, mean.alias("mean"), spread.alias("std"))


def spec_or(target: str, own: str) -> Column:
    """A target, or the own value where the spec has none."""
    return F.coalesce(F.col(target), F.col(own))


def meets_slice_targets(tolerance: float = 0.02) -> Column:
    """Are the realised slice statistics close to the targets? min and max are checked on one side only."""
    return (
        (F.abs(F.col("mean") - spec_or("mean_target", "mean")) <= tolerance)
        & (F.abs(F.col("std") - spec_or("std_target", "std")) <= tolerance)
        & (F.col("min") <= spec_or("min_target", "min") + tolerance)
        & (F.col("max") >= spec_or("max_target", "max") - tolerance)
    )


def accepted(tolerance: float = 0.02, overall_tolerance: float = 0.005) -> Column:
    """Slice targets met and overall porosity within its tolerance."""
    return meets_slice_targets(tolerance) & (F.abs(F.col("overall") - F.col("overall_target")) <= overall_tolerance)


def match_loss() -> Column:
    """Distance to the targets: overall, mean and 0.7 times the deviation; absent targets cost nothing."""
    return (
        F.abs(F.col("overall") - F.col("overall_target"))
        + F.abs(F.col("mean") - spec_or("mean_target", "mean"))
        + F.abs(F.col("std") - spec_or("std_target", "std")) * 0.7
    )


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Winning iteration per spec: the first accepted one, else the lowest loss (earliest on ties)."""
    scored = candidates.withColumn("loss", match_loss()).withColumn("ok", accepted())
    order = F.struct((~F.col("ok")).alias("a"), F.when(F.col("ok"), 0.0).otherwise(F.col("loss")).alias("b"), F.col("it").alias("c"))
    return scored.groupBy("spec").agg(F.min_by(F.struct("it", "loss", "ok"), order).alias("w")).select("spec", "w.*")


def union_voids(layers: list[DataFrame]) -> DataFrame:
    """Void (0) wherever any layer of packed slices is void: the smallest value of each pixel.

    A group holds one slice of every layer, one byte per pixel.
    """

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            merged = [np.minimum.reduce([np.frombuffer(d, np.uint8) for d in parts]).tobytes() for parts in batch["layers"]]
            yield batch[SLICE_COLUMNS[:-1]].assign(data=merged)

    stacked = layers[0]
    for layer in layers[1:]:
        stacked = stacked.unionByName(layer)
    same = [F.first(name).alias(name) for name in ("name", "h", "w", "dtype")]
    grouped = stacked.groupBy("volume_id", "z").agg(*same, F.collect_list("data").alias("layers"))
    return grouped.mapInPandas(smallest, SLICE_SCHEMA)


def spec_vs_realized(targets: DataFrame, realized: DataFrame) -> DataFrame:
    """Target and realised porosity per id with their difference."""
    return targets.join(realized, "id").withColumn("difference", F.col("overall_porosity") - F.col("target"))


def realized_stats(stats: DataFrame) -> DataFrame:
    """Realised statistics rounded to six digits."""
    names = {"porosity": "overall_porosity", "mean_porosity": "mean_slice_porosity", "std_porosity": "std_slice_porosity",
             "min_porosity": "min_slice_porosity", "max_porosity": "max_slice_porosity"}
    return stats.select(
        "volume_id", *[F.round(F.col(old), 6).alias(new) for old, new in names.items()], F.col("n_slices").alias("nslices")
    )
