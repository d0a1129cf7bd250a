"""Histograms, cumulative shares, Otsu thresholds, histogram matching and normalisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA, small_batches, whole_pixels

SLICE = ["volume_id", "z"]


def value_histogram(
    values: DataFrame, keys: list[str], v: str, bins: int, low=None, high=None, density: bool = False, n: str | None = None
) -> DataFrame:
    """Equal-width bins per key, last bin closed on the right; the range defaults to the key's min and max.

    A constant key gets a range of one unit around its value, as numeric libraries do.
    """
    weight = F.col(n) if n else F.lit(1)
    if low is None or high is None:
        ranges = values.groupBy(*keys).agg(F.min(v).cast("double").alias("_a"), F.max(v).cast("double").alias("_b"))
        flat = F.col("_a") == F.col("_b")
        ranges = ranges.select(
            *keys,
            F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
            F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
        )
        ranged = values.join(ranges, keys)
    else:
        ranged = values.withColumn("_lo", F.lit(float(low))).withColumn("_hi", F.lit(float(high)))
        ranged = ranged.where((F.col(v) >= F.col("_lo")) & (F.col(v) <= F.col("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col("_lo")) / width).cast("int"))
    counted = ranged.groupBy(*keys, "_lo", "_hi", place.alias("bin")).agg(F.sum(weight).alias("n"))
    # One row per key with at most `bins` entries; empty bins appear when it is spread out again.
    packed = counted.groupBy(*keys, "_lo", "_hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts"), F.sum("n").alias("_all")
    )
    spread = packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spread.withColumn("n", F.coalesce(F.element_at("_counts", F.col("bin")), F.lit(0)))
    columns = [*keys, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("center"), "n"]
    if density:
        columns.append((F.col("n") / (F.col("_all") * width)).alias("p"))
    return full.select(*columns)


def edge_histogram(values: DataFrame, keys: list[str], v: str, edges: list[float]) -> DataFrame:
    """Counts between explicit increasing edges, empty bins included; the last bin includes its right edge.

    Every key has all its bins, also one whose values are all outside or null.
    """
    inside = F.col(v).between(edges[0], edges[-1])
    below = sum(((F.col(v) >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    counted = values.groupBy(*keys, F.when(inside, below).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))  # collect_list leaves out nulls
    packed = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_counts"))
    spread = packed.select(*keys, "_counts", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))).alias("bin"))
    return spread.select(*keys, "bin", F.coalesce(F.element_at("_counts", F.col("bin")), F.lit(0)).alias("n"))


def log_edges(low: float, high: float, n: int) -> list[float]:
    """``n`` edges in geometric progression."""
    return [float(e) for e in np.geomspace(low, high, n)]


def cdf(hist: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Cumulative pixel share per value. A partition is one slice: at most 256 rows."""
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return hist.withColumn("q", F.sum("n").over(upto).cast("double") / F.sum("n").over(whole))


def otsu_threshold(hist: DataFrame, keys: list[str], bins: int = 256, integer: bool = False) -> DataFrame:
    """Threshold of largest between-class variance per key (the first one on ties); a constant key gives its value.

    ``integer=True`` uses one bin per value; otherwise ``bins`` equal bins between the smallest and the
    largest value with their centres as candidates. The histogram is merged per key first, so the
    window sees at most 256 rows whatever the number of pixels.
    """
    if integer:
        merged = hist.groupBy(*keys, F.col("v").cast("double").alias("center")).agg(F.sum("n").alias("n"))
    else:
        merged = value_histogram(hist, keys, "v", bins, n="n").select(*keys, "center", "n")
    up = Window.partitionBy(*keys).orderBy("center").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("center").rowsBetween(1, Window.unboundedFollowing)
    n, c = F.col("n").cast("double"), F.col("center")
    sums = merged.select(
        *keys, "center",
        F.sum(n).over(up).alias("w1"), F.sum(n * c).over(up).alias("s1"),
        F.sum(n).over(after).alias("w2"), F.sum(n * c).over(after).alias("s2"),
    )
    gap = F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2")
    whole = F.col("w1") + F.col("w2")
    # Rounded so that equal splits compare equal despite summation order.
    variance = F.when((F.col("w1") > 0) & (F.col("w2") > 0), F.round(F.col("w1") / whole * F.col("w2") / whole * gap * gap, 9))
    best = F.max_by(F.when(variance.isNotNull(), F.col("center")), F.struct(variance, -c))
    return sums.groupBy(*keys).agg(F.coalesce(best, (F.min("center") + F.max("center")) / 2).alias("threshold"))


def unit_volume(values: DataFrame, keys: list[str] = ["volume_id"], v: str = "v") -> DataFrame:
    """Replace the value by value / maximum; keys whose maximum is 0 stay 0."""
    tops = values.groupBy(*keys).agg(F.max(v).cast("double").alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col(v) / F.col("_top")).otherwise(F.col(v).cast("double"))
    return values.join(tops, keys).withColumn(v, scaled).drop("_top")


def binarize_volume(
    hist: DataFrame, keys: list[str] = ["volume_id"], use_otsu: bool = True, manual_threshold: float | None = None,
    pore_is_dark: bool = True,
) -> DataFrame:
    """Add ``solid`` to a (stored) histogram: normalised value against a manual, Otsu or 0.5 threshold."""
    unit = unit_volume(hist, keys)
    if manual_threshold is not None or not use_otsu:
        limit = 0.5 if manual_threshold is None else float(manual_threshold)
        marked = unit.withColumn("threshold", F.lit(limit))
    else:
        marked = unit.join(otsu_threshold(unit, keys), keys)
    solid = F.col("v") >= F.col("threshold") if pore_is_dark else F.col("v") <= F.col("threshold")
    return marked.withColumn("solid", solid)


def otsu_pores(slices: DataFrame, slice_hist: DataFrame) -> DataFrame:
    """Pore masks (1 = pore) of 8-bit slices: darker than the slice's own Otsu threshold.

    Only the small threshold table meets the pixels; an all-black slice has no pore.
    """
    limits = otsu_threshold(unit_volume(slice_hist, SLICE), SLICE).join(
        slice_hist.groupBy(*SLICE).agg(F.max("v").alias("top")), SLICE
    )

    def mark(batches):
        for batch in small_batches(batches):
            packed = []
            for row in batch.itertuples(index=False):
                unit = whole_pixels(row) / max(row.top, 1)
                packed.append((unit < row.threshold).astype(np.uint8).tobytes())
            yield batch[SLICE_COLUMNS].assign(dtype="uint8", data=packed)

    return slices.join(limits, SLICE).mapInPandas(mark, SLICE_SCHEMA)


def middle_slices(volumes: DataFrame, n: str = "n_slices") -> DataFrame:
    """(volume_id, z) of the middle slice of each volume of a manifest."""
    return volumes.select("volume_id", F.floor(F.col(n) / 2).cast("int").alias("z"))


def match_histogram(hist: DataFrame, reference: DataFrame) -> DataFrame:
    """Lookup table (volume, z, v, matched) that gives each slice the value distribution of the reference slice.

    ``reference`` names one slice per volume (volume_id, z). Both cumulative shares are laid on one axis;
    the reference points before and after each share give the linear interpolation, cut at both ends.
    A window partition holds one slice: at most 512 rows. ``hist`` is read for source and reference, so
    hand in a stored one where it comes straight from pixels.
    """
    shares = cdf(hist).select("volume_id", "z", "v", "q")
    target = shares.join(reference, SLICE).select("volume_id", F.col("q").alias("rq"), F.col("v").alias("rv"))
    every_slice = shares.where("q = 1").select(*SLICE)
    points = every_slice.join(target, "volume_id").select(
        *SLICE, F.col("rq").alias("q"), F.lit(None).cast("int").alias("v"), F.struct("rq", "rv").alias("ref")
    )
    source = shares.select(*SLICE, "q", "v", F.lit(None).cast(points.schema["ref"].dataType).alias("ref"))
    upto = Window.partitionBy(*SLICE).orderBy("q").rangeBetween(Window.unboundedPreceding, 0)
    fromhere = Window.partitionBy(*SLICE).orderBy("q").rangeBetween(0, Window.unboundedFollowing)
    both = (
        source.unionByName(points)
        .withColumn("lo", F.last("ref", ignorenulls=True).over(upto))
        .withColumn("hi", F.first("ref", ignorenulls=True).over(fromhere))
        .where("v IS NOT NULL")
    )
    return both.select(*SLICE, "v", interpolate("q", "lo.rq", "lo.rv", "hi.rq", "hi.rv").cast("int").alias("matched"))


def interpolate(x: str | Column, x0, y0, x1, y1) -> Column:
    """Straight line between two neighbours; the one that exists where the other is missing."""
    x, x0, y0, x1, y1 = [F.col(c) if isinstance(c, str) else c for c in (x, x0, y0, x1, y1)]
    y0, y1 = y0.cast("double"), y1.cast("double")
    slope = (y1 - y0) / (x1 - x0)
    return F.when(x0.isNull(), y1).when(x1.isNull() | (x0 == x1), y0).otherwise(slope * (x - x0) + y0)


def apply_lookup(slices: DataFrame, lookup: DataFrame, column: str = "matched") -> DataFrame:
    """Rewrite 8-bit slices through a per-slice lookup table (packed to 256 bytes per slice before the join)."""
    entries = F.map_from_entries(F.collect_list(F.struct("v", column)))
    packed = lookup.groupBy(*SLICE).agg(entries.alias("entries")).select(
        *SLICE,
        F.unhex(
            F.array_join(
                F.transform(
                    F.sequence(F.lit(0), F.lit(255)),
                    lambda v: F.lpad(F.hex(F.coalesce(F.element_at("entries", v), F.lit(0)).cast("long")), 2, "0"),
                ),
                "",
            )
        ).alias("lut"),
    )

    def translate(batches):
        for batch in small_batches(batches):
            data = [row.data.translate(row.lut) for row in batch[["data", "lut"]].itertuples(index=False)]
            yield batch[SLICE_COLUMNS].assign(data=data)

    return slices.join(packed, SLICE).mapInPandas(translate, SLICE_SCHEMA)
