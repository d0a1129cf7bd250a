"""Pore-size distributions per image and over images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.histograms import value_histogram
from voxelloom.operators.images import float_hist
from voxelloom.ordering import percentiles_of, ranked_counts
from voxelloom.session import cut_lineage

IMAGE = ["volume_id", "z"]


def pore_size_distribution(maps: DataFrame, bins: int = 8, voxel_size: float = 10.0) -> DataFrame:
    """Density histogram of the positive diameters of every image (thickness or 2 * distance maps).

    The maps are costly and their range is needed first, so the counts of their distinct values are stored.
    """
    counts = cut_lineage(float_hist(maps))
    sizes = counts.where("v > 0").withColumn("v", F.col("v") * F.lit(float(voxel_size)))
    return value_histogram(sizes, IMAGE, "v", bins, density=True, n="n")


def weighted_mean_size(psd: DataFrame, keys: list[str] = IMAGE) -> DataFrame:
    """Mean bin centre weighted by probability; images without any mass drop out."""
    mean = F.sum(F.col("center") * F.col("p")) / F.nullif(F.sum("p"), F.lit(0.0))
    return psd.groupBy(*keys).agg(mean.alias("mean_pore_size")).where("mean_pore_size IS NOT NULL")


def modal_size(psd: DataFrame, keys: list[str] = IMAGE) -> DataFrame:
    """Centre of the most probable bin, the first one on ties."""
    return psd.groupBy(*keys).agg(F.max_by("center", F.struct("p", -F.col("bin"))).alias("max_pore_size"))


def image_pore_stats(pore_hist: DataFrame, psd: DataFrame) -> DataFrame:
    """Porosity, mean and modal size and pore pixel count of every image; ``pore_hist`` counts 0/1 values."""
    pores = F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0))
    counts = pore_hist.groupBy(*IMAGE).agg((pores / F.sum("n")).alias("porosity"), pores.alias("total_pores"))
    sizes = psd.groupBy(*IMAGE).agg(
        (F.sum(F.col("center") * F.col("p")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("mean_pore_size"),
        F.max_by("center", F.struct("p", -F.col("bin"))).alias("max_pore_size"),
    )
    return counts.join(sizes, IMAGE).where("mean_pore_size IS NOT NULL")


def common_grid(psd: DataFrame, run: list[str]) -> DataFrame:
    """Smallest and largest bin centre per run."""
    return psd.groupBy(*run).agg(F.min("center").alias("_lo"), F.max("center").alias("_hi"))


def interp_psd(psd: DataFrame, run: list[str], keys: list[str] = IMAGE, points: int = 100) -> DataFrame:
    """Every image's distribution at the run's common grid points, linear inside, clamped outside.

    Each pair of neighbouring bins computes the numbers of the grid points it covers, so an image gives
    exactly ``points`` rows without a range join.
    """
    order = Window.partitionBy(*keys).orderBy("bin")
    placed = psd.join(common_grid(psd, run), run)
    segments = placed.select(
        *keys, *[r for r in run if r not in keys], "_lo", "_hi", "center", "p",
        F.lead("center").over(order).alias("next_center"), F.lead("p").over(order).alias("next_p"),
        F.lag("center").over(order).isNull().alias("is_first"),
    )
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    safe = F.when(step > 0, step).otherwise(F.lit(1.0))
    begin = F.when(F.col("is_first"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.col("center") - F.col("_lo")) / safe) - 1))
    end = F.when(F.col("next_center").isNull(), F.lit(points - 1)).otherwise(
        F.least(F.lit(points - 1), F.ceil((F.col("next_center") - F.col("_lo")) / safe) + 1)
    )
    position = F.when(F.col("i") == points - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("i") * step)
    covered = (F.col("is_first") | (F.col("pos") >= F.col("center"))) & (
        F.col("next_center").isNull() | (F.col("pos") < F.col("next_center"))
    )
    slope = (F.col("next_p") - F.col("p")) / (F.col("next_center") - F.col("center"))
    value = F.when((F.col("pos") <= F.col("center")) | F.col("next_center").isNull(), F.col("p")).otherwise(
        slope * (F.col("pos") - F.col("center")) + F.col("p")
    )
    return (
        segments.withColumn("i", F.explode(F.sequence(begin.cast("int"), end.cast("int"))))
        .withColumn("pos", position)
        .where(covered)
        .select(*keys, *[r for r in run if r not in keys], F.col("i").alias("grid"), F.col("pos").alias("size"), value.alias("p"))
    )


def psd_mean_std(interpolated: DataFrame, run: list[str]) -> DataFrame:
    """Mean and population deviation over images at every grid point."""
    return interpolated.groupBy(*run, "grid").agg(
        F.max("size").alias("bin_centers"), F.avg("p").alias("mean_probability"), F.stddev_pop("p").alias("std_probability")
    )


def aggregate_psd(psd: DataFrame, run: list[str], keys: list[str] = IMAGE, points: int = 100) -> DataFrame:
    """Common grid, interpolation and mean in one step."""
    return psd_mean_std(interp_psd(psd, run, keys, points), run)


def run_summary(stats: DataFrame, run: list[str], psd: DataFrame | None = None) -> DataFrame:
    """Mean and sample deviation of porosity and mean size, and number of images, per run; with ``psd`` also the size range."""
    summary = stats.groupBy(*run).agg(
        F.avg("porosity").alias("mean_porosity"), F.stddev_samp("porosity").alias("std_porosity"),
        F.avg("mean_pore_size").alias("mean_size"), F.stddev_samp("mean_pore_size").alias("std_size"),
        F.count(F.lit(1)).alias("n_images"),
    )
    if psd is None:
        return summary
    span = psd.groupBy(*run).agg(F.min("center").alias("min_size"), F.max("center").alias("max_size"))
    return summary.join(span, run)


def boxplot_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers (outermost values within 1.5 IQR of the box) and outlier count per key.

    All of them come from the stored counts of distinct values; the values themselves are read once.
    """
    ranked = ranked_counts(values, keys, value)
    quartiles = percentiles_of(ranked, keys, value, [0.25, 0.5, 0.75])
    reach = (F.col("p2") - F.col("p0")) * 1.5
    joined = ranked.join(quartiles, keys) if keys else ranked.join(F.broadcast(quartiles))
    inside = F.col(value).between(F.col("p0") - reach, F.col("p2") + reach)
    return joined.groupBy(*keys).agg(
        F.max("p0").alias("q1"), F.max("p1").alias("median"), F.max("p2").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
    )
