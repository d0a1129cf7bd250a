"""Segmentation scores and losses from pixel tables ``(batch, slice, y, x, p1, t)``.

All of them are functions of a dozen sums per slice. ``slice_sums`` makes these in one map-side
combined aggregation; every metric afterwards works on one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def slice_sums(pixels: DataFrame, focal_gamma: float = 2.0, focal_alpha: float = 0.5) -> DataFrame:
    """Counts and sums per (batch, slice) that the metrics below combine."""
    p, t = F.col("p1"), F.col("t").cast("double")
    pred, truth = F.col("p1") > 0.5, F.col("t") == 1
    p0 = F.lit(1.0) - p
    positive = F.lit(-focal_alpha) * F.pow(p0, F.lit(focal_gamma)) * t * F.ln(p + EPS)
    negative = F.lit(focal_alpha - 1.0) * F.pow(p, F.lit(focal_gamma)) * (1 - t) * F.ln(p0 + EPS)
    return pixels.groupBy("batch", "slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((pred == truth).cast("bigint")).alias("correct"),
        F.sum((pred & truth).cast("bigint")).alias("inter"),
        F.sum((pred | truth).cast("bigint")).alias("union_"),
        F.sum(p).alias("sum_p"),
        F.sum(t).alias("sum_t"),
        F.sum(p * t).alias("tp"),
        F.sum(p * (1 - t)).alias("fp"),
        F.sum(p0 * t).alias("fn"),
        F.sum(F.when(truth, -F.ln(p)).otherwise(0.0)).alias("ce1"),
        F.sum(F.when(truth, 0.0).otherwise(-F.ln(p0))).alias("ce0"),
        F.sum(positive + negative).alias("focal"),
    )


def confusion_counts(sums: DataFrame) -> DataFrame:
    """Soft true positives, false positives and false negatives per slice."""
    return sums.select("batch", "slice", "tp", "fp", "fn")


def _batches(sums: DataFrame, metric: Column) -> DataFrame:
    return sums.groupBy("batch").agg(metric.alias("value"), F.count(F.lit(1)).alias("n_slices"))


def over_batches(per_batch: DataFrame) -> DataFrame:
    """Epoch value: mean over batches weighted by their number of slices."""
    weighted = F.sum(F.col("value") * F.col("n_slices")) / F.greatest(F.lit(1), F.sum("n_slices"))
    return per_batch.agg(weighted.alias("value"), F.sum("n_slices").alias("n_slices"))


def pixel_accuracy(sums: DataFrame) -> DataFrame:
    """Share of correct pixels per batch."""
    return _batches(sums, F.sum("correct") / F.greatest(F.lit(1), F.sum("n")))


def iou_class1(sums: DataFrame, per_batch: bool = True) -> DataFrame:
    """Intersection over union of the positive class (0 when there is no positive anywhere)."""
    ratio = F.sum("inter") / F.greatest(F.lit(1), F.sum("union_"))
    return _batches(sums, ratio) if per_batch else sums.agg(ratio.alias("value"))


def dice_metric() -> Column:
    """Mean over slices of one minus the average soft Dice of both classes."""
    fg = (2 * F.col("tp") + EPS) / (F.col("sum_p") + F.col("sum_t") + EPS)
    true_neg = F.col("n") - F.col("sum_p") - F.col("fn")
    bg = (2 * true_neg + EPS) / (2 * F.col("n") - F.col("sum_p") - F.col("sum_t") + EPS)
    return F.lit(1.0) - F.avg((fg + bg) / 2)


def tversky_index(alpha: float, beta: float) -> Column:
    return (F.col("tp") + EPS) / (F.col("tp") + F.col("fp") * alpha + F.col("fn") * beta + EPS)


def cross_entropy_metric(w0: float, w1: float) -> Column:
    loss = F.sum("ce0") * w0 + F.sum("ce1") * w1
    return loss / (F.sum(F.col("n") - F.col("sum_t")) * w0 + F.sum("sum_t") * w1)


def loss_metric(kind: str, dice_weight: float = 0.5, w0: float = 1.0, w1: float = 1.0, alpha: float = 0.3, beta: float = 0.7, gamma: float = 1.5) -> Column:
    """Aggregate expression of one of ce, cedice, focal, focaldice, tversky, focaltversky."""
    miss = F.lit(1.0) - tversky_index(alpha, beta)
    single = {
        "ce": cross_entropy_metric(w0, w1),
        "focal": F.sum("focal") / F.sum("n"),
        "tversky": F.avg(miss),
        "focaltversky": F.avg(F.pow(miss, F.lit(gamma))),
        "dice": dice_metric(),
    }
    if kind in single:
        return single[kind]
    if kind not in ("cedice", "focaldice"):
        raise ValueError(f"unknown loss {kind!r}")
    return single[kind.removesuffix("dice")] * (1 - dice_weight) + single["dice"] * dice_weight


def soft_dice_loss(sums: DataFrame) -> DataFrame:
    """Symmetric soft Dice loss per batch."""
    return _batches(sums, loss_metric("dice"))


def tversky_loss(sums: DataFrame, alpha: float = 0.3, beta: float = 0.7) -> DataFrame:
    """One minus the mean Tversky index; alpha weighs false positives, beta false negatives."""
    return _batches(sums, loss_metric("tversky", alpha=alpha, beta=beta))


def focal_tversky_loss(sums: DataFrame, alpha: float = 0.3, beta: float = 0.7, gamma: float = 1.5) -> DataFrame:
    """Mean of (1 - Tversky) to the power gamma."""
    return _batches(sums, loss_metric("focaltversky", alpha=alpha, beta=beta, gamma=gamma))


def focal_loss(sums: DataFrame) -> DataFrame:
    """Mean focal term per pixel (gamma and alpha are those given to ``slice_sums``)."""
    return _batches(sums, loss_metric("focal"))


def cross_entropy(sums: DataFrame, w0: float = 1.0, w1: float = 1.0) -> DataFrame:
    """Class-weighted mean of -ln p(truth)."""
    return _batches(sums, loss_metric("ce", w0=w0, w1=w1))


def combined_loss(sums: DataFrame, kind: str, dice_weight: float = 0.5, w0: float = 1.0, w1: float = 1.0) -> DataFrame:
    """One of the training losses per batch."""
    return _batches(sums, loss_metric(kind, dice_weight, w0, w1))


def all_losses(sums: DataFrame, kinds: list[str]) -> DataFrame:
    """(batch, kind, value, n_slices): several losses from one aggregation."""
    wide = sums.groupBy("batch").agg(F.count(F.lit(1)).alias("n_slices"), *[loss_metric(k).alias(k) for k in kinds])
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
    return wide.select("batch", "n_slices", F.explode(entries).alias("e")).select("batch", "e.kind", "e.value", "n_slices")


def epoch_train_loss(per_batch: DataFrame) -> DataFrame:
    """Plain mean of the batch losses."""
    return per_batch.agg(F.avg("value").alias("train_loss"))


def class_weights(mask_hist: DataFrame) -> DataFrame:
    """Inverse pixel frequency of the classes 0 and 1, floored and scaled to sum 1, over all given slices."""
    positive = F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)).cast("double")
    total = F.greatest(F.lit(1), F.sum("n")).cast("double")
    counts = mask_hist.agg((positive / total).alias("f1"))
    w0 = 1.0 / F.greatest(F.lit(1e-6), 1.0 - F.col("f1"))
    w1 = 1.0 / F.greatest(F.lit(1e-6), F.col("f1"))
    return counts.select((w0 / (w0 + w1)).alias("w0"), (w1 / (w0 + w1)).alias("w1"))


def first_slices(slices: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` slices by volume and name: the sample the class weights are estimated on by default.

    The names are chosen without the pixels, so call it before a kernel, not after it.
    """
    chosen = slices.select("volume_id", "name", "z").orderBy("volume_id", "name", "z").limit(n)
    return slices.join(F.broadcast(chosen), ["volume_id", "name", "z"], "left_semi")
