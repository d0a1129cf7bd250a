"""Run histories, checkpoint choice, splits, batches and experiment grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.pixels import experiment_name
from voxelloom.ordering import rank_by_hash, rank_rows, running_max_before
from voxelloom.session import cut_lineage
from voxelloom.sources.specs import float_list, strip

# The first score to beat, per selection rule.
START_SCORE = {"val_pixAcc": 0.0, "val_IoU_pos": -1.0}


def mark_saved(history: DataFrame, score: str = "val_pixAcc") -> DataFrame:
    """Add ``saved``: epochs whose score is strictly above everything before in the run.

    The running maximum works in blocks of epochs, so one very long run does not sit in one task.
    """
    marked = running_max_before(history, ["run"], "epoch", score, "_before")
    best = F.greatest(F.coalesce("_before", F.lit(START_SCORE[score])), F.lit(START_SCORE[score]))
    return marked.withColumn("saved", F.col(score) > best).drop("_before")


def running_history(history: DataFrame, score: str = "val_pixAcc") -> DataFrame:
    """Every epoch with the best score so far."""
    marked = running_max_before(history, ["run"], "epoch", score, "_before")
    return marked.withColumn("best_so_far", F.greatest(score, "_before")).drop("_before")


def best_checkpoint(history: DataFrame, score: str = "val_pixAcc") -> DataFrame:
    """Kept epoch per run and the best of both metrics over the saved epochs."""
    return (
        mark_saved(history, score)
        .where("saved")
        .groupBy("run")
        .agg(
            F.max("epoch").alias("epoch"),
            F.max("val_pixAcc").alias("best_val_pixAcc"),
            F.max("val_IoU_pos").alias("best_val_IoU_pos"),
        )
    )


def early_stop(history: DataFrame, reached: float = 0.99) -> DataFrame:
    """The epochs a run really does when it ends at the first one with enough accuracy."""
    stops = history.where(F.col("val_pixAcc") >= reached).groupBy("run").agg(F.min("epoch").alias("_stop"))
    return history.join(stops, "run", "left").where("_stop IS NULL OR epoch <= _stop").drop("_stop")


def history_columns(history: DataFrame) -> DataFrame:
    """The epoch table in its fixed column order."""
    return history.select("run", "epoch", "train_loss", "val_pixAcc", "val_IoU_pos", "lr")


def experiment_grid(studies: DataFrame) -> DataFrame:
    """All combinations of each study's comma lists ``losses``, ``lrs`` and ``seeds``.

    Numbered from 1 in product order, with the experiment name; every study expands inside its own row.
    """
    grid = (
        studies.select("study", text_list("losses").alias("a"), float_list(F.col("lrs")).alias("b"), text_list("seeds").alias("c"))
        .select("study", "b", "c", F.posexplode("a").alias("i", "loss"))
        .select("study", "i", "loss", "c", F.size("b").alias("n_b"), F.posexplode("b").alias("j", "lr"))
        .select("study", "i", "j", "loss", "lr", "n_b", F.size("c").alias("n_c"), F.posexplode("c").alias("k", "seed"))
    )
    number = (F.col("i") * F.col("n_b") + F.col("j")) * F.col("n_c") + F.col("k") + 1
    seed = F.col("seed").try_cast("int")
    return grid.select("study", number.alias("run_no"), "loss", "lr", seed.alias("seed"), experiment_name("loss", "lr", seed).alias("run"))


def text_list(text: str) -> Column:
    """Comma list to trimmed strings, blank items dropped."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda item: item != "")


def training_summary(best: DataFrame, settings: DataFrame, score: str = "best_val_pixAcc") -> DataFrame:
    """Settings and best metrics per run, with the run's place among all runs.

    A run that never saved an epoch stays, with a null epoch and the start scores.

    The place is one plus the number of runs with a strictly better score, from a bucketed rank. The
    joined table, one row per run, is stored because the rank reads it again.
    """
    # The scores before the first epoch.
    start_scores = {"best_val_pixAcc": 0.0, "best_val_IoU_pos": -1.0}
    joined = cut_lineage(settings.join(best, "run", "left").fillna(start_scores))
    counted = joined.groupBy(score).agg(F.count(F.lit(1)).alias("_n"), (-F.max(score)).alias("_down"))
    places = rank_rows(counted, [], ["_down"], "_ahead", weight="_n")
    return joined.join(places.select(score, "_ahead"), score).withColumn("place", F.col("_ahead") + 1).drop("_ahead")


def train_val_split(files: DataFrame, name: str = "name", share: float = 0.1, seed: int = 2025) -> DataFrame:
    """Add ``part``: exactly max(1, int(N * share)) rows are ``val``, chosen by a repeatable hash order."""
    ranked = rank_by_hash(files, [], name, seed, "_rank", total="_count")
    val = F.greatest(F.lit(1), (F.col("_count") * F.lit(share)).cast("long"))
    return ranked.withColumn("part", F.when(F.col("_rank") < val, "val").otherwise("train")).drop("_rank", "_count")


def batches(files: DataFrame, name: str = "name", size: int = 8, drop_last: bool = False) -> DataFrame:
    """Add ``batch``: consecutive groups of ``size`` in name order, optionally without a short last one."""
    ranked = rank_rows(files, [], [name], "_rank", total="_count")
    if drop_last:
        ranked = ranked.where(F.col("_rank") < F.floor(F.col("_count") / size) * size)
    return ranked.withColumn("batch", F.floor(F.col("_rank") / size)).drop("_rank", "_count")


def pair_image_mask(images: DataFrame, masks: DataFrame, key=lambda path: path) -> DataFrame:
    """Image and mask by equal relative path (``key`` maps an image path Column to its mask path).

    ``status`` is ``ok``, ``missing`` or ``size_mismatch``.
    """
    i = images.select(F.col("rel_path"), key(F.col("rel_path")).alias("_mask_path"), "h", "w")
    m = masks.select(F.col("rel_path").alias("_mask_path"), F.col("h").alias("mask_h"), F.col("w").alias("mask_w"))
    same = (F.col("h") == F.col("mask_h")) & (F.col("w") == F.col("mask_w"))
    status = F.when(F.col("mask_h").isNull(), "missing").when(same, "ok").otherwise("size_mismatch")
    return i.join(m, "_mask_path", "left").select("rel_path", "h", "w", "mask_h", "mask_w", status.alias("status"))


def compose_pair(*steps):
    """One transform out of several: each takes and returns a DataFrame of paired pixels."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def sample_slices(volumes: DataFrame, n: int = 20, capped: bool = True) -> DataFrame:
    """Evenly spaced slice numbers per volume of a manifest, ends included, truncated.

    ``capped=False`` repeats slices of shorter volumes instead of taking fewer.
    """
    count = F.least(F.lit(n), F.col("n_slices")).cast("int") if capped else F.lit(n)
    last = (F.col("n_slices") - 1).cast("double")
    step = last / F.greatest(F.lit(1), F.col("k") - 1)
    place = F.when(F.col("i") == F.col("k") - 1, F.when(F.col("k") > 1, last).otherwise(0.0)).otherwise(F.col("i") * step)
    return (
        volumes.withColumn("k", count)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("volume_id", "i", place.cast("int").alias("z"))
    )


def slice_range(slices: DataFrame, start: int = 0, max_slices: int | None = None) -> DataFrame:
    """Slices from ``max(1, start)`` on (slice 0 is always left out), at most ``max_slices`` of them."""
    first = max(1, start)
    kept = slices.where(F.col("z") >= first)
    return kept if max_slices is None else kept.where(F.col("z") < first + max_slices)


def ref_slice(volumes: DataFrame, which: str | int = "middle") -> DataFrame:
    """(volume_id, z) of the middle slice or of a given number, which must exist."""
    n = F.col("n_slices").cast("int")
    if which == "middle":
        return volumes.select("volume_id", F.floor(n / 2).cast("int").alias("z"))
    index = F.when((F.lit(int(which)) >= 0) & (F.lit(int(which)) < n), int(which))
    checked = F.coalesce(index, F.raise_error(F.lit(f"slice {which} is out of range")).cast("int"))
    return volumes.select("volume_id", checked.alias("z"))
