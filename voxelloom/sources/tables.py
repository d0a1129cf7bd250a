"""Run histories, JSON tables, reconstruction results and render settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = "epoch int, train_loss double, val_pixAcc double, val_IoU_pos double, lr double"
SUMMARY_SCHEMA = (
    "img_dir string, mask_dir string, out_dir string, loss string, optimizer string, save_by string, lr double, "
    "weight_decay double, batch_size int, epochs int, seed int, base_ch int, focal_gamma double, focal_alpha double, "
    "tversky_alpha double, tversky_beta double, tversky_gamma double, best_val_pixAcc double, best_val_IoU_pos double, "
    "best_checkpoint string, last_checkpoint string"
)
RECON_RECORD = (
    "struct<chamfer_distance: double, hausdorff_distance: double, volume_ratio: double, area_ratio: double, "
    "n_vertices: bigint, n_faces: bigint, gt_volume: double, pred_volume: double, gt_area: double, pred_area: double, "
    "gt_porosity: double, pred_porosity: double, porosity_error: double, porosity_ratio: double, success: boolean, "
    "error: string>"
)
ESTIMATE_SCHEMA = (
    "id string, golden_porosity double, mean_slice_porosity double, std_slice_porosity double, "
    "min_slice_porosity double, max_slice_porosity double, nslices int, voxel_direct_result double, "
    "convex_hull_result double, mc_basic_result double, mc_filled_result double, multiscale_result double, "
    "mc_smooth_result double"
)
REALIZED_SCHEMA = (
    "overall_porosity double, mean_slice_porosity double, std_slice_porosity double, min_slice_porosity double, "
    "max_slice_porosity double, nslices int"
)
LIGHTING_SCHEMA = "radius double, height double, theta double, light_intensity double, obj_path string"


def parent_folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def synthetic_id(path: str | Column) -> Column:
    """The ``synthetic_<n>`` part of a path."""
    return F.regexp_extract(path, r"(synthetic_\d+)", 1)


def read_json_table(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A JSON file holding one record or an array of records; the file path is kept as ``path``."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("path", F.input_file_name())


def read_history(spark: SparkSession, path: str | list[str], fmt: str = "json") -> DataFrame:
    """Epoch tables of many runs; the run is the folder of the file."""
    if fmt == "csv":
        table = spark.read.schema(HISTORY_SCHEMA).option("header", "true").csv(path)
    else:
        table = spark.read.schema(HISTORY_SCHEMA).option("multiLine", "true").json(path)
    return table.withColumn("run", parent_folder(F.input_file_name()))


def explode_recon(results: DataFrame, text: str = "value") -> DataFrame:
    """One row per (id, method) from the nested result objects; failed methods stay as rows."""
    records = F.from_json(F.col(text), f"map<string, {RECON_RECORD}>")
    return results.select("id", F.explode(records).alias("method", "record")).select("id", "method", "record.*")


def read_recon_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``results.json`` files; the id is the ``synthetic_<n>`` part of the path."""
    texts = spark.read.text(path, wholetext=True)
    return explode_recon(texts.withColumn("id", synthetic_id(F.input_file_name())))


def lighting_join(lighting: DataFrame, other: DataFrame, path: str = "obj_path") -> DataFrame:
    """Render settings joined by the id inside their object path, with the height to radius ratio."""
    keyed = lighting.select(
        synthetic_id(path).alias("id"), "radius", "height", "theta", "light_intensity",
        (F.col("height") / F.nullif(F.col("radius"), F.lit(0.0))).alias("height_per_radius"),
    )
    return keyed.join(other, "id")
