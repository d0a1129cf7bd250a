"""Writers: packed slices, statistics as CSV, JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import pixels
from voxelloom.layouts import SLICE_COLUMNS, map_slices
from voxelloom.operators.training import history_columns


def write_slices(slices: DataFrame, path: str, z_block: int = 64, mode: str = "overwrite") -> None:
    """Packed slices as Parquet under ``z_block`` folders.

    The block folders let a slice-range filter skip files and keep one huge volume from becoming one
    directory; volumes stay rows, because a folder per volume would mean one small file each.
    """
    blocked = slices.select(*SLICE_COLUMNS).withColumn("z_block", F.floor(F.col("z") / z_block).cast("int"))
    # Rebalanced by block: without it every task writes a small file into every folder; large blocks stay split.
    blocked.hint("rebalance", "z_block").write.mode(mode).partitionBy("z_block").parquet(path)


def read_slices(spark, path: str, first: int | None = None, last: int | None = None, z_block: int = 64) -> DataFrame:
    """Packed slices back, reading only the block folders of the wanted slice range."""
    slices = spark.read.parquet(path)
    if first is not None:
        slices = slices.where((F.col("z_block") >= first // z_block) & (F.col("z") >= first))
    if last is not None:
        slices = slices.where((F.col("z_block") <= last // z_block) & (F.col("z") <= last))
    return slices.select(*SLICE_COLUMNS)


def write_volume(slices: DataFrame, path: str, display: bool = False, mode: str = "overwrite") -> None:
    """A mask or stack under its slice names; ``display`` turns 0/1 bytes to 0/255."""
    if display:
        slices = map_slices(slices, lambda image: (image != 0) * 255)
    write_slices(slices.withColumn("name", pixels.slice_file_name(F.lit("slice"), "z")), path, mode=mode)


def write_stats_csv(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A statistics table as CSV with a header."""
    stats.write.mode(mode).option("header", "true").csv(path)


def write_stats_json(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, numbers rounded to six digits."""
    rounded = [
        F.round(F.col(name), 6).alias(name) if kind == "double" else F.col(name) for name, kind in stats.dtypes
    ]
    stats.select(*rounded).write.mode(mode).json(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report lines (volume_id, line_no, line) as text, one line per row and in order inside each volume."""
    ordered = lines.repartition("volume_id").sortWithinPartitions("volume_id", "line_no")
    ordered.select("line").write.mode(mode).text(path)


def write_history_csv(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Epoch tables with the fixed column order, one folder per run."""
    history_columns(history).write.mode(mode).option("header", "true").partitionBy("run").csv(path)
