"""Plans for renaming slice files (nothing is renamed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: names of the form synthetic_<0..10>_<n>.png, any letter case.
LONG_NAME = r"(?i)^synthetic_(?:[0-9]|10)_(\d+)\.png$"
LAST_INDEX = 149


def rename_filter(files: DataFrame) -> DataFrame:
    """Files with a long name, the slice number in it, and whether that number is in range."""
    number = F.regexp_extract("name", LONG_NAME, 1).cast("decimal(38,0)")
    return files.where(F.col("name").rlike(LONG_NAME)).withColumn("idx", number).withColumn(
        "in_range", F.col("idx").between(0, LAST_INDEX)
    )


def rename_plan(files: DataFrame) -> DataFrame:
    """(dir, name, target, action) with action ``rename``, ``skip_range`` or ``skip_exists``.

    A target that exists already, or that an earlier name (in string order) of the folder takes, is
    skipped. Earlier means the smallest name per (dir, target), one aggregation.
    """
    wanted = rename_filter(files).withColumn(
        "target", F.when(F.col("in_range"), F.format_string("slice_%04d.png", F.col("idx").cast("int")))
    )
    existing = files.select("dir", F.col("name").alias("target")).distinct().withColumn("_exists", F.lit(True))
    first = wanted.where("in_range").groupBy("dir", "target").agg(F.min("name").alias("_first"))
    action = (
        F.when(~F.col("in_range"), "skip_range")
        .when(F.col("_exists") & (F.col("name") != F.col("target")), "skip_exists")
        .when(F.col("name") != F.col("_first"), "skip_exists")
        .otherwise("rename")
    )
    return (
        wanted.join(existing, ["dir", "target"], "left")
        .join(first, ["dir", "target"], "left")
        .select("dir", "name", "target", action.alias("action"))
    )


def rename_counts(plan: DataFrame) -> DataFrame:
    """Changed and skipped files per folder."""
    renamed = F.col("action") == "rename"
    return plan.groupBy("dir").agg(F.count_if(renamed).alias("changed"), F.count_if(~renamed).alias("skipped"))
