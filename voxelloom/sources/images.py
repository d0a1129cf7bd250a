"""Image files and NPY volumes to the ``slices`` layout."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA
from voxelloom.ordering import rank_rows
from voxelloom.session import broadcast_if_small

# The image suffixes the readers accept.
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "tif", "tiff"]


def read_images(
    spark: SparkSession,
    path: str | list[str],
    recursive: bool = False,
    suffixes: list[str] | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Spark's image source, limited to the wanted suffixes (any letter case).

    Columns: ``path, name, status, h, w, channels, data``. Unreadable files are dropped, or kept with
    status ``corrupt`` when asked for.
    """
    wanted = ["".join(f"[{c}{c.upper()}]" for c in suffix.lower()) for suffix in suffixes or IMAGE_SUFFIXES]
    reader = spark.read.format("image").option("pathGlobFilter", "*.{" + ",".join(wanted) + "}")  # others are not even decoded
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    images = reader.load(path)
    suffix = F.lower(F.regexp_extract("image.origin", r"\.(\w+)$", 1))
    status = F.when(F.col("image.height") > 0, "ok").otherwise("corrupt")
    table = images.where(suffix.isin(suffixes or IMAGE_SUFFIXES)).select(
        F.col("image.origin").alias("path"),
        F.element_at(F.split("image.origin", "/"), -1).alias("name"),
        status.alias("status"),
        F.col("image.height").alias("h"),
        F.col("image.width").alias("w"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    return table if keep_corrupt else skip_corrupt(table)


def skip_corrupt(images: DataFrame) -> DataFrame:
    """Keep the readable rows only."""
    return images.where(F.col("status") == "ok")


def count_by_status(rows: DataFrame) -> DataFrame:
    """How many rows were read, skipped or failed."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def gray_slices(images: DataFrame, volume_id: Column, z: Column, gray: str = "luma") -> DataFrame:
    """Pack image rows as 8-bit gray slices. Spark delivers colour as BGR bytes."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for row in batch.itertuples(index=False):
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, -1).astype(np.int64)
                if pixels.shape[2] < 3:
                    one = pixels[..., 0]
                elif gray == "first":
                    one = pixels[..., 2]
                elif gray == "mean":
                    one = pixels[..., :3].mean(axis=2)
                else:
                    one = (pixels[..., 2] * 19595 + pixels[..., 1] * 38470 + pixels[..., 0] * 7471 + 32768) >> 16
                packed.append(one.astype(np.uint8).tobytes())
            yield batch[SLICE_COLUMNS].assign(data=packed)

    rows = images.select(
        volume_id.alias("volume_id"), z.cast("int").alias("z"), "name", "h", "w", F.lit("uint8").alias("dtype"), "data"
    )
    return rows.mapInPandas(convert, SLICE_SCHEMA)


def folders_told_apart(paths: str | list[str]) -> int:
    """How many of its last folders name a volume, so that folders found by these paths or globs have different names.

    Everything below the part that all paths share and that holds no pattern counts: ``data/*/stack`` gives
    ``a/stack``, ``data/stacks/*`` gives ``a``, one plain folder its own name.
    """
    parts = [[p for p in path.split("/") if p] for path in ([paths] if isinstance(paths, str) else paths)]
    parts = [p[:-1] if re.search(r"\.(\w+|\{.*\})$", p[-1]) and len(p) > 1 else p for p in parts]  # a pattern of file names
    shared = 0
    while all(shared < len(p) - 1 and p[shared] == parts[0][shared] and not set(p[shared]) & set("*?[{") for p in parts):
        shared += 1
    return max(len(p) for p in parts) - shared


def folder_of(path: str | Column = "path") -> Column:
    """The name of the folder a file lies in, used as volume id."""
    return F.element_at(F.split(path, "/"), -2)


def slice_index(files: DataFrame, name: str = "name", keys: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """z = rank of the file name inside its volume, in plain string order (``10`` comes before ``2``)."""
    ranked = rank_rows(files, list(keys), [name], "z")
    return ranked.withColumn("z", F.col("z").cast("int"))


def read_slice_folder(spark: SparkSession, path: str | list[str], gray: str = "luma") -> DataFrame:
    """A folder (or glob of folders) of images as slices, z in file-name order. Empty input is an error.

    A volume is a folder, named by the folders that tell it apart (``folders_told_apart``). Names are ranked first, of the
    readable files only; pixels go straight from the files to whoever reads the result and are never stored here.
    """
    depth = folders_told_apart(path)
    folders = F.array_join(F.slice(F.split("path", "/"), -1 - depth, depth), "/")
    pictures = read_images(spark, path).withColumn("volume_id", folders)
    numbered = slice_index(pictures.select("volume_id", "name"))
    if not numbered.head(1):
        raise FileNotFoundError(f"no images under {path}")
    return _numbered(gray_slices(pictures, F.col("volume_id"), F.lit(0), gray), numbered)


def _numbered(decoded: DataFrame, numbered: DataFrame) -> DataFrame:
    """Give every slice its rank; up to 500,000 names are sent to the slices instead of the slices to the names."""
    return decoded.drop("z").join(broadcast_if_small(numbered, 500_000), ["volume_id", "name"]).select(*SLICE_COLUMNS)


def read_slice_tree(spark: SparkSession, root: str, gray: str = "luma") -> DataFrame:
    """All images under ``root``; the relative path is the slice name.

    A volume is a folder, named by its path below the root (the root's own name for files in it), z in file-name order.
    """
    images = read_images(spark, root, recursive=True)
    plain = re.sub(r"^\w+:/*", "", root).strip("/").removeprefix("./")
    anchor = f"/{plain}/"
    relative = F.expr(f"substring(path, locate({_quoted(anchor)}, path) + {len(anchor)})")
    below = F.regexp_extract("name", "^(.*)/[^/]*$", 1)
    named = images.withColumn("name", relative).withColumn("volume_id", F.when(below == "", plain.split("/")[-1]).otherwise(below))
    return _numbered(gray_slices(named, F.col("volume_id"), F.lit(0), gray), slice_index(named.select("volume_id", "name")))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_npy_volumes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``.npy`` files as slices: one file gives one volume; a 2D array is one slice; other ranks fail."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                volume = np.load(io.BytesIO(row.content), allow_pickle=False)
                if volume.ndim == 2:
                    volume = volume[None]
                if volume.ndim != 3:
                    raise ValueError(f"{row.path}: expected a 2D or 3D array, got shape {volume.shape}")
                stem = row.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for z, image in enumerate(volume):
                    fields = [stem, z, f"{stem}_{z:04d}", *image.shape, str(image.dtype), image.tobytes()]
                    yield pd.DataFrame([fields], columns=SLICE_COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(decode, SLICE_SCHEMA)
