"""The three table layouts and the conversions between them.

``slices``  one row per image slice, pixels packed row-major as bytes (storage and Arrow kernels)
``voxels``  one row per pixel (coordinate joins; normally only a view that is aggregated at once)
``hist``    ``(volume_id, z, v, n)``, at most 256 rows per 8-bit slice (nearly all statistics)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_SCHEMA = "volume_id string, z int, name string, h int, w int, dtype string, data binary"
VOXEL_SCHEMA = "volume_id string, z int, y int, x int, v int"
HIST_SCHEMA = "volume_id string, z int, v int, n bigint"


def image_of(row) -> np.ndarray:
    """The 2D array held by one ``slices`` row."""
    return np.frombuffer(row.data, dtype=np.dtype(row.dtype)).reshape(row.h, row.w)


PART_BYTES = 1 << 19  # bytes of a batch that a kernel takes at once


def small_batches(batches: Iterator[pd.DataFrame], limit: int = PART_BYTES) -> Iterator[pd.DataFrame]:
    """The rows again, in batches of about ``limit`` bytes; a larger row is alone.

    A batch comes with up to 10,000 rows, and a kernel may need eight or more bytes for each of its pixels: a task's memory
    depends on ``limit`` and its largest slice, not on how many slices a batch has. Empty batches are left out.
    """
    def weight(value) -> int:
        if isinstance(value, (bytes, bytearray)):
            return len(value)
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, (list, np.ndarray)) else ()
        return 64 + sum(map(weight, inner))

    for batch in batches:
        size = np.zeros(len(batch), np.int64)
        for name in batch.columns:
            if batch[name].dtype == object:
                size += np.fromiter(map(weight, batch[name]), np.int64, len(batch))
        ends = np.cumsum(size)
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + limit, "right")))
            yield batch.iloc[start:stop].reset_index(drop=True)
            start = stop


def whole_pixels(row) -> np.ndarray:
    """The 2D array of a ``slices`` row whose pixels are whole numbers of 32 bits at most; others raise."""
    image = image_of(row)
    if image.dtype.kind not in "bui":
        raise ValueError(f"{row.volume_id}, z = {row.z}: {row.dtype} pixels are no whole numbers; bring them to bytes first")
    if image.dtype.itemsize > 2 and image.size and (image.max() > 2**31 - 1 or image.min() < -(2**31)):
        raise ValueError(f"{row.volume_id}, z = {row.z}: pixel values beyond 32 bits")
    return image


def slices_to_voxels(slices: DataFrame) -> DataFrame:
    """Unpack slices of whole numbers to one row per pixel. Narrow: no shuffle."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            for row in batch.itertuples(index=False):
                pixels = whole_pixels(row).ravel()
                position = np.arange(pixels.size)
                yield pd.DataFrame(
                    {
                        "volume_id": row.volume_id,
                        "z": np.int32(row.z),
                        "y": (position // row.w).astype(np.int32),
                        "x": (position % row.w).astype(np.int32),
                        "v": pixels.astype(np.int32),
                    }
                )

    return slices.select("volume_id", "z", "h", "w", "dtype", "data").mapInPandas(unpack, VOXEL_SCHEMA)


def slices_to_hist(slices: DataFrame, sizes: bool = False) -> DataFrame:
    """Count pixel values per slice inside the scan's own tasks.

    One pass over the bytes and no shuffle: a slice is one row, so its counts are already complete. An 8-bit
    slice gives at most 256 rows, a 16-bit one 65,536; fractional pixels raise. ``sizes`` adds ``h`` and ``w`` of the slice,
    so that ``extent_of_hist`` needs no second pass. Status rows (without data) count nothing.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            batch = batch[batch["data"].notna()]
            is_byte = batch["dtype"].isin(["uint8", "bool"])
            for row in batch[~is_byte].itertuples(index=False):
                values, counts = np.unique(whole_pixels(row), return_counts=True)
                yield pd.DataFrame(
                    {"volume_id": row.volume_id, "z": np.int32(row.z), "v": values.astype(np.int32), "n": counts}
                    | ({"h": row.h, "w": row.w} if sizes else {})
                )
            batch = batch[is_byte]
            if batch.empty:
                continue
            pixels = np.frombuffer(b"".join(batch["data"]), dtype=np.uint8)
            owner = np.repeat(np.arange(len(batch)), batch["data"].str.len())
            counts = np.bincount(owner * 256 + pixels, minlength=256 * len(batch))
            cell = np.flatnonzero(counts)
            yield pd.DataFrame(
                {
                    "volume_id": batch["volume_id"].to_numpy()[cell // 256],
                    "z": batch["z"].to_numpy()[cell // 256],
                    "v": (cell % 256).astype(np.int32),
                    "n": counts[cell],
                }
                | ({name: batch[name].to_numpy()[cell // 256] for name in ("h", "w")} if sizes else {})
            )

    schema = HIST_SCHEMA + (", h int, w int" if sizes else "")
    return slices.select("volume_id", "z", "h", "w", "dtype", "data").mapInPandas(count, schema)


def voxels_to_hist(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Counts per (volume, slice, value); partial aggregation bounds the shuffle by 256 rows per slice."""
    return voxels.groupBy("volume_id", "z", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def voxels_to_slices(voxels: DataFrame, h: Column | int, w: Column | int) -> DataFrame:
    """Pack pixels to 8-bit slices; absent pixels become 0. One group is one slice."""

    def pack(key: tuple, pixels: pd.DataFrame) -> pd.DataFrame:
        height, width = int(pixels["h"].iat[0]), int(pixels["w"].iat[0])
        image = np.zeros((height, width), np.uint8)
        image[pixels["y"], pixels["x"]] = pixels["v"]
        name = f"slice_{key[1]:04d}.png"
        return pd.DataFrame([[*key, name, height, width, "uint8", image.tobytes()]], columns=SLICE_COLUMNS)

    sized = voxels.select(
        "volume_id",
        "z",
        "y",
        "x",
        "v",
        (h if isinstance(h, Column) else F.lit(h)).cast("int").alias("h"),
        (w if isinstance(w, Column) else F.lit(w)).cast("int").alias("w"),
    )
    return sized.groupBy("volume_id", "z").applyInPandas(pack, SLICE_SCHEMA)


SLICE_COLUMNS = [part.split()[0] for part in SLICE_SCHEMA.split(", ")]


STATUS_SCHEMA = SLICE_SCHEMA + ", error string"


def _kernel_rows(batch: pd.DataFrame, call: Callable, dtype: str, status: bool) -> pd.DataFrame:
    """One result row per row of ``batch``. With ``status``, a row that fails, or came without data, has an error instead of data."""
    shapes, packed, errors = [], [], []
    for row in batch.itertuples(index=False):
        known = getattr(row, "error", None)
        try:
            if status and (known is not None or row.data is None):
                raise ValueError(known or "no data")
            image = np.ascontiguousarray(call(row), dtype=dtype)
        except Exception as problem:
            if not status:
                raise
            shapes.append((row.h, row.w))
            packed.append(None)
            errors.append(str(problem) or type(problem).__name__)
        else:
            shapes.append(image.shape)
            packed.append(image.tobytes())
            errors.append(None)
    out = batch[SLICE_COLUMNS].assign(h=[h for h, _ in shapes], w=[w for _, w in shapes], dtype=dtype, data=packed)
    return out.assign(error=errors) if status else out


def _with_error(slices: DataFrame) -> DataFrame:
    return slices if "error" in slices.columns else slices.withColumn("error", F.lit(None).cast("string"))


def map_slices(slices: DataFrame, fn: Callable[[np.ndarray], np.ndarray], dtype: str = "uint8", status: bool = False) -> DataFrame:
    """Apply a user function ``image -> image`` to every slice, inside the scan's tasks.

    The result may have another size; ``h``, ``w`` and ``dtype`` follow it. A slice that fails ends the job; with ``status``
    it comes back without data and with the problem in an extra column ``error``, and rows that already have
    one pass through, so that kernels can follow each other (``failures`` counts such rows).
    """
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            yield _kernel_rows(batch, lambda row: fn(image_of(row)), dtype, status)

    if status:
        return _with_error(slices).select(*SLICE_COLUMNS, "error").mapInPandas(apply, STATUS_SCHEMA)
    return slices.select(*SLICE_COLUMNS).mapInPandas(apply, SLICE_SCHEMA)


def check_slices(slices: DataFrame) -> DataFrame:
    """Add ``error`` to slices whose data is missing or does not fill h x w pixels of its type; their data goes. No Python."""
    size = F.when(F.col("dtype").isin("uint8", "int8", "bool"), 1).when(F.col("dtype").isin("uint16", "int16"), 2)
    size = size.when(F.col("dtype").isin("uint32", "int32", "float32"), 4).when(F.col("dtype").isin("uint64", "int64", "float64"), 8)
    wanted = F.col("h").cast("long") * F.col("w") * size
    problem = (
        F.when(F.col("data").isNull(), "no data")
        .when(size.isNull(), F.concat(F.lit("unknown pixel type "), F.coalesce("dtype", F.lit("null"))))
        .when(F.coalesce(F.length("data") != wanted, F.lit(True)), "data does not fill the slice")
    )
    known = F.coalesce(F.col("error"), problem) if "error" in slices.columns else problem
    return slices.withColumn("error", known).withColumn("data", F.when(F.col("error").isNull(), F.col("data")))


def failures(rows: DataFrame) -> DataFrame:
    """(volume_id, error, n, first_z) of the status rows of any slice kernel."""
    return rows.where("error IS NOT NULL").groupBy("volume_id", "error").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("first_z"))


def zip_slices(
    left: DataFrame, right: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str = "uint8", status: bool = False
) -> DataFrame:
    """Combine two stacks slice by slice; both images are cut to their common size first. ``status`` as in ``map_slices``."""
    def pair(row) -> np.ndarray:
        a = np.frombuffer(row.data, np.dtype(row.dtype)).reshape(row.h, row.w)
        b = np.frombuffer(row.data_b, np.dtype(row.dtype_b)).reshape(row.h_b, row.w_b)
        h, w = min(row.h, row.h_b), min(row.w, row.w_b)
        return fn(a[:h, :w], b[:h, :w])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            yield _kernel_rows(batch, pair, dtype, status)

    renamed = right.select(
        "volume_id", "z", F.col("h").alias("h_b"), F.col("w").alias("w_b"), F.col("dtype").alias("dtype_b"),
        F.col("data").alias("data_b"), *([_with_error(right)["error"].alias("error_b")] if status and "error" in right.columns else []),
    )
    columns = [*SLICE_COLUMNS, *(["error"] if status else [])]
    joined = (_with_error(left) if status else left).select(*columns).join(renamed, ["volume_id", "z"])
    if "error_b" in renamed.columns:
        joined = joined.withColumn("error", F.coalesce("error", "error_b")).drop("error_b")
    return joined.mapInPandas(apply, STATUS_SCHEMA if status else SLICE_SCHEMA)


def copy_window(slices: DataFrame, src_y, src_x, dst_y, dst_x, n_y, n_x, out_h, out_w) -> DataFrame:
    """Move one pixel window of each slice onto a zero canvas.

    The eight geometry arguments are Catalyst expressions over the slice row, so crops, paddings and
    centred fits share this single byte-moving step and stay shuffle-free.
    """
    geometry = {
        "src_y": src_y, "src_x": src_x, "dst_y": dst_y, "dst_x": dst_x,
        "n_y": n_y, "n_x": n_x, "out_h": out_h, "out_w": out_w,
    }

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            packed = []
            for row in batch.itertuples(index=False):
                canvas = np.zeros((row.out_h, row.out_w), np.dtype(row.dtype))
                if row.n_y > 0 and row.n_x > 0:
                    window = image_of(row)[row.src_y : row.src_y + row.n_y, row.src_x : row.src_x + row.n_x]
                    canvas[row.dst_y : row.dst_y + row.n_y, row.dst_x : row.dst_x + row.n_x] = window
                packed.append(canvas.tobytes())
            yield batch[SLICE_COLUMNS].assign(h=batch["out_h"], w=batch["out_w"], data=packed)

    columns = [
        (value if isinstance(value, Column) else F.lit(value)).cast("int").alias(name)
        for name, value in geometry.items()
    ]
    return slices.select(*SLICE_COLUMNS, *columns).mapInPandas(move, SLICE_SCHEMA)


def manifest(slices: DataFrame) -> DataFrame:
    """Shape of every volume, read from the metadata columns only (pixels stay on disk)."""
    return slices.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("n_slices"),
        F.min("h").alias("h_min"),
        F.max("h").alias("h_max"),
        F.min("w").alias("w_min"),
        F.max("w").alias("w_max"),
        F.min("dtype").alias("dtype"),
        (F.countDistinct("dtype") == 1).alias("one_dtype"),
    )


def extent_of_hist(hist: DataFrame) -> DataFrame:
    """``extent`` from counts with sizes; a z that occurs twice counts more pixels than its slice has."""
    per_slice = hist.groupBy("volume_id", "z", "h", "w").agg(F.sum("n").alias("_n"))
    copies = F.ceil(F.col("_n") / F.greatest(F.lit(1), F.col("h") * F.col("w"))).cast("int")
    return extent(per_slice.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), copies)))))


def extent(slices: DataFrame) -> DataFrame:
    """(volume_id, first_z, n_slices, h_max, w_max) of whole volumes; gaps, repeated z and mixed sizes raise."""
    found = slices.groupBy("volume_id").agg(
        F.min("z").alias("first_z"), (F.max("z") - F.min("z") + 1).cast("int").alias("n_slices"), F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("z").alias("_places"), F.min("h").alias("_h"), F.max("h").alias("h_max"), F.min("w").alias("_w"), F.max("w").alias("w_max"),
    )
    whole = (F.col("_rows") == F.col("n_slices")) & (F.col("_places") == F.col("n_slices")) & (F.col("_h") == F.col("h_max")) & (F.col("_w") == F.col("w_max"))
    fault = F.raise_error(F.concat(F.lit("slices missing, repeated or of several sizes in volume "), "volume_id")).cast("int")
    return found.select("volume_id", "first_z", F.when(whole, F.col("n_slices")).otherwise(fault).alias("n_slices"), "h_max", "w_max")


def compare_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """Do two stacks agree on slice count and on slice size? One row per volume of either side."""
    a, b = manifest(left).alias("a"), manifest(right).alias("b")
    problem = (
        F.when(F.col("a.n_slices").isNull() | F.col("b.n_slices").isNull(), "missing")
        .when(F.col("a.n_slices") != F.col("b.n_slices"), "z_mismatch")
        .when((F.col("a.h_max") != F.col("b.h_max")) | (F.col("a.w_max") != F.col("b.w_max")), "xy_mismatch")
        .otherwise("ok")
    )
    return a.join(b, F.col("a.volume_id") == F.col("b.volume_id"), "full").select(
        F.coalesce("a.volume_id", "b.volume_id").alias("volume_id"),
        F.col("a.n_slices").alias("left_slices"),
        F.col("b.n_slices").alias("right_slices"),
        problem.alias("status"),
    )
