"""Region boxes: presets, automatic detection, tracking along z, key-slice interpolation, masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA, image_of, map_slices, small_batches

BOX = ["x_min", "y_min", "x_max", "y_max"]


def preset_box(volumes: DataFrame, top: int = 180, bottom: int = 150, left: int = 20, right: int = 20) -> DataFrame:
    """Box inside fixed margins of each volume of a manifest."""
    return volumes.select(
        "volume_id", "n_slices", F.col("h_max").alias("h"),
        F.lit(left).alias("x_min"), F.lit(top).alias("y_min"),
        (F.col("w_max") - right).alias("x_max"), (F.col("h_max") - bottom).alias("y_max"),
    )


def track_shifting_box(boxes: DataFrame, rate: float = -0.15) -> DataFrame:
    """The box of every slice when it shifts by ``int(z * rate)`` rows upwards, kept inside the image.

    A closed form in z, so each volume's slices are generated without a join or window. A negative rate
    moves the box to larger y.
    """
    z = F.col("z")
    height = F.col("y_max") - F.col("y_min")
    shift = (z * F.lit(float(rate))).cast("int")
    first = F.greatest(F.lit(0), F.col("y_min") - shift)
    last = F.least(F.col("h"), first + height)
    return (
        boxes.withColumn("z", F.explode(F.sequence(F.lit(0), (F.col("n_slices") - 1).cast("int"))))
        .withColumn("_last", last)
        .withColumn("_first", F.when(F.col("_last") == F.col("h"), F.col("h") - height).otherwise(first))
        .select("volume_id", "z", "x_min", F.col("_first").alias("y_min"), "x_max", F.col("_last").alias("y_max"))
    )


def key_slices(n: str | Column = "n_slices") -> Column:
    """The five slices a user would mark: second, quarter, middle, three quarters, last."""
    n = (F.col(n) if isinstance(n, str) else n).cast("int")
    quarter = F.floor(n / 4)
    return F.array_distinct(
        F.array(
            F.least(F.lit(1), n - 1), quarter.cast("int"), F.floor(n / 2).cast("int"), F.floor(3 * n / 4).cast("int"), n - 1
        )
    )


def keyframe_interpolate(keys: DataFrame) -> DataFrame:
    """Boxes of all slices between marked key slices (volume_id, z, box): linear, each edge truncated.

    Each pair of neighbouring keys generates its own slices; outside the first and last key there is none.
    The window runs over the handful of key rows, not over slices.
    """
    order = Window.partitionBy("volume_id").orderBy("z")
    here, nxt = F.struct("z", *BOX), F.lead(F.struct("z", *BOX)).over(order)
    spans = keys.select("volume_id", here.alias("a"), nxt.alias("b"))
    stop = F.when(F.col("b").isNull(), F.col("a.z")).otherwise(F.col("b.z") - 1)
    per_slice = spans.withColumn("z", F.explode(F.sequence(F.col("a.z"), stop)))
    weight = F.coalesce((F.col("z") - F.col("a.z")).cast("double") / (F.col("b.z") - F.col("a.z")), F.lit(0.0))

    def between(edge: str) -> Column:
        mixed = F.col(f"a.{edge}") * (1 - weight) + F.coalesce(F.col(f"b.{edge}"), F.lit(0)) * weight
        return mixed.cast("int").alias(edge)

    return per_slice.select("volume_id", "z", *[between(edge) for edge in BOX])


def content_lines(slices: DataFrame, factor: float = 0.8, share: float = 0.05) -> DataFrame:
    """(volume_id, z, axis, line, bright): rows (axis ``y``) and columns (``x``) with enough bright pixels.

    Bright means above the slice mean times ``factor``; enough means more than ``share`` of the line. A
    slice is one row, so nothing shuffles.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            for row in batch.itertuples(index=False):
                image = image_of(row)
                bright = image > image.mean() * factor
                for axis, along in (("y", 1), ("x", 0)):
                    counts = bright.sum(axis=along)
                    lines = np.flatnonzero(counts > bright.shape[along] * share)
                    yield pd.DataFrame(
                        {"volume_id": row.volume_id, "z": np.int32(row.z), "axis": axis, "line": lines, "bright": counts[lines]}
                    )

    return slices.select(*SLICE_COLUMNS).mapInPandas(find, "volume_id string, z int, axis string, line int, bright bigint")


def overall_box(
    slices: DataFrame, volumes: DataFrame, padding: int = 10, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0
) -> DataFrame:
    """Automatic box per volume: content of first, middle and last slice, padded, inside margins, united.

    Only the three slices of each volume are opened. The last content line plus padding is the exclusive
    end. Volumes without content get the margin box.
    """
    shape = volumes.select("volume_id", "n_slices", F.col("h_max").alias("h"), F.col("w_max").alias("w"))
    n = F.col("n_slices").cast("int")
    sampled = shape.select(
        "volume_id", F.explode(F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1))).alias("z")
    )
    lines = content_lines(slices.join(sampled, ["volume_id", "z"], "left_semi"))

    def end(take, axis: str, name: str) -> Column:
        return take(F.when(F.col("axis") == axis, F.col("line"))).alias(name)

    per_slice = lines.groupBy("volume_id", "z").agg(
        end(F.min, "y", "y0"), end(F.max, "y", "y1"), end(F.min, "x", "x0"), end(F.max, "x", "x1")
    )
    both = per_slice.where("y0 IS NOT NULL AND x0 IS NOT NULL").join(shape, "volume_id")
    united = both.groupBy("volume_id").agg(
        F.min(F.greatest(F.lit(left), F.col("x0") - padding)).alias("x_min"),
        F.min(F.greatest(F.lit(top), F.col("y0") - padding)).alias("y_min"),
        F.max(F.least(F.col("w") - right, F.col("x1") + padding)).alias("x_max"),
        F.max(F.least(F.col("h") - bottom, F.col("y1") + padding)).alias("y_max"),
    )
    return shape.join(united, "volume_id", "left").select(
        "volume_id", "n_slices", "h",
        F.coalesce("x_min", F.lit(left)).alias("x_min"), F.coalesce("y_min", F.lit(top)).alias("y_min"),
        F.coalesce("x_max", F.col("w") - right).alias("x_max"), F.coalesce("y_max", F.col("h") - bottom).alias("y_max"),
    )


def roi_box_mask(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Add ``region``: is the pixel inside its own slice's box? Equality on the slice, range inside it."""
    inside = (
        (F.col("y") >= F.col("y_min")) & (F.col("y") < F.col("y_max"))
        & (F.col("x") >= F.col("x_min")) & (F.col("x") < F.col("x_max"))
    )
    joined = voxels.join(boxes.select("volume_id", "z", *BOX), ["volume_id", "z"], "left")
    return joined.withColumn("region", F.coalesce(inside, F.lit(False))).drop(*BOX)


def box_masks(slices: DataFrame, boxes: DataFrame) -> DataFrame:
    """Packed 0/1 masks of the slices' own boxes, 0 everywhere without a box.

    Only slice metadata meets the boxes; the pixels are not read.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            packed = []
            for row in batch.itertuples(index=False):
                mask = np.zeros((row.h, row.w), np.uint8)
                mask[max(0, row.y_min) : max(0, row.y_max), max(0, row.x_min) : max(0, row.x_max)] = 1
                packed.append(mask.tobytes())
            yield batch[SLICE_COLUMNS[:-1]].assign(data=packed)

    meta = slices.select("volume_id", "z", "name", "h", "w", F.lit("uint8").alias("dtype"))
    placed = meta.join(boxes.select("volume_id", "z", *BOX), ["volume_id", "z"], "left").na.fill(0, BOX)
    return placed.mapInPandas(draw, SLICE_SCHEMA)


def bounding_box(masks: DataFrame, above: float = 0) -> DataFrame:
    """Smallest box (inclusive ends) around the pixels above a value of each packed slice; ``empty`` marks slices without any.

    Rows and columns are projected inside the scan's tasks: one row per slice leaves them, and nothing shuffles.
    """
    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            found = []
            for row in batch.itertuples(index=False):
                inside = image_of(row) > above
                rows, columns = np.flatnonzero(inside.any(axis=1)), np.flatnonzero(inside.any(axis=0))
                ends = (rows[0], rows[-1], columns[0], columns[-1]) if len(rows) else (None,) * 4
                found.append((row.volume_id, row.z, *ends, not len(rows)))
            out = pd.DataFrame(found, columns=["volume_id", "z", "min_row", "max_row", "min_col", "max_col", "empty"])
            yield out.astype({name: "Int32" for name in ("min_row", "max_row", "min_col", "max_col")})

    schema = "volume_id string, z int, min_row int, max_row int, min_col int, max_col int, empty boolean"
    return masks.select("volume_id", "z", "h", "w", "dtype", "data").mapInPandas(project, schema)


def mask_boundary(mask: DataFrame) -> DataFrame:
    """Packed 0/1 masks to their outline: region pixels with a 4-neighbour outside the region or the image."""

    def outline(image: np.ndarray) -> np.ndarray:
        inside = np.pad(image > 0, 1)
        interior = inside[:-2, 1:-1] & inside[2:, 1:-1] & inside[1:-1, :-2] & inside[1:-1, 2:]
        return (inside[1:-1, 1:-1] & ~interior).astype(np.uint8)

    return map_slices(mask, outline)
