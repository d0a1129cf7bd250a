"""Rotation of a stack in its (z, x) plane and the axis swap that goes with it.

Every image line y turns on its own. Slices are cut into strips of a few lines (a byte substring, JVM
side) and each strip goes to the square output tiles its turned line can touch. A group is one tile of
one strip, so its size depends on the tile and the image width, never on the depth of the volume. The
finished tile rows meet once more, one group per output slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA, extent, small_batches
from voxelloom.session import broadcast_if_small

PART_SCHEMA = "volume_id string, z int, strip int, part int, h int, w int, data binary"


def turned_size(n_z: int, n_x: int, angle: float) -> tuple[int, int]:
    """Size of the plane that holds the whole turned input."""
    c, s = abs(np.cos(np.deg2rad(angle))), abs(np.sin(np.deg2rad(angle)))
    return int(c * n_z + s * n_x + 0.5), int(s * n_z + c * n_x + 0.5)


def turned_geometry(n_z: int, n_x: int, angle: float, rows=None, cols=None) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
    """Output size and the input position (z, x) of the wanted output rows and columns (all by default)."""
    out_z, out_x = turned_size(n_z, n_x, angle)
    c, s = np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
    z = ((np.arange(out_z) if rows is None else rows) - (out_z - 1) / 2)[:, None]
    x = ((np.arange(out_x) if cols is None else cols) - (out_x - 1) / 2)[None, :]
    return (out_z, out_x), c * z + s * x + (n_z - 1) / 2, -s * z + c * x + (n_x - 1) / 2


def plane_samples(at_z: np.ndarray, at_x: np.ndarray, inside: np.ndarray, shape: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four (flat input position, weight) pairs of the bilinear samples at the ``inside`` output pixels."""
    n_z, n_x = shape
    z, x = at_z[inside], at_x[inside]
    z0 = np.clip(np.floor(z).astype(np.int64), 0, max(n_z - 2, 0))
    x0 = np.clip(np.floor(x).astype(np.int64), 0, max(n_x - 2, 0))
    z1, x1 = np.minimum(z0 + 1, n_z - 1), np.minimum(x0 + 1, n_x - 1)
    fz, fx = z - z0, x - x0
    corners = ((z0, x0, 1 - fz, 1 - fx), (z0, x1, 1 - fz, fx), (z1, x0, fz, 1 - fx), (z1, x1, fz, fx))
    return [(row * n_x + column, wz * wx) for row, column, wz, wx in corners]


def turned_depth(volumes: DataFrame, angle: float, swap_before: bool = False, swap_after: bool = False) -> DataFrame:
    """(volume_id, n_slices, w_max) of the rotated stacks, from those of the input alone."""
    out = _out_sizes(F.col("n_slices"), F.col("w_max"), angle, swap_before)
    depth, width = (out[1], out[0]) if swap_after else out
    return volumes.select("volume_id", depth.alias("n_slices"), width.alias("w_max"))


def _out_sizes(n: Column, w: Column, angle: float, swap_before: bool) -> tuple[Column, Column]:
    c, s = float(abs(np.cos(np.deg2rad(angle)))), float(abs(np.sin(np.deg2rad(angle))))
    n_z, n_x = (w, n) if swap_before else (n, w)
    return F.floor(n_z * c + n_x * s + 0.5).cast("int"), F.floor(n_z * s + n_x * c + 0.5).cast("int")


def rotate_plane(
    slices: DataFrame, angle: float = 52, binary: bool = False, swap_before: bool = False, swap_after: bool = False,
    lines: int = 16, tile: int = 1024, volumes: DataFrame | None = None,
) -> DataFrame:
    """Rotate 8-bit stacks by ``angle`` degrees in (z, x), output grown to fit, outside 0.

    Bytes round to nearest; ``binary=True`` gives 1 above one half. ``swap_before`` / ``swap_after``
    exchange the z and x axes on the way in or out. A volume may start at any z, the result starts at 0.
    Slices must be dense in z and of one size; others raise. ``volumes`` (volume_id, n_slices) saves that
    check where the slices are known to be whole and to start at 0.
    """
    c, s = float(np.cos(np.deg2rad(angle))), float(np.sin(np.deg2rad(angle)))
    known = extent(slices) if volumes is None else volumes.withColumn("first_z", F.lit(0))
    depth = known.select("volume_id", "first_z", F.col("n_slices").cast("int").alias("n"))
    is_byte = F.col("dtype").isin("uint8", "bool")
    data = F.when(is_byte, F.col("data")).otherwise(F.raise_error(F.lit("only 8-bit slices can be turned")).cast("binary")).alias("data")
    sized = slices.select("volume_id", "z", "h", "w", data).join(broadcast_if_small(depth, 500_000), "volume_id")
    sized = sized.withColumn("z", F.col("z") - F.col("first_z"))

    # The two ends of a turned line, in output pixels, give the tiles it may touch.
    out_z, out_x = _out_sizes(F.col("n"), F.col("w"), angle, swap_before)
    fixed, run = F.col("fixed"), F.col("run")
    if swap_before:
        middle, reach = (-s * fixed, c * fixed), (c * run, s * run)
    else:
        middle, reach = (c * fixed, s * fixed), (-s * run, c * run)
    placed = (
        sized.withColumns({"out_z": out_z, "out_x": out_x, "fixed": F.col("z") - (F.col("n") - 1) / 2, "run": (F.col("w") - 1) / 2})
        .withColumns({"mid_z": middle[0] + (F.col("out_z") - 1) / 2, "mid_x": middle[1] + (F.col("out_x") - 1) / 2})
        .withColumns({"reach_z": F.abs(reach[0]) + 2, "reach_x": F.abs(reach[1]) + 2})
    )

    def tiles(axis: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(f"mid_{axis}") - F.col(f"reach_{axis}")) / tile))
        last = F.least(F.floor((F.col(f"out_{axis}") - 1) / tile), F.floor((F.col(f"mid_{axis}") + F.col(f"reach_{axis}")) / tile))
        return F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))

    span = F.lit(lines) * F.col("w")
    cut = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("h") / lines).cast("int") - 1),
        lambda i: F.struct(i.alias("strip"), F.col("data").substr(i * span + 1, span).alias("data")),
    )
    strips = (
        placed.withColumn("tz", F.explode(tiles("z")))
        .withColumn("tx", F.explode(tiles("x")))
        .select("volume_id", "z", "w", "n", "tz", "tx", F.explode(cut).alias("c"))
        .select("volume_id", "z", "w", "n", "tz", "tx", "c.strip", "c.data")
    )

    def turn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, n = int(pdf["w"].iat[0]), int(pdf["n"].iat[0])
        first = int(pdf["z"].min())
        images = [np.frombuffer(data, np.uint8).reshape(-1, w) for data in pdf["data"]]
        block = np.zeros((int(pdf["z"].max()) - first + 1, *images[0].shape), np.uint8)
        block[pdf["z"].to_numpy() - first] = images
        n_z, n_x = (w, n) if swap_before else (n, w)
        size = turned_size(n_z, n_x, angle)
        rows, cols = (np.arange(t * tile, min(length, (t + 1) * tile)) for t, length in zip(key[2:4], size))
        _, at_z, at_x = turned_geometry(n_z, n_x, angle, rows, cols)
        inside = (at_z >= 0) & (at_z <= n_z - 1) & (at_x >= 0) & (at_x <= n_x - 1)
        # Positions and weights are the same for every line of the strip.
        if swap_before:
            block, at_x = block.transpose(2, 1, 0), at_x - first
        else:
            at_z = at_z - first
        samples = plane_samples(at_z, at_x, inside, (block.shape[0], block.shape[2]))
        turned = np.zeros((len(rows), block.shape[1], len(cols)), np.uint8)
        for y in range(block.shape[1]):
            line = np.ascontiguousarray(block[:, y, :]).ravel()
            value = sum(line[position] * weight for position, weight in samples)
            plane = np.zeros(inside.shape, np.uint8)
            plane[inside] = value > 0.5 if binary else np.clip(np.floor(value + 0.5), 0, 255)
            turned[:, y, :] = plane
        numbers, part = rows, key[3]
        if swap_after:
            turned, numbers, part = turned.transpose(2, 1, 0), cols, key[2]
        return pd.DataFrame(
            {
                "volume_id": key[0], "z": numbers.astype(np.int32), "strip": key[1], "part": part, "h": turned.shape[1],
                "w": turned.shape[2], "data": [np.ascontiguousarray(image).tobytes() for image in turned],
            }
        )

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            packed = []
            for h, w, parts in zip(batch["h"], batch["w"], batch["parts"]):
                image = np.zeros((h, w), np.uint8)
                for part in parts:
                    y, x = part["strip"] * lines, part["part"] * tile
                    image[y : y + part["h"], x : x + part["w"]] = np.frombuffer(part["data"], np.uint8).reshape(part["h"], part["w"])
                packed.append(image.tobytes())
            yield batch[SLICE_COLUMNS[:-1]].assign(data=packed)

    turned = strips.groupBy("volume_id", "strip", "tz", "tx").applyInPandas(turn, PART_SCHEMA)
    # One group is one output slice; its parts are placed by their own offsets, so their order is free.
    whole = turned.groupBy("volume_id", "z").agg(
        F.collect_list(F.struct("strip", "part", "h", "w", "data")).alias("parts"),
        F.max(F.col("strip") * lines + F.col("h")).alias("h"), F.max(F.col("part") * tile + F.col("w")).alias("w"),
    )
    named = whole.select(
        "volume_id", "z", F.format_string("slice_%04d.png", "z").alias("name"), "h", "w", F.lit("uint8").alias("dtype"), "parts"
    )
    return named.mapInPandas(assemble, SLICE_SCHEMA)
