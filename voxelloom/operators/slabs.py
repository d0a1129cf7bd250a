"""3D neighbourhood operators on packed slices, exchanged once as z-blocks or (z, y, x) tiles with a halo.

A piece of a slice travels to its own block and to every block whose stencil reaches it, so one shuffle moves the packed
bytes (one byte per voxel) about ``(1 + 2 * halo / block)`` times instead of one long row per voxel and offset. The group
key is (volume, block) or (volume, block, tile row, tile column): with tiles, a group's bytes depend on neither the depth of
the volume nor the size of its slices. Blocks end where the volume ends, so a kernel meets the true border and nothing else;
what it gets wrong near a cut lies in the halo, which is left out of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA, map_slices, slices_to_hist, small_batches
from voxelloom.session import broadcast_if_small, cut_lineage

BLOCK = 16
PIECE = ["_top", "_left", "_rows", "_cols", "_piece"]
PIECE_SCHEMA = "_top int, _left int, _rows int, _cols int, _piece binary"


def _spans(size: int, tile: int, halo: int) -> list[tuple[int, int, int]]:
    """(tile, first, stop) of the lines each tile needs."""
    return [(t, max(0, t * tile - halo), min(size, (t + 1) * tile + halo)) for t in range(-(-size // tile))]


def cut_tiles(slices: DataFrame, tile: int, halo: int, extra: list[str]) -> DataFrame:
    """Every slice as overlapping pieces, inside the scan's tasks: one row per tile, with ``halo`` more lines on inner sides."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            for row in batch.itertuples(index=False):
                image = np.frombuffer(row.data, np.dtype(row.dtype)).reshape(row.h, row.w)
                places, packed = [], []
                for ty, y0, y1 in _spans(row.h, tile, halo):
                    for tx, x0, x1 in _spans(row.w, tile, halo):
                        places.append((ty, tx, y0, x0, y1 - y0, x1 - x0))
                        packed.append(np.ascontiguousarray(image[y0:y1, x0:x1]).tobytes())
                out = pd.DataFrame(places, columns=["_ty", "_tx", *PIECE[:-1]], dtype=np.int32)
                for name in [*SLICE_COLUMNS[:-1], *extra]:
                    out[name] = getattr(row, name)
                yield out.assign(_piece=packed)

    kept = slices.select(*SLICE_COLUMNS, *extra)
    kinds = ", ".join(f"{name} {kind}" for name, kind in kept.dtypes if name != "data")
    return kept.mapInPandas(cut, f"{kinds}, _ty int, _tx int, {PIECE_SCHEMA}")


def join_tiles(tiles: DataFrame) -> DataFrame:
    """Whole slices from the finished tiles: one group is one slice, each tile placed by its own offsets."""
    def paste(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            packed = []
            for h, w, dtype, parts in zip(batch["h"], batch["w"], batch["dtype"], batch["parts"]):
                image = np.zeros((h, w), np.dtype(dtype))
                for part in parts:
                    y, x, rows, cols = (part[name] for name in PIECE[:-1])
                    image[y : y + rows, x : x + cols] = np.frombuffer(part["_piece"], image.dtype).reshape(rows, cols)
                packed.append(image.tobytes())
            yield batch[SLICE_COLUMNS[:-1]].assign(data=packed)

    whole = tiles.groupBy(*SLICE_COLUMNS[:-1]).agg(F.collect_list(F.struct(*PIECE)).alias("parts"))
    return whole.mapInPandas(paste, SLICE_SCHEMA)


def map_tiles(
    slices: DataFrame, kernel: Callable[..., np.ndarray], halo: int, block: int = BLOCK, tile: int | None = None, extra: list[str] | None = None,
) -> DataFrame:
    """Run ``kernel(volume[z, y, x]) -> same shape`` on every block and keep the block's own voxels.

    The kernel gets ``halo`` more voxels on each side, but none beyond the volume. A volume may start at any z. Its slices
    must be of one size and type and dense in z: a gap, a repeated z or a second size within a block's reach raises
    (``layouts.extent`` checks whole volumes). Columns named in ``extra`` are handed to the kernel as a dict of the
    group's first row. ``tile`` cuts slices into tiles of that many lines and columns; the finished tiles then meet once more,
    one group per slice. Without it a group holds ``block + 2 * halo`` whole slices and there is one exchange.
    """
    extra = extra or []
    out_schema = f"volume_id string, z int, name string, h int, w int, dtype string, {PIECE_SCHEMA}" if tile else SLICE_SCHEMA

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * block
        pdf = pdf.sort_values("z")
        core = pdf["z"].between(first, first + block - 1)
        if not core.any():
            return pd.DataFrame(columns=[part.split()[0] for part in out_schema.split(", ")])
        if (pdf["z"].diff().iloc[1:] != 1).any():
            raise ValueError(f"volume {key[0]}: slices are missing or repeated between z = {pdf['z'].min()} and {pdf['z'].max()}")
        if (pdf[["h", "w", "dtype"]].nunique() > 1).any():
            raise ValueError(f"volume {key[0]}: slices of several sizes or types")
        top, left, rows, cols = (int(pdf[name].iat[0]) for name in (PIECE[:-1] if tile else ("_zero", "_zero", "h", "w")))
        volume = np.frombuffer(b"".join(pdf["_piece" if tile else "data"]), np.dtype(pdf["dtype"].iat[0])).reshape(len(pdf), rows, cols)
        args = [{name: pdf[name].iat[0] for name in extra}] if extra else []
        result = np.asarray(kernel(volume, *args))[core.to_numpy()]
        own = pdf.loc[core, SLICE_COLUMNS[:-1]].assign(dtype=str(result.dtype))
        if not tile:
            return own.assign(data=[np.ascontiguousarray(image).tobytes() for image in result])
        y, x = int(key[2]) * tile, int(key[3]) * tile
        result = result[:, y - top : y - top + tile, x - left : x - left + tile]
        packed = [np.ascontiguousarray(image).tobytes() for image in result]
        return own.assign(_top=y, _left=x, _rows=result.shape[1], _cols=result.shape[2], _piece=packed)

    blocks = F.sequence(F.floor((F.col("z") - halo) / block), F.floor((F.col("z") + halo) / block))
    if tile:
        pieces = cut_tiles(slices, tile, halo, extra)
        copies = pieces.select("*", F.explode(blocks).alias("_block"))
        return join_tiles(copies.groupBy("volume_id", "_block", "_ty", "_tx").applyInPandas(run, out_schema))
    copies = slices.select(*SLICE_COLUMNS, *extra, F.lit(0).alias("_zero"), F.explode(blocks).alias("_block"))
    return copies.groupBy("volume_id", "_block").applyInPandas(run, out_schema)


def spread_cross(solid: np.ndarray) -> np.ndarray:
    """One dilation by the 6-neighbour cross; outside counts as empty."""
    out = solid.copy()
    for axis in range(solid.ndim):
        lead = [slice(None)] * solid.ndim
        trail = [slice(None)] * solid.ndim
        lead[axis], trail[axis] = slice(1, None), slice(None, -1)
        out[tuple(lead)] |= solid[tuple(trail)]
        out[tuple(trail)] |= solid[tuple(lead)]
    return out


def shrink_cross(solid: np.ndarray) -> np.ndarray:
    """One erosion by the 6-neighbour cross; outside counts as empty, so the border erodes."""
    out = solid.copy()
    for axis in range(solid.ndim):
        lead = [slice(None)] * solid.ndim
        trail = [slice(None)] * solid.ndim
        lead[axis], trail[axis] = slice(1, None), slice(None, -1)
        out[tuple(lead)] &= solid[tuple(trail)]
        out[tuple(trail)] &= solid[tuple(lead)]
        edge = [slice(None)] * solid.ndim
        for end in (0, -1):
            edge[axis] = end
            out[tuple(edge)] = False
    return out


def ball_offsets(radius: int) -> list[tuple[int, int, int]]:
    reach = range(-radius, radius + 1)
    return [(z, y, x) for z in reach for y in reach for x in reach if z * z + y * y + x * x <= radius * radius]


def _shifted(padded: np.ndarray, offset: tuple[int, ...], radius: int, shape: tuple[int, ...]) -> np.ndarray:
    return padded[tuple(slice(radius + o, radius + o + n) for o, n in zip(offset, shape))]


def spread_ball(solid: np.ndarray, radius: int) -> np.ndarray:
    if radius == 1:
        return spread_cross(solid)
    padded = np.pad(solid, radius)
    return np.logical_or.reduce([_shifted(padded, o, radius, solid.shape) for o in ball_offsets(radius)])


def shrink_ball(solid: np.ndarray, radius: int) -> np.ndarray:
    if radius == 1:
        return shrink_cross(solid)
    padded = np.pad(solid, radius)
    return np.logical_and.reduce([_shifted(padded, o, radius, solid.shape) for o in ball_offsets(radius)])


def _morphology(slices: DataFrame, steps: list[Callable[[np.ndarray], np.ndarray]], reach: int, block: int, tile: int | None) -> DataFrame:
    def kernel(volume: np.ndarray) -> np.ndarray:
        solid = volume != 0
        for step in steps:
            solid = step(solid)
        return solid.astype(np.uint8)

    return map_tiles(slices, kernel, reach * len(steps), block, tile)


def binary_dilate(slices: DataFrame, iterations: int = 1, block: int = BLOCK, tile: int | None = None) -> DataFrame:
    """Grow the non-zero voxels of 0/1 slices by the 6-neighbour cross."""
    return _morphology(slices, [spread_cross] * iterations, 1, block, tile)


def binary_erode(slices: DataFrame, iterations: int = 1, block: int = BLOCK, tile: int | None = None) -> DataFrame:
    """Shrink the non-zero voxels by the 6-neighbour cross; voxels at the volume's border go."""
    return _morphology(slices, [shrink_cross] * iterations, 1, block, tile)


def binary_open(slices: DataFrame, radius: int = 1, block: int = BLOCK, tile: int | None = None) -> DataFrame:
    """Erosion then dilation by a ball, in one exchange with a double halo."""
    return _morphology(slices, [lambda v: shrink_ball(v, radius), lambda v: spread_ball(v, radius)], radius, block, tile)


def binary_close(slices: DataFrame, radius: int = 1, block: int = BLOCK, tile: int | None = None) -> DataFrame:
    """Dilation then erosion by a ball. Dilation does not leave the volume, as outside stays empty."""
    return _morphology(slices, [lambda v: spread_ball(v, radius), lambda v: shrink_ball(v, radius)], radius, block, tile)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Normalised taps out to ``int(truncate * sigma + 0.5)``."""
    radius = int(truncate * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return taps / taps.sum()


def blur_axis(volume: np.ndarray, weights: np.ndarray, axis: int, integer: bool = False) -> np.ndarray:
    """Weighted sum along one axis with mirrored ends; ``integer`` truncates the result to bytes."""
    radius = len(weights) // 2
    pad = [(0, 0)] * volume.ndim
    pad[axis] = (radius, radius)
    source = np.pad(volume.astype(np.float64), pad, mode="symmetric")
    out = np.zeros(volume.shape)
    window = [slice(None)] * volume.ndim
    for i, weight in enumerate(weights):
        window[axis] = slice(i, i + volume.shape[axis])
        out += weight * source[tuple(window)]
    return np.trunc(out).astype(np.uint8) if integer else out


def gaussian_blur_2d(slices: DataFrame, sigma: float = 0.8, integer: bool = False) -> DataFrame:
    """Blur each slice on its own, rows first. ``integer=True`` keeps bytes and truncates after each axis."""
    weights = gaussian_weights(sigma)

    def blur(image: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            image = blur_axis(image, weights, axis, integer)
        return image

    return map_slices(slices, blur, "uint8" if integer else "float64")


def gaussian_blur_3d(slices: DataFrame, sigma: float = 0.7, block: int = BLOCK, tile: int | None = None) -> DataFrame:
    """Blur a volume along z, y and x with mirrored ends; float64 slices."""
    weights = gaussian_weights(sigma)

    def blur(volume: np.ndarray) -> np.ndarray:
        for axis in range(3):
            volume = blur_axis(volume, weights, axis)
        return volume

    return map_tiles(slices, blur, len(weights) // 2, block, tile)


def smooth_solid(solid: np.ndarray, weights: np.ndarray, threshold: float) -> np.ndarray:
    """What stays above the threshold when a solid is blurred. Rounded, so that equal sums compare equal in any order."""
    volume = solid.astype(np.float64)
    for axis in range(3):
        volume = blur_axis(volume, weights, axis)
    return np.round(volume, 9) > threshold


def smooth_rethreshold(slices: DataFrame, sigma: float = 0.7, threshold: float = 0.5, block: int = BLOCK, tile: int | None = None) -> DataFrame:
    """Blur a 0/1 volume and keep what stays above the threshold."""
    weights = gaussian_weights(sigma)
    return map_tiles(slices, lambda volume: smooth_solid(volume != 0, weights, threshold).astype(np.uint8), len(weights) // 2, block, tile)


def clean_solid(
    slices: DataFrame, radius: int = 1, sigma: float = 0.7, threshold: float = 0.5, block: int = BLOCK, tile: int | None = None
) -> DataFrame:
    """Opening, closing and smoothing of a 0/1 volume in one exchange: the halo is the sum of the three reaches."""
    weights = gaussian_weights(sigma)

    def clean(volume: np.ndarray) -> np.ndarray:
        solid = spread_ball(shrink_ball(volume != 0, radius), radius)
        solid = shrink_ball(spread_ball(solid, radius), radius)
        return smooth_solid(solid, weights, threshold).astype(np.uint8)

    return map_tiles(slices, clean, 4 * radius + len(weights) // 2, block, tile)


def forward_gradient(slices: DataFrame, wrap: bool = False) -> DataFrame:
    """Difference to the left neighbour, 0 in the first column. ``wrap=True`` wraps byte differences at 256."""
    def slope(image: np.ndarray) -> np.ndarray:
        out = np.zeros(image.shape, np.int16)
        out[:, 1:] = np.diff(image.astype(np.int16), axis=1)
        return out % 256 if wrap else out

    return map_slices(slices, slope, "int16")


def dilate_pore(slices: DataFrame, radius: int = 1) -> DataFrame:
    """Grow the 0 (pore) pixels of 0/1 slices by a (2r+1) square, along rows then along columns."""
    def grow(image: np.ndarray) -> np.ndarray:
        solid = image != 0
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (radius, radius)
            padded = np.pad(solid, pad, constant_values=True)
            n = solid.shape[axis]
            solid = np.logical_and.reduce([padded.take(range(i, i + n), axis=axis) for i in range(2 * radius + 1)])
        return solid.astype(np.uint8)

    return map_slices(slices, grow)


def pore_share(slices: DataFrame) -> DataFrame:
    """Share of non-zero voxels per volume, counted in the scan's tasks."""
    hist = slices_to_hist(slices)
    return hist.groupBy("volume_id").agg(
        (F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("phi")
    )


def adjust_porosity(
    voids: DataFrame, targets: DataFrame, rounds: int = 1, tolerance: float = 0.002, block: int = BLOCK, tile: int | None = None
) -> DataFrame:
    """Move each volume's void share towards its target: grow once when too small, shrink once when too large.

    ``targets`` is (volume_id, target). Volumes within the tolerance are left alone. Whether a volume grows in the next round
    is known once all its blocks are done, so a round's result is stored with each slice's void count, which the kernel
    leaves behind: the share comes from the counts alone, and each round reads and exchanges the pixels once.
    """

    def kernel(volume: np.ndarray, info: dict) -> np.ndarray:
        solid = volume != 0
        gap = info["gap"]
        if abs(gap) >= tolerance:
            solid = spread_cross(solid) if gap < 0 else shrink_cross(solid)
        return solid.astype(np.uint8)

    def with_counts(slices: DataFrame) -> DataFrame:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in small_batches(batches):
                yield batch.assign(_voids=[int(np.count_nonzero(np.frombuffer(d, np.dtype(t)))) for d, t in zip(batch["data"], batch["dtype"])])

        return slices.select(*SLICE_COLUMNS).mapInPandas(count, SLICE_SCHEMA + ", _voids bigint")

    for i in range(rounds):
        # The first round's input is the caller's: its shares are read before the stencil without storing it.
        counted = with_counts(voids) if i == 0 else cut_lineage(with_counts(voids))
        pixels = F.col("h").cast("long") * F.col("w")
        phi = counted.groupBy("volume_id").agg((F.sum("_voids") / F.sum(pixels)).alias("phi"))
        gaps = phi.join(targets, "volume_id").select("volume_id", (F.col("phi") - F.col("target")).alias("gap"))
        gaps = broadcast_if_small(cut_lineage(gaps), 500_000)
        source = voids if i == 0 else counted
        voids = map_tiles(source.select(*SLICE_COLUMNS).join(gaps, "volume_id"), kernel, 1, block, tile, extra=["gap"])
    return voids
