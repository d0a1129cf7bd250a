"""Per-slice image operators: each slice is one row, so none of these shuffles.

The small NumPy kernels work on one image; Spark decides where each image goes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import pixels
from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA, STATUS_SCHEMA, copy_window, extent, image_of, map_slices, small_batches, zip_slices
from voxelloom.session import broadcast_if_small, cut_lineage

# Fixed value: fraction bits of the 8-bit resampling weights common image libraries use.
WEIGHT_BITS = 22


def crop(slices: DataFrame, y0, y1, x0, x1) -> DataFrame:
    """The window [y0, y1) x [x0, x1) of every slice; coordinates start again at 0."""
    y0, y1, x0, x1 = [pixels.col(c) for c in (y0, y1, x0, x1)]
    return copy_window(slices, y0, x0, 0, 0, y1 - y0, x1 - x0, y1 - y0, x1 - x0)


def crop_around(slices: DataFrame, cy: float, cx: float, size: int) -> DataFrame:
    """Square window around a centre; slices smaller than the window fail."""
    fits = (F.col("h") >= size) & (F.col("w") >= size)
    checked = F.when(fits, pixels.crop_start(F.lit(cy), "h", size)).otherwise(
        F.raise_error(F.lit("image is smaller than the crop")).cast("int")
    )
    x0 = pixels.crop_start(F.lit(cx), "w", size)
    return copy_window(slices, checked, x0, 0, 0, size, size, size, size)


def pad_to_multiple(slices: DataFrame, multiple: int = 16) -> DataFrame:
    """Zero padding at the bottom and right up to a multiple of the model's stride."""
    return copy_window(
        slices, 0, 0, 0, 0, F.col("h"), F.col("w"), pixels.pad_to_multiple("h", multiple), pixels.pad_to_multiple("w", multiple)
    )


def _fit_axis(low: Column, high: Column, out: int, padded_branch: Column, compat: bool) -> tuple[Column, Column, Column, int]:
    """(source start, target start, count, size) of one axis of ``fit_to_size``."""
    region = high - low + 1
    length = 2 * (out // 2) if compat else out
    # Small regions: centred on a canvas of at least the target size, then the canvas is cut around its middle.
    canvas = F.greatest(F.lit(out), region)
    offset = F.floor(canvas / 2) - out // 2 - F.floor((canvas - region) / 2)
    pad_src = F.greatest(F.lit(0), offset)
    pad_dst = F.greatest(F.lit(0), -offset)
    pad_n = F.least(region - pad_src, F.lit(length) - pad_dst)
    # Large regions: a window centred on the region that does not leave it.
    start = F.greatest(low, F.floor((low + high) / 2) - out // 2)
    stop = F.least(high + 1, start + out)
    crop_src = F.when(stop - start < out, F.greatest(F.lit(0), stop - out)).otherwise(start)
    return (
        F.when(padded_branch, low + pad_src).otherwise(crop_src),
        F.when(padded_branch, pad_dst).otherwise(F.lit(0)),
        F.when(padded_branch, pad_n).otherwise(F.least(F.lit(out), stop - crop_src)),
        length,
    )


def fit_to_size(
    slices: DataFrame, boxes: DataFrame, out_h: int, out_w: int, compat: bool = False, mask: DataFrame | None = None
) -> DataFrame:
    """Cut every slice to one size around its region's bounding box; slices without a region become 0.

    A region smaller than the target in either direction is centred on zeros, else the window is centred
    on the region. ``compat=True`` gives one line less for odd padded targets. With a packed ``mask`` the pixels
    outside of the region are cleared first; without it the whole box stays.
    """
    slices = slices if mask is None else apply_mask(slices, mask)
    small = (F.col("max_row") - F.col("min_row") + 1 < out_h) | (F.col("max_col") - F.col("min_col") + 1 < out_w)
    small = F.coalesce(small, F.lit(True))
    sy, dy, ny, len_y = _fit_axis(F.col("min_row"), F.col("max_row"), out_h, small, compat)
    sx, dx, nx, len_x = _fit_axis(F.col("min_col"), F.col("max_col"), out_w, small, compat)
    filled = F.col("min_row").isNotNull()
    joined = slices.join(boxes.select("volume_id", "z", "min_row", "max_row", "min_col", "max_col"), ["volume_id", "z"], "left")
    zero = [F.coalesce(F.when(filled, c), F.lit(0)) for c in (sy, sx, dy, dx, ny, nx)]
    height = F.when(filled & small, len_y).otherwise(out_h)
    width = F.when(filled & small, len_x).otherwise(out_w)
    return copy_window(joined, *zero, height, width)


def flip(slices: DataFrame, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    """Mirror every slice."""
    return map_slices(slices, lambda image: image[:: -1 if vertical else 1, :: -1 if horizontal else 1])


def flip_pair(images: DataFrame, masks: DataFrame, horizontal: float = 0.5, vertical: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Mirror image and mask of a slice alike, each axis with its own chance; the coin is md5 of volume, z, axis and seed."""
    def coin(axis: str, chance: float) -> Column:
        digest = F.md5(F.concat_ws("|", "volume_id", F.col("z").cast("string"), F.lit(axis), F.lit(str(seed))))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13) < F.lit(float(chance))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            packed = [
                np.ascontiguousarray(image_of(row)[:: -1 if row.flip_y else 1, :: -1 if row.flip_x else 1]).tobytes() for row in batch.itertuples(index=False)
            ]
            yield batch[SLICE_COLUMNS].assign(data=packed)

    coins = (coin("x", horizontal).alias("flip_x"), coin("y", vertical).alias("flip_y"))
    left, right = (side.select(*SLICE_COLUMNS, *coins).mapInPandas(turn, SLICE_SCHEMA) for side in (images, masks))
    return left, right


def normalize_slices(slices: DataFrame, scope: str = "slice") -> DataFrame:
    """16-bit and fractional slices as bytes: stretched from smallest to largest pixel to 0..255, truncated.

    ``scope`` takes the ends from each slice (no shuffle) or from the whole ``volume``. 8-bit slices stay as they are in the
    first case. Constant ones become 0, and so do pixels that are no number; they count for neither end.
    """
    def ends(image: np.ndarray) -> tuple[float, float]:
        known = image[np.isfinite(image)]
        return (float(known.min()), float(known.max())) if known.size else (0.0, 0.0)

    def stretch(image: np.ndarray, low: float, high: float) -> np.ndarray:
        if not high > low:
            return np.zeros(image.shape, np.uint8)
        return np.nan_to_num((image.astype(np.float64) - low) / (high - low) * 255, nan=0, posinf=0, neginf=0).astype(np.uint8)

    if scope == "slice":
        return map_slices(slices, lambda image: image if image.dtype == np.uint8 else stretch(image, *ends(image)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            found = [ends(image_of(row)) for row in batch.itertuples(index=False)]
            yield pd.DataFrame({"volume_id": batch["volume_id"], "low": [a for a, _ in found], "high": [b for _, b in found]})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            packed = [stretch(image_of(row), row.low, row.high).tobytes() for row in batch.itertuples(index=False)]
            yield batch[SLICE_COLUMNS].assign(dtype="uint8", data=packed)

    per_slice = slices.select(*SLICE_COLUMNS).mapInPandas(measure, "volume_id string, low double, high double")
    span = per_slice.groupBy("volume_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return slices.select(*SLICE_COLUMNS).join(broadcast_if_small(cut_lineage(span), 500_000), "volume_id").mapInPandas(apply, SLICE_SCHEMA)


def apply_mask(slices: DataFrame, mask: DataFrame, above: int = 0) -> DataFrame:
    """Clear the pixels where the mask is not above a value."""
    return zip_slices(slices, mask, lambda image, inside: image * (inside > above))


def highlight(slices: DataFrame, mask: DataFrame) -> DataFrame:
    """Masked pixels white, the rest dimmed to 0..200."""
    return zip_slices(slices, mask, lambda image, inside: np.where(inside > 0, 255, (image * (200 / 255)).astype(np.uint8)))


def flip_voxels(voxels: DataFrame, axis: str, size, when: Column | None = None) -> DataFrame:
    """Mirror a coordinate, for all rows or where ``when`` holds (same coin for image and mask)."""
    mirrored = pixels.flip_position(axis, size)
    return voxels.withColumn(axis, mirrored if when is None else F.when(when, mirrored).otherwise(F.col(axis)))


@lru_cache(maxsize=64)
def bilinear_weights(n_in: int, n_out: int) -> np.ndarray:
    """Whole-number weights [n_in, n_out] of a triangle filter that widens when it shrinks the image."""
    scale = n_in / n_out
    support = max(scale, 1.0)
    centres = (np.arange(n_out) + 0.5) * scale
    first = np.maximum((centres - support + 0.5).astype(int), 0)
    last = np.minimum((centres + support + 0.5).astype(int), n_in)
    source = np.arange(n_in)[:, None]
    tent = np.maximum(0.0, 1.0 - np.abs(source + 0.5 - centres) / support)
    tent[(source < first) | (source >= last)] = 0.0
    return np.floor(tent / tent.sum(axis=0) * (1 << WEIGHT_BITS) + 0.5)


def resample_bilinear(slices: DataFrame, out_w: int = 1000, out_h: int = 300) -> DataFrame:
    """Resize 8-bit slices: along x, then along y, rounding to bytes after each."""

    def pass_(product: np.ndarray) -> np.ndarray:
        # Sums of bytes times weights stay far below 2**53, so the float products are exact.
        return np.clip(np.floor((product + (1 << (WEIGHT_BITS - 1))) / (1 << WEIGHT_BITS)), 0, 255)

    def resize(image: np.ndarray) -> np.ndarray:
        wide = pass_(image.astype(np.float64) @ bilinear_weights(image.shape[1], out_w))
        return pass_(bilinear_weights(image.shape[0], out_h).T @ wide).astype(np.uint8)

    return map_slices(slices, resize)


def resample_nearest(slices: DataFrame, out_h: int, out_w: int) -> DataFrame:
    """Resize by taking the pixel under each target pixel's centre."""

    def resize(image: np.ndarray) -> np.ndarray:
        rows = ((np.arange(out_h) + 0.5) * image.shape[0] / out_h).astype(int)
        cols = ((np.arange(out_w) + 0.5) * image.shape[1] / out_w).astype(int)
        return image[np.ix_(rows, cols)]

    return map_slices(slices, resize)


def label_components(mask: np.ndarray) -> np.ndarray:
    """Label the True cells of a 2D or 3D mask by body, joined through cell sides: 0 outside, else 1 + smallest flat index.

    Runs along the last axis are the nodes and touching runs of neighbouring lines the edges; every round hooks the
    larger root of each edge under the smaller one and flattens the trees.
    """
    begins = mask.copy()
    begins[..., 1:] &= ~mask[..., :-1]
    run = np.cumsum(begins).reshape(mask.shape) - 1
    first = np.flatnonzero(begins) + 1
    edges = []
    for axis in range(mask.ndim - 1):
        ahead, behind = np.swapaxes(mask, 0, axis)[1:], np.swapaxes(mask, 0, axis)[:-1]
        touching = ahead & behind
        edges.append((np.swapaxes(run, 0, axis)[:-1][touching], np.swapaxes(run, 0, axis)[1:][touching]))
    upper, lower = (np.concatenate(side) for side in zip(*edges))
    fresh = np.ones(len(upper), bool)
    fresh[1:] = (upper[1:] != upper[:-1]) | (lower[1:] != lower[:-1])
    upper, lower = upper[fresh], lower[fresh]
    root = np.arange(len(first))
    while True:
        a, b = root[upper], root[lower]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            flat = root[root]
            if np.array_equal(flat, root):
                break
            root = flat
    labels = np.zeros(mask.shape, np.int64)
    labels[mask] = first[root][run[mask]]
    return labels


def component_sizes(slices: DataFrame) -> DataFrame:
    """(volume, z, label, size) of the non-zero 4-connected components of every slice."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            for row in batch.itertuples(index=False):
                labels, sizes = np.unique(label_components(image_of(row) != 0), return_counts=True)
                keep = labels > 0
                yield pd.DataFrame({"volume_id": row.volume_id, "z": row.z, "label": labels[keep], "size": sizes[keep]})

    return slices.select(*SLICE_COLUMNS).mapInPandas(measure, "volume_id string, z int, label bigint, size bigint")


def drop_small(mask: np.ndarray, min_size: int) -> np.ndarray:
    labels = label_components(mask)
    sizes = np.bincount(labels.ravel())
    return mask & (sizes[labels] >= min_size)


def remove_small_objects(slices: DataFrame, min_size: int = 10) -> DataFrame:
    """Clear components below ``min_size`` pixels."""
    return map_slices(slices, lambda image: drop_small(image != 0, min_size))


def remove_small_holes(slices: DataFrame, area: int = 10) -> DataFrame:
    """Fill background components below ``area`` pixels."""
    return map_slices(slices, lambda image: ~drop_small(image == 0, area))


SHIFTS = 24  # distances up to which rows are compared shift by shift


def lower_envelope(heights: np.ndarray) -> np.ndarray:
    """``min over j of (i - j)**2 + heights[:, j]`` for every i: all rows at once, linear in their length.

    One pass keeps, per row, the parabolas that are lowest somewhere and where each begins; a second pass back reads them.
    """
    rows, n = heights.shape
    if not rows or not n:
        return heights.copy()
    each = np.arange(rows)
    owner, begin = np.zeros((rows, n), np.int32), np.zeros((rows, n), np.int64)
    top = np.zeros(rows, np.int64)
    for q in range(1, n):
        new = heights[:, q]
        live = each
        while len(live):  # drop parabolas that are above the new one where they begin
            at, start = owner[live, top[live]], begin[live, top[live]]
            worse = (start - at) ** 2 + heights[live, at] > (start - q) ** 2 + new[live]
            live = live[worse]
            top[live] -= 1
            live = live[top[live] >= 0]
        empty = top < 0
        at = owner[each, np.maximum(top, 0)].astype(np.int64)
        meet = (q * q - at * at + new - heights[each, at]) // (2 * (q - at)) + 1
        fresh = empty | (meet < n)
        top[fresh] += 1
        who = each[fresh]
        owner[who, top[who]] = q
        begin[who, top[who]] = np.where(empty, 0, meet)[who]
    out = np.empty_like(heights)
    for q in range(n - 1, -1, -1):
        at = owner[each, top]
        out[:, q] = (q - at) ** 2 + heights[each, at]
        top -= (begin[each, top] == q) & (top > 0)
    return out


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Exact squared distance of each True pixel to the nearest False one; very large when there is none.

    Column distances first. Then each row takes the best ``d*d + column**2``: over horizontal shifts d while few are
    needed, by a lower envelope in the rows that need more, so the time is linear in the pixels.
    """
    h, w = mask.shape
    far = h + w
    steps = np.arange(h)[:, None]
    above = steps - np.maximum.accumulate(np.where(mask, -far, steps), axis=0)
    below = np.minimum.accumulate(np.where(mask, h + far, steps)[::-1], axis=0)[::-1] - steps
    column = np.minimum(np.minimum(above, below), far).astype(np.int64) ** 2
    best = column.copy()
    for d in range(1, min(w, SHIFTS + 1)):
        if d * d >= best.max():
            return best
        best[:, d:] = np.minimum(best[:, d:], column[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], column[:, d:] + d * d)
    open_ = best.max(axis=1, initial=0) > SHIFTS * SHIFTS
    best[open_] = lower_envelope(column[open_])
    return best


def _has_background(mask: np.ndarray) -> np.ndarray:
    if mask.size and mask.all():
        raise ValueError("no background pixel")
    return mask


def edt(slices: DataFrame) -> DataFrame:
    """Euclidean distance of non-zero pixels to the nearest zero pixel, float64 slices with ``error``.

    A slice without a zero pixel has no distances: its data is null and its status says so.
    """
    return map_slices(slices, lambda image: np.sqrt(squared_distance(_has_background(image != 0))), "float64", status=True)


UNREACHED = 1 << 40


def edt_3d(slices: DataFrame, group_bytes: int = 16 << 20) -> DataFrame:
    """Euclidean distance of non-zero voxels to the nearest zero voxel of the whole volume, float64 slices with ``error``.

    Squared distances inside the slices first, in the scan's tasks. Then runs of neighbouring pixels of all slices meet in
    one group, as many as ``group_bytes`` allow for the volume's depth, and take the lower envelope along z; the finished
    runs go back to their slices. Slices must be dense in z and of one size. Volumes without a zero voxel get a status.
    """
    def flat(image: np.ndarray) -> np.ndarray:
        mask = image != 0
        return np.full(mask.shape, UNREACHED) if mask.size and mask.all() else squared_distance(mask)

    squares = map_slices(slices, flat, "int64")
    sizes = extent(slices).select("volume_id", "n_slices")
    run = F.greatest(F.lit(1), F.floor(F.lit(group_bytes) / (F.col("n_slices") * 8))).cast("int")
    count = F.ceil(F.col("h") * F.col("w") / F.col("_run")).cast("int")
    piece = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("part"), F.col("data").substr(i * F.col("_run") * 8 + 1, F.col("_run") * 8).alias("piece")))
    sized = squares.join(broadcast_if_small(sizes, 500_000), "volume_id").withColumn("_run", run)
    pieces = sized.select(*SLICE_COLUMNS[:-1], F.explode(piece).alias("p")).select(*SLICE_COLUMNS[:-1], "p.part", "p.piece")

    def along(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        heights = np.frombuffer(b"".join(pdf["piece"]), np.int64).reshape(len(pdf), -1)
        found = lower_envelope(np.ascontiguousarray(heights.T)).T
        return pdf.assign(piece=[np.ascontiguousarray(line).tobytes() for line in found])

    def paste(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            squared = [np.frombuffer(b"".join(p["piece"] for p in sorted(parts, key=lambda p: p["part"])), np.int64) for parts in batch["parts"]]
            lost = [bool(len(s)) and s.max() >= UNREACHED for s in squared]
            yield batch[SLICE_COLUMNS[:-1]].assign(
                dtype="float64", data=[None if gone else np.sqrt(s).tobytes() for s, gone in zip(squared, lost)],
                error=["no background voxel" if gone else None for gone in lost],
            )

    done = pieces.groupBy("volume_id", "part").applyInPandas(along, pieces.schema)
    whole = done.groupBy(*SLICE_COLUMNS[:-1]).agg(F.collect_list(F.struct("part", "piece")).alias("parts"))
    return whole.mapInPandas(paste, STATUS_SCHEMA)


def thickness(mask: np.ndarray) -> np.ndarray:
    """Diameter of the largest inscribed circle that covers each True pixel.

    A centre's circle has its distance to the nearest False pixel as radius and covers what lies strictly
    nearer. Centres whose circle lies inside a neighbour's are left out. The rest are taken radius by radius, from
    small to large: all circles of one radius mark where their rows begin and end, and a running sum fills them.
    """
    squared = np.where(mask, squared_distance(_has_background(mask)), 0)
    radius = np.sqrt(squared)
    padded = np.pad(radius, 1)
    h, w = mask.shape
    inner = np.zeros(mask.shape, bool)
    for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)):
        neighbour = padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        inner |= neighbour >= radius + np.hypot(dy, dx) - 1e-9
    y, x = np.nonzero(mask & ~inner)
    sizes = squared[y, x]
    order = np.argsort(sizes, kind="stable")
    y, x, sizes = y[order], x[order], sizes[order]
    result = np.zeros(mask.shape)
    cuts = np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1])) if len(sizes) else []
    for first, stop in zip(cuts, [*cuts[1:], len(sizes)]):
        size = int(sizes[first])
        reach = math.isqrt(size - 1)
        rise = np.arange(-reach, reach + 1)
        half = np.array([math.isqrt(size - 1 - d * d) for d in rise.tolist()])
        rows = y[first:stop, None] + rise
        low, high = np.maximum(x[first:stop, None] - half, 0), np.minimum(x[first:stop, None] + half + 1, w)
        top, bottom = max(0, int(rows.min())), min(h, int(rows.max()) + 1)
        inside = (rows >= top) & (rows < bottom)
        line = (rows[inside] - top) * (w + 1)
        cells = (bottom - top) * (w + 1)
        edges = np.bincount(line + low[inside], minlength=cells) - np.bincount(line + high[inside], minlength=cells)
        covered = np.cumsum(edges.reshape(-1, w + 1), axis=1)[:, :w] > 0
        result[top:bottom][covered] = 2 * np.sqrt(size)
    return result


def local_thickness(slices: DataFrame) -> DataFrame:
    """Pore diameter map of every 0/1 slice, float64 slices with ``error``: slices without background have no data."""
    return map_slices(slices, lambda image: thickness(image != 0), "float64", status=True)


def diameters(slices: DataFrame) -> DataFrame:
    """Twice the distance map: the cheaper size map where no circles are wanted; same layout as ``local_thickness``."""
    return map_slices(slices, lambda image: 2 * np.sqrt(squared_distance(_has_background(image != 0))), "float64", status=True)


def float_slices_to_voxels(slices: DataFrame) -> DataFrame:
    """Non-byte slices (distance maps, blurred images) to one row per pixel."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            for row in batch[batch["data"].notna()].itertuples(index=False):
                image = image_of(row)
                y, x = np.indices(image.shape, dtype=np.int32)
                yield pd.DataFrame(
                    {"volume_id": row.volume_id, "z": np.int32(row.z), "y": y.ravel(), "x": x.ravel(), "v": image.ravel().astype(float)}
                )

    return slices.select(*SLICE_COLUMNS).mapInPandas(unpack, "volume_id string, z int, y int, x int, v double")


def float_hist(slices: DataFrame) -> DataFrame:
    """(volume, z, v, n) of non-byte slices: distinct values are counted inside the task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches):
            for row in batch[batch["data"].notna()].itertuples(index=False):
                values, counts = np.unique(image_of(row), return_counts=True)
                yield pd.DataFrame({"volume_id": row.volume_id, "z": np.int32(row.z), "v": values.astype(float), "n": counts})

    return slices.select(*SLICE_COLUMNS).mapInPandas(count, "volume_id string, z int, v double, n bigint")


def score_slices(
    slices: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, threshold: float = 0.5,
    multiple: int = 16,
) -> DataFrame:
    """Batch inference: ``load()`` runs once per task and returns ``predict(image 0..1) -> p1``.

    Images are zero-padded at the bottom and right to the model's stride and cut back afterwards; the
    mask (p1 strictly above the threshold) keeps the name of its image. Rows that fail are returned with
    an error text and no data. The default model is the brightness itself.
    """
    schema = SLICE_SCHEMA + ", error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load() if load else (lambda image: image)
        for batch in small_batches(batches):
            packed, errors = [], []
            for row in batch.itertuples(index=False):
                try:
                    image = image_of(row) / 255.0
                    h, w = image.shape
                    padded = np.pad(image, ((0, -h % multiple), (0, -w % multiple)))
                    packed.append((predict(padded)[:h, :w] > threshold).astype(np.uint8).tobytes())
                    errors.append(None)
                except Exception as problem:  # a bad image must not end the job
                    packed.append(None)
                    errors.append(str(problem))
            yield batch.assign(dtype="uint8", data=packed, error=errors)

    return slices.select(*SLICE_COLUMNS).mapInPandas(run, schema)


def drop_failed(scored: DataFrame) -> DataFrame:
    """Rows whose kernel succeeded."""
    return scored.where("error IS NULL").drop("error")
