"""Per-pixel and per-slice scalar maps (arguments and results are Columns)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ITU-R 601 luma weights in 16-bit fixed point with rounding, as common image libraries use them.
LUMA_RED, LUMA_GREEN, LUMA_BLUE, LUMA_HALF, LUMA_SHIFT = 19595, 38470, 7471, 32768, 16


def col(value) -> Column:
    """A column from a name, a Column or a plain number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def normalize_u8(v, v_min, v_max) -> Column:
    """Stretch to 0..255 and truncate; a constant slice becomes 0."""
    v, low, high = col(v), col(v_min), col(v_max)
    return F.when(high > low, ((v - low) / (high - low) * 255).cast("int")).otherwise(0)


def normalize_max(v, v_max) -> Column:
    """Divide by the maximum; null where the maximum is 0 (an all-black image has no scale)."""
    return col(v) / F.nullif(col(v_max), F.lit(0))


def to_unit(v) -> Column:
    """0..255 to 0..1."""
    return col(v) / F.lit(255.0)


def rgb_to_gray(r, g, b, mode: str = "luma") -> Column:
    """``luma`` (integer weighted), ``mean`` of the channels, or ``first`` channel."""
    r, g, b = col(r), col(g), col(b)
    if mode == "luma":
        total = r * LUMA_RED + g * LUMA_GREEN + b * LUMA_BLUE + LUMA_HALF
        return F.shiftright(total.cast("int"), LUMA_SHIFT)
    if mode == "mean":
        return (r + g + b) / F.lit(3.0)
    if mode == "first":
        return r
    raise ValueError(f"unknown gray mode {mode!r}")


def mask_binarize(v) -> Column:
    return (col(v) > 0).cast("int")


def binary_to_display(v, inverted: bool = False) -> Column:
    """0/1 to 0/255, optionally inverted."""
    return (F.lit(1) - col(v)) * 255 if inverted else col(v) * 255


def highlight_overlay(v, mask, scaled: bool = True) -> Column:
    """Masked pixels white; the rest dimmed to 0..200 (``scaled=False`` for a boolean stack)."""
    rest = (col(v).cast("double") * F.lit(200 / 255)).cast("int") if scaled else col(v)
    return F.when(col(mask), 255).otherwise(rest)


def flip_position(position, size) -> Column:
    """Mirror a coordinate inside its axis."""
    return col(size) - 1 - col(position)


def coin(name, seed: int, salt: str) -> Column:
    """A repeatable number in [0, 1) per slice name; stands in for a random draw."""
    digest = F.substring(F.md5(F.concat_ws("|", col(name), F.lit(str(seed)), F.lit(salt))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**32))


def gamma(v, exponent) -> Column:
    """Gamma curve on 0..255 input, result in 0..1."""
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), to_unit(v))), col(exponent))


def random_gamma(v, name, seed: int, low: float = 0.95, high: float = 1.05, p: float = 0.0) -> Column:
    """Gamma with a per-slice exponent in [low, high], applied with probability ``p``; result in 0..1."""
    if p <= 0:
        return to_unit(v)
    exponent = F.lit(low) + coin(name, seed, "gamma") * (high - low)
    return F.when(coin(name, seed, "apply") < p, gamma(v, exponent)).otherwise(to_unit(v))


def softmax_p1(logit0, logit1) -> Column:
    """Foreground probability of two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(col(logit0) - col(logit1)))


def predict_threshold(p1, threshold: float = 0.5) -> Column:
    """1 where the foreground probability is strictly above the threshold."""
    return (col(p1) > F.lit(float(threshold))).cast("int")


def crop_start(center, size, crop: int) -> Column:
    """First pixel of a ``crop``-wide window around a centre, rounded half-even and kept inside the axis."""
    wanted = F.bround(col(center).cast("double"), 0).cast("int") - crop // 2
    return F.greatest(F.lit(0), F.least(wanted, (col(size) - crop).cast("int")))


def pad_to_multiple(size, multiple: int = 16) -> Column:
    """The next multiple at or above ``size``."""
    return (F.floor((col(size) + (multiple - 1)) / multiple) * multiple).cast("int")


def axis_index(axis: str) -> int:
    """x, y, z to 0, 1, 2; anything else means the last axis."""
    return {"x": 0, "y": 1, "z": 2}.get(axis.lower(), 2)


def nm_to_vox(nm, voxel_size) -> Column:
    """Length in whole voxels, rounded half-even, at least 1."""
    return F.greatest(F.lit(1), F.bround(col(nm).cast("double") / col(voxel_size).cast("double"), 0).cast("int"))


def lognormal_params(mean, std) -> tuple[Column, Column]:
    """(mu, sigma) of the log-normal distribution with this mean and standard deviation."""
    m, s = col(mean).cast("double"), col(std).cast("double")
    sigma = F.sqrt(F.ln(F.lit(1.0) + s * s / (m * m)))
    return F.ln(m) - sigma * sigma / 2, sigma


def lognormal_pdf(x, mu, sigma) -> Column:
    x, mu, sigma = col(x), col(mu), col(sigma)
    distance = (F.ln(x) - mu) / sigma
    return F.exp(-(distance * distance) / 2) / (x * sigma * math.sqrt(2 * math.pi))


def cosine_lr(base_lr, epoch, total_epochs) -> Column:
    """Learning rate recorded after ``epoch`` steps of cosine annealing to 0."""
    return col(base_lr) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * col(epoch) / col(total_epochs)))


def linspace(start, stop, n: int, integer: bool = False) -> Column:
    """Array of ``n`` evenly spaced positions, both ends included; ``integer`` truncates."""
    a, b = col(start).cast("double"), col(stop).cast("double")
    if n == 1:
        points = F.array(a)
    else:
        step = (b - a) / F.lit(float(n - 1))
        points = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, b).otherwise(a + i.cast("double") * step)
        )
    return F.transform(points, lambda p: p.cast("int")) if integer else points


def mesh_positions(low, high, n: int, margin: float = 1e-6) -> Column:
    """Section planes of a mesh: evenly spaced, inset by a margin."""
    return linspace(col(low) + F.lit(margin), col(high) - F.lit(margin), n)


def experiment_name(loss, lr, seed) -> Column:
    """``loss-<loss>_lr-<lr>_seed-<seed>`` with the learning rate in shortest ``%g`` form."""
    return F.concat(F.lit("loss-"), col(loss), F.lit("_lr-"), format_g(lr), F.lit("_seed-"), col(seed).cast("string"))


def format_g(value) -> Column:
    """Six significant digits without trailing zeros, scientific below 1e-4 and from 1e6."""
    v = col(value).cast("double")
    scientific = F.format_string("%.5e", v)
    mantissa = F.regexp_replace(F.regexp_extract(scientific, r"^([^e]+)e", 1), r"\.?0+$", "")
    power = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).cast("int")
    plain = F.call_function("format_number", scientific.cast("double"), F.lit("0.##########"))
    return (
        F.when(v == 0, "0")
        .when((power < -4) | (power >= 6), F.concat(mantissa, F.regexp_extract(scientific, r"(e[+-]\d+)$", 1)))
        .otherwise(plain)
    )


def stem_label(path) -> Column:
    """File name up to its first dot, first letter upper and the rest lower case."""
    stem = F.element_at(F.split(F.element_at(F.split(col(path), "/"), -1), r"\."), 1)
    return F.concat(F.upper(F.substring(stem, 1, 1)), F.lower(stem.substr(F.lit(2), F.length(stem))))


def slice_file_name(prefix, z) -> Column:
    """``<prefix>_0007.png``."""
    return F.format_string("%s_%04d.png", col(prefix), col(z).cast("int"))


def crop_file_name(z, y0, x0) -> Column:
    """``real_z0007_y0120_x0040.png``."""
    return F.format_string("real_z%04d_y%04d_x%04d.png", *[col(c).cast("int") for c in (z, y0, x0)])


def tri_threshold(smoothed, gradient, low: float = 40, high: float = 170, steep: float = 15.0) -> Column:
    """Solid above ``high``, pore below ``low``; in between solid where the forward gradient is steep."""
    s = col(smoothed)
    return F.when(s > high, True).when(s < low, False).otherwise(col(gradient) > F.lit(float(steep)))
