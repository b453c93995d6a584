"""Numeric helpers as column expressions: MTH-01, MTH-02, MTH-08, MTH-10 to MTH-19, NST-05, NST-06, AGG-27."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes; null if one is null."""
    return F.bit_count(a.bitwiseXOR(b))


def mean_abs_diff(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Mean absolute difference of two arrays; 0 for arrays of other lengths or none."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a) / scale).otherwise(F.lit(0.0))


def frame_diff(hash_a: Column, hash_b: Column, small_a: Column, small_b: Column, alpha: float = 0.5) -> Column:
    """Weighted sum of hash distance and mean absolute pixel difference, both from 0 to 1."""
    return alpha * hamming(hash_a, hash_b) / 64 + (1 - alpha) * mean_abs_diff(small_a, small_b)


def rounded3(x: Column) -> Column:
    """Three decimals, halves to even; 0 for what isn't a number."""
    return F.coalesce(F.bround(x.try_cast("double"), 3), F.lit(0.0))


def number_or(x: Column, default: float) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(float(default)))


def ratio_of(text: Column) -> Column:
    """``30/1`` as 30.0; a plain number as it is; 0 for a zero denominator or no number."""
    parts = F.split(text, "/")
    return F.coalesce(F.try_divide(parts[0].try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.when(F.size(parts) == 1, 1.0))), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def crop_box_to_media(box: Column, crop: Column, media_w: Column, media_h: Column) -> Column:
    """A box relative to a crop (``w:h:x:y`` in pixels) as one relative to the media, clamped; without a
    readable crop only clamped. Boxes are arrays (left, top, right, bottom)."""
    part = lambda k: F.regexp_extract(crop, r"(\d+):(\d+):(\d+):(\d+)", k).try_cast("double")
    w, h, x, y = part(1), part(2), part(3), part(4)
    mapped = F.array((x + box[0] * w) / media_w, (y + box[1] * h) / media_h, (x + box[2] * w) / media_w, (y + box[3] * h) / media_h)
    return F.transform(F.when(w.isNotNull() & (media_w > 0) & (media_h > 0), mapped).otherwise(box), lambda x: clamp(x))


def box_pixels(box: Column, width: Column, height: Column) -> Column:
    """A relative box in whole pixels (x0, y0, x1, y1), one pixel wide and high at least."""
    x0 = F.least(F.greatest(F.floor(box[0] * width), F.lit(0)), width - 1)
    y0 = F.least(F.greatest(F.floor(box[1] * height), F.lit(0)), height - 1)
    x1 = F.least(F.greatest(F.ceil(box[2] * width), x0 + 1), width)
    y1 = F.least(F.greatest(F.ceil(box[3] * height), y0 + 1), height)
    return F.array(*(c.cast("int") for c in (x0, y0, x1, y1)))


def box_area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def corner_boxes(zone: float = 0.3) -> list[tuple[str, tuple[float, float, float, float]]]:
    """The four corner zones as relative boxes."""
    z, r = float(zone), 1.0 - zone
    return [("tl", (0.0, 0.0, z, z)), ("tr", (r, 0.0, 1.0, z)), ("bl", (0.0, r, z, 1.0)), ("br", (r, r, 1.0, 1.0))]


def corner_bounds(height: Column, width: Column, corner: str, zone: float = 0.3) -> Column:
    return box_pixels(F.array(*map(F.lit, dict(corner_boxes(zone))[corner])), width, height)


def fit_scale(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """The size that fits a box at the same aspect, one pixel at least."""
    scale = F.least(box_w / width, box_h / height)
    return F.array(F.greatest(F.bround(width * scale), F.lit(1)).cast("int"), F.greatest(F.bround(height * scale), F.lit(1)).cast("int"))


def grid_cell(x: Column, y: Column, width: int, height: int, cols: int) -> Column:
    """The number of the cell of a point on a grid of square-like cells, ``cols`` across."""
    rows = max(1, round(cols * height / width))
    cx = F.least(F.floor(x * cols / width), F.lit(cols - 1))
    return F.least(F.floor(y * rows / height), F.lit(rows - 1)) * cols + cx


def boxes_key(boxes: Column) -> Column:
    """A short key of a set of boxes that doesn't depend on their order."""
    rounded = F.array_sort(F.transform(boxes, lambda b: F.transform(b, lambda x: F.bround(x, 3))))
    return F.left(F.sha1(F.to_json(rounded)), F.lit(8))


def params_key(params: Column) -> Column:
    """A short key of a map of numbers that doesn't depend on the order of names."""
    return F.left(F.sha1(F.to_json(F.array_sort(F.map_entries(params)))), F.lit(8))


def human_size(size: Column) -> Column:
    k = 1024.0
    return (
        F.when(size < k, F.format_string("%d B", size.cast("long")))
        .when(size < k**2, F.format_string("%.1f KB", size / k))
        .when(size < k**3, F.format_string("%.1f MB", size / k**2))
        .otherwise(F.format_string("%.1f GB", size / k**3))
    )
