"""Sizes and geometry of image crops: what can be known without decoding pixels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

SIZE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType())])
#: Frame headers (baseline, extended, progressive) and markers that stand alone. Fixed values of the JPEG standard.
FRAMES, ALONE = (0xC0, 0xC1, 0xC2), (0x01, *range(0xD0, 0xD8))


def _size(data: bytes | None) -> tuple[int, int] | None:
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # fill bytes may stand before a marker
            at += 1
        elif marker in ALONE:
            at += 2
        elif marker in FRAMES:
            return (int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")) if at + 9 <= len(data) else None
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


@F.pandas_udf(SIZE)
def jpeg_size(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """(width, height) from the header of JPEG bytes; nulls where there is none."""
    for series in images:
        yield pd.DataFrame([_size(x) or (None, None) for x in series], columns=["width", "height"], dtype="Int32")


def scaled_width(width: Column, height: Column, to: int = 32, most: int = 320) -> Column:
    """Width of a crop scaled to a height, from 1 to `most`; half of `most` where the size isn't known."""
    scaled = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(width * to / height).cast("int")))
    return F.when(width.isNotNull() & (height > 0), scaled).otherwise(most // 2)


def region(frame: Column, frames: Column, regions: int) -> Column:
    """Which of equal regions of a row of frames a frame (from 0) falls in, by whole-number bounds."""
    return F.floor(((frame + 1) * regions - 1) / frames).cast("int")


def region_bounds(frames: Column, regions: int) -> Column:
    """(first, end) frames of each region; a region has at least one frame."""
    first = lambda u: F.floor(u * frames / regions).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda u: F.struct(first(u).alias("first"), F.greatest(first(u + 1), first(u) + 1).alias("end")))


def budget(small: tuple[float, float], large: tuple[float, float], memory: float, reserve: float = 0.05) -> int:
    """Pixels that fit in memory, from two measurements (pixels, memory) of a straight line, less a reserve."""
    slope = (large[1] - small[1]) / (large[0] - small[0])
    if slope <= 0:
        raise ValueError("memory doesn't grow with pixels")
    return max(0, int((memory * (1 - reserve) - (small[1] - slope * small[0])) / slope))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Brightness of a colour by the weights of the television standard."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def grey_levels(r: Column, g: Column, b: Column) -> Column:
    """Brightness of each pixel of three arrays of channel values."""
    return F.zip_with(F.zip_with(r, g, lambda x, y: 0.299 * x + 0.587 * y), b, lambda s, z: s + 0.114 * z)


def ink_pixels(greys: Column, width: Column, least: float = 30.0) -> Column:
    """Pixels of a row-major picture that differ by more than `least` from the paper: the mean of the middle two of its four corners. 0 without pixels."""
    corners = F.array_sort(F.array(*(F.get(greys, i) for i in (F.lit(0), width - 1, F.size(greys) - width, F.size(greys) - 1))))
    paper = (F.get(corners, F.lit(1)) + F.get(corners, F.lit(2))) / 2
    return F.when(F.size(greys) > 0, F.size(F.filter(greys, lambda x: F.abs(x - paper) > least))).otherwise(0)


def readable(ink: list[Column], paper: list[Column], least: float = 60.0) -> Column:
    """Ink and paper differ enough in brightness."""
    return F.abs(luminance(*ink) - luminance(*paper)) > least


def first_readable(draws: Column, least: float = 60.0, tries: int = 5) -> Column:
    """The first of some draws (ink r, g, b; paper r, g, b) that is readable, else the last one tried."""
    some = F.slice(draws, 1, tries)
    good = F.filter(some, lambda d: readable([d["ir"], d["ig"], d["ib"]], [d["pr"], d["pg"], d["pb"]], least))
    return F.coalesce(F.get(good, 0), F.element_at(some, -1))


def linear(v: Column) -> Column:
    """Light of a channel value from 0 to 1, by the sRGB curve."""
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def lightness_and_a(r: Column, g: Column, b: Column) -> Column:
    """(l, a) bytes of a pixel: lightness, and the green to red axis, of CIE L*a*b*, cut to whole numbers. Weights and white point are those of the standards."""
    x, y, z = (linear(c.cast("double") / 255) for c in (r, g, b))
    cx = (0.4124564 * x + 0.3575761 * y + 0.1804375 * z) / 0.95047
    cy = 0.2126729 * x + 0.7151522 * y + 0.0721750 * z
    root = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    byte = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v))).cast("int")
    return F.struct(byte((116 * root(cy) - 16) / 100 * 255).alias("l"), byte((500 * (root(cx) - root(cy)) + 128) / 255 * 255).alias("a"))


def input_width(width: Column, height: Column, to: int = 32, multiple: int = 4) -> Column:
    """Width of a crop scaled to a height, at least `multiple`, raised to a multiple of it."""
    scaled = F.greatest(F.lit(multiple), F.floor(width * to / height).cast("int"))
    return (F.floor((scaled + multiple - 1) / multiple) * multiple).cast("int")
