"""Tile grids, print cells, zoom and rotation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 512
MIN_LEVEL = -4
#: Zoom limits and the margin left when a page is fitted.
MIN_ZOOM, MAX_ZOOM, FIT_MARGIN = 0.08, 64.0, 0.97


def tile_level(zoom: Column) -> Column:
    return F.when(zoom <= 0, 0).otherwise(F.greatest(F.lit(MIN_LEVEL), F.ceil(F.log2(F.when(zoom > 0, zoom))))).cast("int")


def tile_scale(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def tile_count(size: Column, level: Column, tile: int = TILE) -> Column:
    return F.ceil(size * tile_scale(level) / tile).cast("int")


def rotate(degrees: Column, by: int) -> Column:
    return F.pmod(degrees + by, F.lit(360))


def fit_width(view: Column, page: Column) -> Column:
    return F.greatest(F.lit(MIN_ZOOM), F.least(F.lit(MAX_ZOOM), FIT_MARGIN * view / page))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


def is_landscape(w: Column, h: Column) -> Column:
    return w > h


def cells(w: Column, h: Column, per_sheet: Column) -> Column:
    """Cells (x, y, w, h) of a sheet for 1, 2 or 4 pages; another number raises."""
    def cell(x: Column, y: Column, cw: Column, ch: Column) -> Column:
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), cw.cast("int").alias("w"), ch.cast("int").alias("h"))

    zero, hw, hh = F.lit(0), F.floor(w / 2), F.floor(h / 2)
    two = F.when(w > h, F.array(cell(zero, zero, hw, h), cell(hw, zero, hw, h))).otherwise(F.array(cell(zero, zero, w, hh), cell(zero, hh, w, hh)))
    four = F.array(cell(zero, zero, hw, hh), cell(hw, zero, hw, hh), cell(zero, hh, hw, hh), cell(hw, hh, hw, hh))
    return F.when(per_sheet == 1, F.array(cell(zero, zero, w, h))).when(per_sheet == 2, two).when(per_sheet == 4, four).otherwise(F.raise_error(F.lit("pages per sheet must be 1, 2 or 4")).cast(two_type()))


def two_type() -> str:
    return "array<struct<x:int,y:int,w:int,h:int>>"


def placed(cell: Column, bitmap_w: Column, bitmap_h: Column, points_w: Column, points_h: Column, dpi_x: Column, dpi_y: Column, mode: Column, scale: Column) -> Column:
    """Where a page lies in its cell: fit, actual, shrink (to fit) or custom (percent, 10 to 400); centred."""
    fit = F.least(cell["w"] / bitmap_w, cell["h"] / bitmap_h)
    own_w, own_h = points_w / 72 * dpi_x, points_h / 72 * dpi_y
    share = F.greatest(F.lit(10), F.least(F.lit(400), scale)) / 100
    shrink = F.least(F.lit(1.0), cell["w"] / own_w, cell["h"] / own_h)
    w = F.when(mode == "actual", own_w).when(mode == "custom", own_w * share).when(mode == "shrink", own_w * shrink).otherwise(bitmap_w * fit).cast("int")
    h = F.when(mode == "actual", own_h).when(mode == "custom", own_h * share).when(mode == "shrink", own_h * shrink).otherwise(bitmap_h * fit).cast("int")
    x, y = cell["x"] + ((cell["w"] - w) / 2).cast("int"), cell["y"] + ((cell["h"] - h) / 2).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
