"""Tile ranges of views, their geometry, and tiles keyed so that levels meet by shifts of one number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import layoutmath as M

#: The greatest number of pixels a side may count, tiles around a view that are asked for, too.
MOST_PIXELS, MARGIN = 2**31 - 1, 1
#: Masks that spread a number's bits to every second place, in halving steps of 16 to 1.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def grid(width: Column, height: Column, level: Column) -> Column:
    """Struct columns, rows: tiles of a page of that size at a level, at least one of either."""
    scale = M.tile_scale(level)

    def count(size: Column) -> Column:
        pixels = F.least(F.lit(MOST_PIXELS).cast("long"), F.ceil(size * scale).cast("long"))
        return F.greatest(F.lit(1), F.floor((pixels + M.TILE - 1) / M.TILE)).cast("int")

    return F.struct(count(width).alias("columns"), count(height).alias("rows"))


def rect(col: Column, row: Column, level: Column, width: Column, height: Column) -> Column:
    """Struct x, y, w, h that a tile covers on the page; tiles at the border end with the page."""
    side = M.TILE / M.tile_scale(level)
    left, top = col * side, row * side
    right, bottom = F.least((col + 1) * side, width), F.least((row + 1) * side, height)
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(0.0), right - left).alias("w"), F.greatest(F.lit(0.0), bottom - top).alias("h"))


def matrix(col: Column, row: Column, level: Column, ppi_scale: Column) -> Column:
    """Struct scale, dx, dy: a page's point (x, y) lies at (x * scale + dx, y * scale + dy) of the tile."""
    scale = (ppi_scale * M.tile_scale(level)).cast("float")
    return F.struct(scale.alias("scale"), (-col * M.TILE).cast("float").alias("dx"), (-row * M.TILE).cast("float").alias("dy"))


def morton(col: Column, row: Column) -> Column:
    """The bits of column and row by turns: a tile's key. The key of the tile over it, a level up, is the key shifted right by two."""

    def spread(n: Column) -> Column:
        n = n.cast("long")
        for by, mask in SPREAD:
            n = n.bitwiseOR(F.shiftleft(n, by)).bitwiseAND(F.lit(mask).cast("long"))
        return n

    return spread(col).bitwiseOR(F.shiftleft(spread(row), 1))


def above(key: Column, levels: Column) -> Column:
    """The key of the tile ``levels`` levels up that holds a tile."""
    return F.call_function("shiftright", key, (levels * 2).cast("int"))


def in_view(views: DataFrame, margin: int = MARGIN) -> DataFrame:
    """``views`` (left, top, right, bottom of what is seen, page_w, page_h, level) with a row for each tile wanted: col, row, key.

    ``margin`` tiles around the view come along, the page's grid is never left. Tiles are made from ranges of
    numbers: nothing is joined.
    """
    size, dims = M.TILE / M.tile_scale(F.col("level")), grid(F.col("page_w"), F.col("page_h"), F.col("level"))
    first = lambda c: F.greatest(F.lit(0), (F.col(c) / size).cast("int") - margin)
    last = lambda c, n: F.least(n - 1, F.ceil(F.col(c) / size).cast("int") - 1 + margin)
    ranged = views.withColumns({"_c0": first("left"), "_r0": first("top"), "_c1": last("right", dims["columns"]), "_r1": last("bottom", dims["rows"])}).where("_c0 <= _c1 AND _r0 <= _r1")
    each = ranged.withColumn("col", F.explode(F.sequence("_c0", "_c1"))).withColumn("row", F.explode(F.sequence("_r0", "_r1")))
    return each.withColumn("key", morton(F.col("col"), F.col("row"))).drop("_c0", "_c1", "_r0", "_r1")


def with_cache(wanted: DataFrame, held: DataFrame, by: list[str], depth: int = 3) -> DataFrame:
    """``wanted`` (by, level, key) plus is_held, and held_above: the nearest level above, up to ``depth`` away, at which ``held`` (by, level, key) has the tile over it, or null.

    Each wanted tile meets the cache by one equi-join on keys: its own and those over it. What is found, a row at most for each different
    tile, is hashed; ``wanted`` streams by and is never sorted, so a task's memory doesn't grow with the views.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    keyed = wanted.select(*by, "level", "key").distinct().withColumn("_up", steps)
    asked = keyed.withColumns({"_level": F.col("level") - F.col("_up"), "_key": above(F.col("key"), F.col("_up"))})
    cache = held.select(*by, F.col("level").alias("_level"), F.col("key").alias("_key")).distinct()
    found = asked.join(cache, [*by, "_level", "_key"]).groupBy(*by, "level", "key").agg(F.min("_up").alias("_own"), F.min(F.when(F.col("_up") > 0, F.col("_up"))).alias("_over"))
    out = wanted.join(found.hint("shuffle_hash"), [*by, "level", "key"], "left")
    return out.withColumns({"is_held": F.coalesce(F.col("_own") == 0, F.lit(False)), "held_above": F.col("level") - F.col("_over")}).drop("_own", "_over")
