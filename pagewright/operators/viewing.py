"""What a reader sees and touches: visible pages, hit tests, selections, tile order and tile fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G

# Zoom steps.
ZOOM_STEPS = (0.08, 0.125, 0.25, 0.33, 0.5, 0.67, 0.75, 1, 1.25, 1.5, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def next_zoom(zoom: Column, steps: tuple[float, ...] = ZOOM_STEPS) -> Column:
    """The next larger step; the largest stays."""
    held = F.array(*[F.lit(float(s)) for s in steps])
    return F.coalesce(F.array_min(F.filter(held, lambda s: s > zoom)), F.lit(float(steps[-1])))


def previous_zoom(zoom: Column, steps: tuple[float, ...] = ZOOM_STEPS) -> Column:
    """The next smaller step; the smallest stays."""
    held = F.array(*[F.lit(float(s)) for s in steps])
    return F.coalesce(F.array_max(F.filter(held, lambda s: s < zoom)), F.lit(float(steps[0])))


def stacked(pages: DataFrame, by: list[str], page: str, height: str) -> DataFrame:
    """``pages`` plus top and bottom of each when a document's pages lie below each other."""
    w = Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("bottom", F.sum(height).over(w)).withColumn("top", F.col("bottom") - F.col(height))


def visible(placed: DataFrame, views: DataFrame, by: list[str], page: str) -> DataFrame:
    """(by, page, shown) of pages of which some area lies in their document's one view; shown: that area.

    Pages have left, right, top and bottom, views view_left and so on. A page that only touches the view isn't seen.
    """
    sides = ("left", "top", "right", "bottom")
    area = G.intersection(*[F.col(c).cast("double") for c in sides], *[F.col(f"view_{c}").cast("double") for c in sides])["area"]
    return placed.join(views, by).select(*by, page, area.alias("shown")).where("shown > 0")


def most_visible(seen: DataFrame, by: list[str], page: str) -> DataFrame:
    """First and last page in view, and the one most of which shows (the first of equals)."""
    return seen.groupBy(*by).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.max_by(page, F.struct("shown", -F.col(page))).alias("most_visible"))


def hit_test(points: DataFrame, boxes: DataFrame, by: list[str], cell: float) -> DataFrame:
    """``points`` (by, x, y) plus box: the smallest of the ids of the boxes (by, id, x0, y0, x1, y1) that hold it, or null.

    Both sides meet by grid cell, an equi-join; borders belong to a box. ``cell`` should be about a box's size. Each
    place is looked up once, however many points lie on it.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    spread = boxes.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    own = points.select(*by, "x", "y").distinct().withColumn("_cx", at("x")).withColumn("_cy", at("y"))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    held = own.join(spread.select(*by, "id", "x0", "y0", "x1", "y1", "_cx", "_cy"), [*by, "_cx", "_cy"]).where(inside)
    return points.join(held.groupBy(*by, "x", "y").agg(F.min("id").alias("box")), [*by, "x", "y"], "left").select(*points.columns, "box")


def nearest_while_selecting(points: DataFrame, lines: DataFrame, words: DataFrame, by: list[str], key: str) -> DataFrame:
    """``points`` (key, by, x, y) plus line and word_idx: the word that a selection dragged to the point ends at, or null.

    ``lines`` (by, line, x0, x1, y1) and ``words`` (by, line, word_idx, x0, x1, y1) are horizontal; y1 is the lower edge.
    Lines that begin right of the point don't count. The nearest to the point's foot, or to the line's end when the
    point is beyond it, wins; heights weigh fourfold, the smaller line on ties. Beyond the end its last word is taken,
    else the word with the nearest lower corner (the first of equals). ``key`` names a point; a null key stays null.

    Lines of one place count as one, the smallest, and so do points. A page's lines meet each place in one row, where the least is found: no pair of point and
    line is a row of its own, and none is sorted or written.
    """
    apart = lines.where("x1 > x0").groupBy(*by, "x0", "x1", "y1").agg(F.min("line").alias("line"))
    held = apart.groupBy(*by).agg(F.collect_list(F.struct("line", "x0", "x1", "y1")).alias("_lines"))
    places = points.where(F.col(key).isNotNull()).select(*by, "x", "y").distinct()
    x, y = F.col("x"), F.col("y")

    def reach(line: Column) -> Column:
        across, down = x - F.least(x, line["x1"]), y - line["y1"]
        return F.when(x >= line["x0"], F.struct((across * across + 4 * down * down).alias("far"), line["line"].alias("line"), (x >= line["x1"]).alias("beyond")))

    best = F.array_min(F.transform("_lines", reach))
    chosen = places.join(held, by).select(*by, "x", "y", best.alias("best")).where("best IS NOT NULL").select(*by, "x", "y", "best.line", "best.beyond")
    parts = words.select(*by, "line", "word_idx", *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y1")])
    corner = F.least((x - F.col("_x0")) ** 2, (x - F.col("_x1")) ** 2) + (y - F.col("_y1")) ** 2
    rank = F.when(F.col("beyond"), -F.col("word_idx").cast("double")).otherwise(corner)
    ends = chosen.join(parts, [*by, "line"]).groupBy(*by, "x", "y", "line").agg(F.min(F.struct(rank.alias("rank"), "word_idx")).alias("w"))
    named = F.col(key).isNotNull()
    met = points.join(ends.select(*by, "x", "y", "line", "w.word_idx"), [*by, "x", "y"], "left")
    return met.select(*points.columns, F.when(named, F.col("line")).alias("line"), F.when(named, F.col("word_idx")).alias("word_idx"))


def selected(words: DataFrame, selections: DataFrame, by: list[str]) -> DataFrame:
    """Words (by, page_no, word_idx, ...) of each document's selection, in either direction.

    ``selections`` has anchor_page, anchor_word, focus_page and focus_word. First and last page are bounded, pages
    between are whole.
    """
    anchor, focus = (F.struct(F.col(f"{e}_page").alias("page"), F.col(f"{e}_word").alias("word")) for e in ("anchor", "focus"))
    ends = selections.select(*by, F.least(anchor, focus).alias("_a"), F.greatest(anchor, focus).alias("_b"), (anchor > focus).alias("backward"))
    ends = ends.select(*by, "backward", *[F.col(f"_{s}.{c}").alias(f"{n}_{c}") for s, n in (("a", "start"), ("b", "end")) for c in ("page", "word")])
    at = F.struct("page_no", "word_idx")
    inside = (at >= F.struct("start_page", "start_word")) & (at <= F.struct("end_page", "end_word"))
    return words.join(ends, by).where(inside).select(*words.columns, "backward")


def selected_of_pages(pages: DataFrame, selections: DataFrame, by: list[str]) -> DataFrame:
    """As ``selected``, from pages (by, page_no, words): pages out of the selection go before words are made rows."""
    anchor, focus = (F.struct(F.col(f"{e}_page").alias("page"), F.col(f"{e}_word").alias("word")) for e in ("anchor", "focus"))
    ends = selections.select(*by, F.least(anchor, focus).alias("_a"), F.greatest(anchor, focus).alias("_b"), (anchor > focus).alias("backward"))
    held = pages.join(ends, by).where(F.col("page_no").between(F.col("_a.page"), F.col("_b.page")))
    low = F.when(F.col("page_no") == F.col("_a.page"), F.col("_a.word"))
    high = F.when(F.col("page_no") == F.col("_b.page"), F.col("_b.word"))
    words = held.select(*by, "page_no", "backward", low.alias("_low"), high.alias("_high"), F.posexplode("words").alias("word_idx", "value"))
    inside = (F.col("word_idx") >= F.coalesce("_low", F.lit(0))) & F.coalesce(F.col("word_idx") <= F.col("_high"), F.lit(True))
    return words.where(inside).select(*by, "page_no", "word_idx", "value", "backward")


def expand(clicked: DataFrame, words: DataFrame, by: list[str], level: str) -> DataFrame:
    """``clicked`` (by, word_idx) plus first and last word of its ``level``: a column of ``words`` such as line or block."""
    spans = words.groupBy(*by, level).agg(F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"))
    own = clicked.join(words.select(*by, "word_idx", level), [*by, "word_idx"])
    return own.join(spans, [*by, level]).select(*clicked.columns, "first_word", "last_word")


def tile_order(tiles: DataFrame, centre_col: Column, centre_row: Column) -> DataFrame:
    """``tiles`` (page, col, row) plus distance2 and angle: sort by page and both, rings outward, clockwise from the top."""
    dx, dy = F.col("col") + 0.5 - centre_col, F.col("row") + 0.5 - centre_row
    turn = F.atan2(dx, -dy)
    return tiles.withColumns({"distance2": dx * dx + dy * dy, "angle": F.when(turn < 0, turn + 2 * F.pi()).otherwise(turn)})


def _up(c: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(c), by)


def tile_fallback(wanted: DataFrame, held: DataFrame, depth: int = 8) -> DataFrame:
    """``wanted`` (page, level, col, row) plus fallback_level: that of the nearest coarser tile held over it, else that of
    the nearest finer level with any tile held inside it, else null. Levels up to ``depth`` apart count.

    A tile's ancestors have shifted numbers, so both searches are equi-joins.
    """
    key = ["page", "level", "col", "row"]
    step = F.explode(F.sequence(F.lit(1), F.lit(depth)))
    lift = lambda t: t.withColumn("_d", step).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("page"), (F.col("level") - F.col("_d")).alias("level"), _up("col", F.col("_d")).alias("col"), _up("row", F.col("_d")).alias("row"))
    own = held.select(*key).distinct()
    asked = wanted.select(*key).distinct()
    coarser = lift(asked).join(own, key).groupBy(*[f"_{c}" for c in key]).agg(F.max("level").alias("coarser")).toDF(*key, "coarser")
    finer = lift(own).join(asked, key).groupBy(*key).agg(F.min("_level").alias("finer"))
    return wanted.join(coarser, key, "left").join(finer, key, "left").select(*wanted.columns, F.coalesce("coarser", "finer").alias("fallback_level"))
