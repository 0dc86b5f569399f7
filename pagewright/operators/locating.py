"""Where a pointer or an element lies: pages under a point, thumbnails in view, nearest elements of a page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The greatest single-precision number: a distance must be below it to count.
FARTHEST = 3.4028234663852886e38


def page_over(points: DataFrame, pages: DataFrame, by: list[str], cell: float) -> DataFrame:
    """``points`` (by, id, x, y, at) plus page: the page (by, page, x0, y0, x1, y1) that holds the point, or null.

    Where borders meet, page ``at`` counts first, then the one nearest to it. Both sides meet
    by rows of height ``cell``, an equi-join; ``cell`` should be about a page's height. A point without
    a place lies on no page.
    """
    row = lambda y: F.floor(y / cell)
    spread = pages.select(*by, F.col("page").alias("_page"), "x0", "y0", "x1", "y1", F.explode(F.sequence(row(F.col("y0")), row(F.col("y1")))).alias("_row"))
    keyed = points.withColumn("_row", row(F.col("y")))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    met = keyed.join(spread, [*by, "_row"]).where(inside)
    over = met.groupBy(*by, "id").agg(F.min_by("_page", F.struct(F.abs(F.col("_page") - F.col("at")), "_page")).alias("page"))
    return points.join(over, [*by, "id"], "left")


def first_run(places: DataFrame, by: list[str], place: str, seen: str) -> DataFrame:
    """(by, first, past) of the first unbroken run of places that are ``seen``; past: one more than its last.

    Groups where none is seen are left out. Only a row that is not seen ends a run, a missing number doesn't.
    """
    so_far = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    shown = F.coalesce(F.col(seen), F.lit(False))
    runs = places.withColumn("_run", F.sum(F.when(shown, 0).otherwise(1)).over(so_far)).where(shown)
    ends = runs.groupBy(*by, "_run").agg(F.min(place).alias("first"), (F.max(place) + 1).alias("past"))
    return ends.groupBy(*by).agg(F.min(F.struct("first", "past")).alias("_x")).select(*by, "_x.*")


def nearest_of_page(elements: DataFrame, by: list[str], key: str, fields: list[str], distance: Callable[[Column, Column], Column]) -> DataFrame:
    """(by, key, nearest, distance): the nearest other element of the same page, of equals the smallest key; else null.

    Elements are points, segments or any struct of ``fields``; ``distance`` takes two such structs.
    A page's elements stay one row, so no pairs are shuffled; pages are bounded by what one
    row can hold.
    """
    page = elements.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(key, *fields))).alias("_all"))

    def nearest(pivot: Column) -> Column:
        others = F.transform(F.filter("_all", lambda c: c[key] != pivot[key]), lambda c: F.struct(distance(pivot, c).cast("float").alias("distance"), c[key].alias("nearest")))
        best = F.array_min(F.filter(others, lambda d: F.coalesce(~F.isnan(d["distance"]) & (d["distance"] < FARTHEST), F.lit(False))))
        return F.struct(pivot[key].alias(key), best["nearest"].alias("nearest"), best["distance"].alias("distance"))

    return page.select(*by, F.inline(F.transform("_all", nearest)))
