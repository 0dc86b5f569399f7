"""Nearest neighbours of a page's points on a grid, and the groups that they link to."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.plans.stages import cut

#: Levels that a search goes up in one round; a cell of the next round has 4 ** that many times the area.
RISE = 2
#: Points, about, of a cell of the first grid.
CROWD = 2
DISTANCES = {
    "euclidean": lambda dx, dy: F.sqrt(dx * dx + dy * dy),
    "manhattan": lambda dx, dy: F.abs(dx) + F.abs(dy),
}


def nearest(points: DataFrame, by: list[str], key: str, x: str, y: str, distance: str = "euclidean", most: float | None = None) -> DataFrame:
    """(by, key, nearest, distance): the nearest other point of the same page (by), of equals the smallest key; null if none is nearer than ``most``.

    A page's points fall into cells of a grid, at first so fine that a point shares its cell with few others. In the first round each point is sent to the
    nine cells about it, gathered there, and a point meets those of its own cell in one row; later, when few are left, those go to nine cells. No pair is a row.
    What a point finds within a cell's side is the nearest: everything outside the nine is farther. Points that
    find none so near go on to a grid of larger cells, until one cell is the page; each round is written, and only its rest goes on.
    Points at one place are each other's nearest: they are told apart by keys, and one of them stands for all on the grid.
    """
    of = DISTANCES[distance]
    kind = f"struct<distance:double,nearest:{dict(points.dtypes)[key]}>"
    every = points.select(*by, key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    placed = every.groupBy(*by, "_x", "_y").agg(F.min(key).alias("_least"), F.count("*").alias("_times"))
    named = every.join(placed.where("_times > 1"), [*by, "_x", "_y"])
    second = named.where(F.col(key) != F.col("_least")).groupBy(*by, "_least").agg(F.min(key).alias("_second"))
    stacked = named.join(second, [*by, "_least"], "left").select(*by, key, F.struct(F.lit(0.0).alias("distance"), F.when(F.col(key) != F.col("_least"), F.col("_least")).otherwise(F.col("_second")).alias("nearest")).cast(kind).alias("_best"))
    points, x, y = placed.select(*by, F.col("_least").alias(key), "_x", "_y", (F.col("_times") == 1).alias("_alone")), "_x", "_y"
    extent = points.groupBy(*by).agg(F.count("*").alias("_n"), F.min(x).alias("_x0"), F.min(y).alias("_y0"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).cast("double").alias("_span"))
    side = F.when(F.col("_span") > 0, F.col("_span")).otherwise(1.0) / F.ceil(F.sqrt("_n"))
    all_ = cut(points.join(extent.select(*by, "_x0", "_y0", side.alias("_side"), F.ceil(F.log2(F.ceil(F.sqrt("_n")) + 1)).cast("int").alias("_top")), by).select(*by, key, x, y, "_alone", "_x0", "_y0", "_side", "_top"))
    top = all_.agg(F.max("_top")).first()[0]
    rest, found = all_.where("_alone"), stacked
    sized = lambda level: F.col("_side") * float(2.0**level)
    cell = lambda c, o, level: F.floor((F.col(c) - F.col(o)) / sized(level))
    sharing = all_.groupBy(*by, cell(x, "_x0", 0).alias("_cx"), cell(y, "_y0", 0).alias("_cy")).agg(F.count("*").alias("_n"))
    crowd = sharing.agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("_n")).first()[0] or 1.0
    first = level = -max(0, round(math.log(crowd / CROWD, 4)))
    while top is not None:
        size, at = sized(level), [cell(x, "_x0", level), cell(y, "_y0", level)]
        around = F.inline(F.array(*[F.struct((at[0] + i).alias("_cx"), (at[1] + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        own = [at[0].alias("_cx"), at[1].alias("_cy")]
        spread = [[around], own] if level == first else [own, [around]]
        other = F.struct(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
        held = all_.where(F.col("_top") >= level - RISE).select(*by, other.alias("_p"), *spread[0]).groupBy(*by, "_cx", "_cy").agg(F.collect_list("_p").alias("_others"))
        asked = rest.select(*by, key, x, y, size.alias("_size"), "_top", *spread[1])
        apart = lambda p: F.when(p["k"] != F.col(key), F.struct(of(F.col(x) - p["x"], F.col(y) - p["y"]).alias("distance"), p["k"].alias("nearest")))
        best = asked.join(held, [*by, "_cx", "_cy"], "left").select(*by, key, F.array_min(F.transform("_others", apart)).alias("_best"), "_size", "_top")
        if level != first:
            best = best.groupBy(*by, key).agg(F.min("_best").alias("_best"), F.first("_size").alias("_size"), F.first("_top").alias("_top"))
        # A page without spread, or one cell to a side, has been seen whole.
        sure = (F.col("_best.distance") <= F.col("_size")) | (F.col("_top") <= level)
        if most is not None:
            sure = sure | (F.col("_size") >= most)
        judged = cut(best.withColumn("_sure", F.coalesce(sure, F.col("_top") <= level)))
        found = found.unionByName(judged.where("_sure").select(*by, key, F.col("_best").cast(kind).alias("_best")))
        rest = cut(rest.join(judged.where("NOT _sure").select(*by, key), [*by, key], "left_semi"))
        level += RISE
        if level > top + RISE or not rest.limit(1).count():
            break
    kept = F.when(F.lit(True) if most is None else F.col("_best.distance") < most, F.col("_best"))
    return found.select(*by, key, kept["nearest"].alias("nearest"), kept["distance"].alias("distance"))


def components(nodes: DataFrame, links: DataFrame, by: list[str], key: str, other: str) -> DataFrame:
    """(by, key, component) of ``nodes`` (by, key): the smallest key that ``links`` (by, key, other) lead to within the page, in either direction.

    Links shrink in rounds: each node that has any goes into the least of its neighbours and itself, by an order that changes with the round so that long chains
    shrink, too, by a share of their length; links are drawn between what is left, until none is. The steps are then put together from the last, the
    smallest, to the first. A page is never in one task.
    """
    ends = F.struct(F.least(key, other).alias("_a"), F.greatest(key, other).alias("_b"))
    edges = cut(links.where(F.col(other).isNotNull() & (F.col(other) != F.col(key))).select(*by, ends.alias("_e")).select(*by, "_e.*").distinct())
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("_h"), F.col(c).alias("_to"))  # noqa: B023, E731
        both = edges.select(*by, F.inline(F.array(F.struct(F.col("_a"), F.col("_b")), F.struct(F.col("_b").alias("_a"), F.col("_a").alias("_b")))))
        least = both.groupBy(*by, "_a").agg(F.min(drawn("_b")).alias("_m"))
        step = cut(least.select(*by, "_a", F.least(drawn("_a"), "_m")["_to"].alias("_to")))
        steps.append(step)
        moved = edges.join(step, [*by, "_a"]).select(*by, "_b", F.col("_to").alias("_c")).join(step.withColumnRenamed("_a", "_b"), [*by, "_b"])
        edges = cut(moved.where("_c <> _to").select(*by, F.least("_c", "_to").alias("_a"), F.greatest("_c", "_to").alias("_b")).distinct())
    ids = nodes.select(*by, F.col(key).alias("_id")).distinct()
    if not steps:
        return ids.select(*by, F.col("_id").alias(key), F.col("_id").alias("component"))
    top = steps.pop()
    while steps:
        over = top.select(*by, F.col("_a").alias("_to"), F.col("_to").alias("_over"))
        top = cut(steps.pop().join(over, [*by, "_to"], "left").select(*by, "_a", F.coalesce("_over", "_to").alias("_to")))
    ends_at = top.groupBy(*by, "_to").agg(F.min("_a").alias("_least"))
    # What a group ends at has no links of its own in the end, but it had some in the first step.
    named = top.join(ends_at, [*by, "_to"]).select(*by, F.col("_a").alias("_id"), "_least")
    return ids.join(named, [*by, "_id"], "left").select(*by, F.col("_id").alias(key), F.coalesce("_least", "_id").alias("component"))
