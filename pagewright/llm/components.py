"""Connected components of an edge table by alternating large-star and small-star rounds.

A vertex with more than ``hub`` edges, and more than one in ``HUBS`` of all edges, is a hub.
There are fewer than ``2 * HUBS`` hubs however large the table is, so their minima are broadcast
and no task gets all edges of a hub; other vertices are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import common

MAX_ROUNDS = 60
HUB, HUBS = 100_000, 10_000


def _with_least(rows: DataFrame, least: DataFrame, many: int, n: int) -> DataFrame:
    """``rows`` (u, v) with m, the least of u's neighbourhood, from ``least`` (u, m, degree)."""
    if n <= many:
        return rows.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("degree") > many).select("u", "m"))
    plain = rows.join(hubs, "u", "left_anti").join(least.where(F.col("degree") <= many).select("u", "m"), "u")
    return plain.unionByName(rows.join(hubs, "u"))


def _large(edges: DataFrame, many: int, n: int) -> DataFrame:
    """Every larger neighbour of a vertex points at the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    return _with_least(both.where(F.col("v") > F.col("u")), least, many, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, many: int, n: int) -> DataFrame:
    """A vertex and its smaller neighbours point at the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    rest = _with_least(down, least, many, n).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(id, component) of each vertex of ``edges`` (u, v: longs); component: the smallest id reachable.

    Self loops count for nothing. Every round's table is written to the shared
    folder; the driver sees only its row count and a checksum.
    """
    with common.scratch(edges.sparkSession) as keep:
        edges = common.materialize(edges.where(F.col("u") != F.col("v")).select("u", "v"), "edges")
        n, before = edges.count(), None
        for _ in range(MAX_ROUNDS):
            many = max(hub, n // HUBS)
            edges = common.materialize(_small(_large(edges, many, n), many, n), "edges")
            n, state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if (n, state) == before:
                edges = keep(edges)
                return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
            before = n, state
    raise RuntimeError("components did not settle")
