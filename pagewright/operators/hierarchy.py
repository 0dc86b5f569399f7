"""Trees as adjacency tables: paths, pre-order, block lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.plans.stages import cut

#: Deepest tree that is flattened; deeper ones, as those with a cycle, raise an error of the recursion limit.
MAX_DEPTH = 100_000


def lift_limits(spark: SparkSession) -> None:
    """Let recursive queries of the session give any number of rows (a million by default); their depth stays bounded."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def paths(nodes: DataFrame, key: str = "string") -> DataFrame:
    """(node_id, path, depth) of nodes (node_id, parent_id, place); path: places from the root, which sorts in pre-order.

    Roots have a null parent; nodes that no root reaches are left out. Any number of rows: see ``lift_limits``.
    """
    lift_limits(nodes.sparkSession)
    # Each level reads the nodes again.
    plain = cut(nodes.select(F.col("node_id").cast(key), F.col("parent_id").cast(key), F.col("place").cast("int")))
    sql = f"""WITH RECURSIVE walk(node_id, path, depth) MAX RECURSION LEVEL {MAX_DEPTH} AS (
      SELECT node_id, array(place), 0 FROM {{n}} WHERE parent_id IS NULL
      UNION ALL SELECT n.node_id, array_append(w.path, n.place), w.depth + 1 FROM walk w JOIN {{n}} n ON n.parent_id = w.node_id)
    SELECT node_id, path, depth FROM walk"""
    return nodes.sparkSession.sql(sql, n=plain)


def block_lookup(nodes: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_id, place, block columns): blocks that nodes name by block_ids; the first block of an id, missing ids dropped.

    ``blocks`` has by, id and place.
    """
    rank = F.row_number().over(Window.partitionBy(*by, "id").orderBy("place"))
    first = blocks.withColumn("_r", rank).where("_r = 1").drop("_r", "place")
    named = nodes.select(*by, "node_id", F.posexplode("block_ids").alias("place", "id"))
    return named.join(first, [*by, "id"])


def blocks_by_first_id(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, first_id, block_ids) keyed by each node's first block; of nodes that share it the last in pre-order counts."""
    keyed = nodes.where(F.size("block_ids") > 0).withColumn("first_id", F.col("block_ids")[0])
    return keyed.groupBy(*by, "first_id").agg(F.max_by("block_ids", "preorder").alias("block_ids"))


def nested_sets(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` (by, path, block_ids) numbered in pre-order: enter, leave (the last node of its subtree), and first, past: where the blocks of its subtree stand among the tree's.

    A node's descendants follow it in pre-order and go before it in post-order, so the two ranks and its depth tell how
    many they are: no row is made for an ancestor. The blocks of a subtree are one run of the tree's blocks in pre-order.
    """
    pre = Window.partitionBy(*by).orderBy("path")
    post = Window.partitionBy(*by).orderBy(F.concat("path", F.array(F.lit(2147483647))))
    own = F.coalesce(F.size("block_ids"), F.lit(0)).cast("long")
    ranked = nodes.withColumns({"enter": (F.row_number().over(pre) - 1).cast("long"), "_post": (F.row_number().over(post) - 1).cast("long"), "past": F.sum(own).over(pre.rowsBetween(Window.unboundedPreceding, 0))})
    placed = ranked.withColumns({"leave": F.col("_post") + F.size("path") - 1, "first": F.col("past") - own})
    last = placed.select(*by, F.col("enter").alias("leave"), F.col("past").alias("_last"))
    return placed.drop("_post", "past").join(last, [*by, "leave"]).withColumnRenamed("_last", "past")


def subtree_blocks(numbered: DataFrame, by: list[str], node: str) -> DataFrame:
    """(by, node, place, id): the blocks of each node of ``nested_sets`` and of all under it, in pre-order, repeated ones as often as they are named.

    An interval join as an equi-join on the places of each run: as many rows go through it as come out.
    """
    flat = numbered.select(*by, "first", F.posexplode("block_ids").alias("_i", "id")).select(*by, (F.col("first") + F.col("_i")).alias("_at"), "id")
    runs = numbered.where("past > first").select(*by, node, "first", F.explode(F.sequence("first", F.col("past") - 1)).alias("_at"))
    return runs.join(flat, [*by, "_at"]).select(*by, node, (F.col("_at") - F.col("first")).alias("place"), "id")
