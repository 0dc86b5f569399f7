"""Joins, roll-ups and selections of the document model: nearest, range, as-of, anti, trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Queries that are broadcast in one block, and parts of the items that each further block meets.
BLOCK, PARTS = 20_000, 64


def nearest(queries: DataFrame, items: DataFrame, distance: Callable[[Column, Column], Column], k: int = 1, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, distance, rank): items within the ``k`` smallest different distances of each query.

    ``queries`` (id, v) is a stated set; up to ``block`` of them are broadcast. Beyond that they go in blocks: a block meets
    each of ``PARTS`` parts of the items by an equi-join. Partial top-k per task and query keeps the shuffle to k rows, ties aside.
    """
    n = queries.limit(block + 1).count()
    different = F.col("i.id") != F.col("q.id")
    if n <= block:
        met = items.alias("i").join(F.broadcast(queries.alias("q")), different)
    else:
        blocks = -(-queries.count() // block)
        asked = queries.withColumns({"_block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "_part": F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))})
        dealt = items.withColumns({"_part": F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"), "_block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
        met = dealt.alias("i").join(asked.alias("q"), (F.col("i._block") == F.col("q._block")) & (F.col("i._part") == F.col("q._part")) & different)
    pairs = met.select(F.col("q.id").alias("query_id"), F.col("i.id").alias("item_id"), F.round(distance(F.col("q.v"), F.col("i.v")), 4).alias("distance"))
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("distance"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: Vectors of items and of queries, about, that one row holds; queries that are held against a row's items at once; digits of a distance that count.
CHUNK, ROWS, DIGITS = 4096, 256, 4


def _vectors(held: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a row."""
    ids, vectors = held.values.flatten()
    return ids.to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)


def _near_pairs(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of queries and items: the pairs (query_id, item_id, distance) that can be within the ``k`` smallest different distances of a query.

    A matrix product finds them to within a margin, ``ROWS`` queries at a time; their distances are then summed in the order of the values.
    """

    def pairs(qid: np.ndarray, q: np.ndarray, iid: np.ndarray, v: np.ndarray, size: np.ndarray, shared: bool) -> pa.RecordBatch:
        far = q @ (-2 * v.T)
        far += (q * q).sum(axis=1)[:, None]
        far += size
        if shared:
            far[qid[:, None] == iid[None, :]] = np.inf
        margin = 2 * 10.0**-DIGITS + 1e-9 * (np.abs(q).max(initial=0) + np.abs(v).max(initial=0)) ** 2 * q.shape[1]
        most = far.min(axis=1)
        for _ in range(k - 1):
            most = np.min(far, axis=1, where=far > (most + margin)[:, None], initial=np.inf)
        near = far <= (most + margin)[:, None]
        i, j = np.divmod(np.flatnonzero(near), far.shape[1])
        there = far[i, j] < np.inf
        i, j = i[there], j[there]
        total = np.zeros(len(i))
        for c in range(q.shape[1]):
            total += (q[i, c] - v[j, c]) * (q[i, c] - v[j, c])
        return pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(iid[j]), pa.array(total)], ["query_id", "item_id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (qid, q), (iid, v) = _vectors(batch["block"][row]), _vectors(batch["chunk"][row])
                shared, size = np.isin(qid, iid), (v * v).sum(axis=1)
                for lo in range(0, len(qid), ROWS):
                    some = slice(lo, lo + ROWS)
                    yield pairs(qid[some], q[some], iid, v, size, shared[some].any())

    return run


def nearest_vectors(queries: DataFrame, items: DataFrame, k: int = 1, chunk: int = CHUNK) -> DataFrame:
    """``nearest`` by ``squared_distance`` of vectors of one length; rows without an id or vector count on neither side.

    Queries and items are gathered to rows of about ``chunk`` vectors. Every row of queries meets every row of items, all of them pairs that have to be
    compared, but by a matrix product; only those near enough within their two rows are ranked.
    """

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        held = rows.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), "v")
        parts = -(-held.count() // chunk) or 1
        return held.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias(f"_{name}")).agg(F.collect_list(F.struct("id", "v")).alias(name))

    blocks, chunks = gathered(queries, "block"), gathered(items, "chunk")
    met = chunks.crossJoin(blocks).select("block", "chunk").mapInArrow(_near_pairs(k), "query_id long, item_id long, distance double")
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("distance"))
    return met.withColumn("distance", F.round("distance", DIGITS)).withColumn("rank", rank).where(F.col("rank") <= k)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, value: str) -> DataFrame:
    """Each left row with the last right ``value`` at or before ``at``: one union, one sort, no pairs."""
    both = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(*by, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_l"), F.col(value).alias("_v")))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", F.col("_last").alias(value))


def ordinals(words: DataFrame) -> DataFrame:
    """Running numbers from 0 of (doc_id, page_no, block, line, word) on each page."""
    return words.withColumn("word_idx", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("block", "line", "word")) - 1)


def peak_average(values: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Mean of the fullest bin of each group; the lowest of equally full bins."""
    bins = values.groupBy(*by, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return bins.groupBy(*by).agg(F.max_by("mean", F.struct("n", -F.col("bin"))).alias("peak_mean"), F.max("n").alias("peak_count"))


def mode_or_null(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, null if several are."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by, "n").agg(F.count("*").alias("ties"), F.min(value).alias("v"))
    best = top.groupBy(*by).agg(F.max_by(F.struct("ties", "v"), "n").alias("x"))
    return best.select(*by, F.when(F.col("x.ties") == 1, F.col("x.v")).alias("mode"))


def subtree_sums(nodes: DataFrame, *values: str) -> DataFrame:
    """(path, values) of nodes (path: array of keys from the root, values): each node's own and its descendants' sums, in one aggregation."""
    up = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path"), *values)
    return up.groupBy("path").agg(*[F.sum(v).alias(v) for v in values])


def markdown(kind: Column, level: Column, title: Column, content: Column) -> Column:
    """Markdown of one tree node; other kinds give the empty string."""
    n = F.lit("\n")
    head = F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" "), title, n, n)
    text = F.concat(F.when(title != "", F.concat(F.lit("## "), title, n)).otherwise(""), F.replace(content, F.lit("<|txt_split|>"), n), n, n)
    return F.when(kind == "title", head).when(kind == "text", text).when(kind == "image", F.concat(F.lit("!["), title, F.lit("](image_placeholder)"), n, n)).when(kind == "table", F.concat(F.lit("### "), title, n, content, n, n)).when(kind == "caption", F.concat(F.lit("*"), content, F.lit("*"), n, n)).otherwise("")


def within_budget(rows: DataFrame, by: list[str], size: str, newest: list[Column], budget: int) -> DataFrame:
    """Rows that a least-recently-used store of ``budget`` bytes still holds."""
    w = Window.partitionBy(*by).orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("held", F.sum(size).over(w)).where(F.col("held") <= budget)
