"""Trees of documents as Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import relations


def documents(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, markdown) of nodes (by, path, kind, level, title, content): every node's text in pre-order.

    A document's nodes meet in one row, as its Markdown must be one string.
    """
    piece = relations.markdown(F.col("kind"), F.col("level"), F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    parts = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("path", piece.alias("x")))).alias("parts"))
    return parts.select(*by, F.array_join(F.transform("parts", lambda p: p["x"]), "").alias("markdown"))


def write(nodes: DataFrame, by: str, folder: str) -> None:
    """One folder ``by``=value for each document, with its Markdown in a text file."""
    texts = documents(nodes, [by]).select(F.col("markdown").alias("value"), by)
    texts.write.mode("errorifexists").partitionBy(by).text(folder)
