"""Pages as rows of types that a user adds: a table function for each type, by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a type may have: it becomes part of a SQL name.
NAME = re.compile(r"[A-Za-z_]\w*")


class PageInformation:
    """The type that is always there: number, width, height, whether the page is broader than high, and its area."""

    def eval(self, number: int, width: float, height: float, text: str):
        if width is not None and height is not None:
            yield number, width, height, width > height, width * height


def register(spark: SparkSession, name: str, factory: type, returns: str | None = None) -> None:
    """Add a type: ``factory.eval(number, width, height, text)`` yields its rows for one page.

    The columns are given as ``returns`` or told by a static ``analyze``, which may look at the arguments' types.
    A page may give any number of rows, none included; a later type of the same name takes its place.
    """
    if not NAME.fullmatch(name):
        raise ValueError(f"not a name of a type: {name}")
    spark.udtf.register(f"pagewright_{name}", F.udtf(factory, returnType=returns))


def pages_as(pages: DataFrame, name: str, by: list[str]) -> DataFrame:
    """``by`` and the columns of type ``name`` for each of ``pages`` (by, number, width, height, text)."""
    spark = pages.sparkSession
    if name == "information":
        register(spark, name, PageInformation, "number int, width double, height double, landscape boolean, area double")
    if not NAME.fullmatch(name) or not spark.catalog.functionExists(f"pagewright_{name}"):
        raise ValueError(f"no such type of page: {name}")
    keys = ", ".join(f"p.`{c}`" for c in by)
    held = pages.select(*by, F.col("number").cast("int"), F.col("width").cast("double"), F.col("height").cast("double"), F.col("text").cast("string"))
    return spark.sql(f"SELECT {keys}, f.* FROM {{pages}} p, LATERAL pagewright_{name}(p.number, p.width, p.height, p.text) f", pages=held)
