"""Files that belong to a document: results of each stage, Markdown members, embedded files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import lookups


def stage_files(files: DataFrame, stages: list[str], model: str) -> DataFrame:
    """(doc_id, one column of paths a stage) from files (path) laid out as .../stage/model/doc.json.

    The wanted model's file counts, else that of the first other model by name; null without one.
    """
    parts = F.reverse(F.split("path", "/"))
    named = files.where(F.col("path").endswith(".json")).select("path", F.regexp_replace(parts[0], r"\.json$", "").alias("doc_id"), parts[1].alias("model"), parts[2].alias("stage"))
    best = F.min_by("path", F.struct(F.col("model") != model, F.col("model"), F.col("path")))
    return named.where(F.col("stage").isin(stages)).groupBy("doc_id").pivot("stage", stages).agg(best)


def markdown_members(members: DataFrame, by: list[str], place: str, marker: str) -> DataFrame:
    """(by, markdown, marked) of members (by, place, path, text) of archives.

    marked: the last .md member whose name holds ``marker`` in either case; markdown: the first
    of the others, unless one that holds it comes before.
    """
    name = F.lower(F.substring_index("path", "/", -1))
    seen = members.where(name.endswith(".md")).withColumn("_marked", name.contains(marker.lower()))
    at, marked = F.col(place), F.col("_marked")
    held = seen.groupBy(*by).agg(
        F.min_by("text", F.when(~marked, at)).alias("plain"),
        F.min(F.when(~marked, at)).alias("plain_at"),
        F.min(F.when(marked, at)).alias("marked_at"),
        F.max_by("text", F.when(marked, at)).alias("marked"),
    )
    first = F.col("marked_at").isNull() | (F.col("plain_at") < F.col("marked_at"))
    return held.select(*by, F.when(first, F.col("plain")).alias("markdown"), "marked")


def embedded(documents: DataFrame, by: list[str], files: str = "files") -> DataFrame:
    """(by, place, name, bytes): a row for each of a document's embedded files (name, bytes), from 0."""
    listed = documents.select(*by, F.posexplode(files).alias("place", "_f"))
    return listed.select(*by, "place", F.col("_f.name").alias("name"), F.col("_f.bytes").alias("bytes"))


def save(files: DataFrame, folder: str) -> None:
    """Writes files (doc_id, place, name, bytes) to ``folder``/doc_id/place/name, the name made safe for file systems.

    ``folder`` must be shared by all executors. A file appears whole: a task that runs again
    writes the same bytes under the same name.
    """

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            into = os.path.join(folder, str(row.doc_id), str(row.place))
            os.makedirs(into, exist_ok=True)
            part = os.path.join(into, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row.bytes or b"")
            os.replace(part, os.path.join(into, row.name))

    files.select("doc_id", "place", T.safe_name(F.coalesce("name", F.lit("file"))).alias("name"), "bytes").foreachPartition(write)


def opened_once(files: DataFrame, order: Column) -> DataFrame:
    """One row of each path, the first in ``order``."""
    named = files.withColumn("_order", order)
    return lookups.one_of_each(named, ["path"], ["_order"]).drop("_order")
