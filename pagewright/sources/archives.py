"""Files as rows: documents by extension, JSON members of result archives, trees in JSON."""

from __future__ import annotations

import fnmatch
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources import blocks_json

# Members that are looked for in an archive, the first kind found counts.
MEMBERS = ("*_middle.json", "middle.json", "*_content_list.json", "*.json")


def documents(spark: SparkSession, folder: str, extension: str = ".pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files with ``extension`` in either case, in all subfolders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").endswith(extension.lower()))


def candidates(names: list[str]) -> list[tuple[str, str]]:
    """(kind, name) of the members that may hold a result, in the order in which they are tried.

    Of each kind of ``MEMBERS`` the first in archive order; a content list is tried last where there is one, else every JSON file.
    """
    of = lambda kind: [n for n in names if fnmatch.fnmatchcase(n.rsplit("/", 1)[-1].lower(), kind)]
    first = [("middle", n) for kind in MEMBERS[:2] for n in of(kind)[:1]]
    listed = of(MEMBERS[2])[:1]
    return [*first, *[("list", n) for n in listed], *[("middle", n) for n in ([] if listed else of(MEMBERS[3]))]]


def pick_member(names: list[str]) -> str | None:
    """The member that is tried first."""
    return next((name for _, name in candidates(names)), None)


MEMBER = [("path", pa.string()), ("place", pa.int32()), ("kind", pa.string()), ("member", pa.string()), ("json", pa.string())]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # One member at a time, so that no more than one is open in memory.
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            found = 0
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as held:
                    for place, (kind, name) in enumerate(candidates(held.namelist())):
                        yield _member(path.as_py(), place, kind, name, held.read(name).decode("utf-8", "replace"))
                        found += 1
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
                pass
            if not found:
                yield _member(path.as_py(), 0, None, None, None)


def _member(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(values, MEMBER, strict=True)], names=[n for n, _ in MEMBER])


def members(files: DataFrame) -> DataFrame:
    """(path, place, kind, member, json) of each member of archives ``files`` (path, content) that may hold a result; one row of nulls where none does."""
    return files.select("path", "content").mapInArrow(_opened, "path string, place int, kind string, member string, json string")


def archived_json(files: DataFrame) -> DataFrame:
    """(path, member, json) of the first member of each archive that holds a result; both null if none does.

    A middle file does if it is an object with a block on a page or with a tree, a content list if it is an array with a block. What doesn't parse is passed over, but for a
    content list, after which nothing is tried.
    """
    v = F.try_parse_json("json")
    pages = F.try_variant_get(v, "$.pages", "map<string,array<variant>>")
    tree = F.try_variant_get(v, "$.tree", "variant")
    whole = F.coalesce(F.exists(F.map_values(pages), lambda b: F.size(b) > 0), F.lit(False)) | (tree.isNotNull() & ~F.is_variant_null(tree))
    listed = F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")) > 0, F.lit(False))
    holds = F.when(F.col("kind") == "list", listed).otherwise(F.col("kind").isNotNull() & whole)
    best = F.min_by(F.when(F.col("_holds"), F.struct("member", "json")), F.when(F.col("_holds"), F.col("place")))
    return members(files).withColumn("_holds", holds).groupBy("path").agg(best.alias("_best")).select("path", "_best.member", "_best.json")


def tree_json(raw: DataFrame, column: str = "json") -> DataFrame:
    """``raw`` with a row for each node of the tree in ``column``: path (sorts in pre-order), title, n_blocks. Text that is no tree gives no row."""
    rest = [c for c in raw.columns if c != column]
    nodes = blocks_json.tree_nodes(raw, rest, column)
    return nodes.select(*rest, "path", "title", F.size("block_ids").alias("n_blocks"))
