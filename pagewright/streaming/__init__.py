"""Streams of documents to open and of notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def opened(spark: SparkSession, folder: str, extension: str = ".pdf") -> DataFrame:
    """(path, modificationTime, length) of the files with ``extension`` as they arrive; the checkpoint keeps which were seen."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").endswith(extension.lower())).select("path", "modificationTime", "length")


def not_repeated(notices: DataFrame, at: str, key: list[str], within: str) -> DataFrame:
    """Notices whose key did not come within ``within`` before; state older than that is dropped.

    A notice later than the watermark by more than ``within`` is dropped, too.
    """
    return notices.withWatermark(at, within).dropDuplicatesWithinWatermark(key)
