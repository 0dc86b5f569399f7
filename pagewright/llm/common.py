"""What the operators of this package share: word rules, shared storage, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that separates alphanumeric words once A-Z are lower case.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
#: Bytes, about, of a table that may be broadcast, however many rows it has.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Rows and bytes of an Arrow batch, so that long texts fit in a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` does that for pure ASCII and is much the faster; it would change
    letters beyond ASCII, so those texts go through ``translate``.
    """
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Array of words; null and empty texts give an empty array."""
    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP, -1)
    return F.array_remove(pieces, "")


def row_key(row_id: Column, text: Column) -> list[Column]:
    """Two columns, k1 and k2, that name a row; rows that repeat id and text share them.

    They are never null, so that joins on them find rows with null ids too.
    """
    return [F.coalesce(row_id.cast("long"), F.lit(0)).alias("k1"), F.xxhash64(row_id, text).alias("k2")]


KEY = ["k1", "k2"]


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it, lambdas within lambdas included."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only in local mode (one machine, tests) a temporary folder takes its place where it is
    unset; on a cluster that would lose data, so an unset folder is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        named = tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
#: Every table that this process wrote and hasn't deleted.
_left: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside are deleted at the end.

    Those handed to the function that this yields stay, as what is returned still reads
    them; they then belong to the scratch around this one, if there is any.
    """
    own: list[str] = []
    stays: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        if (path := getattr(df, "_pagewright_path", None)) is not None:
            stays.append(path)
        return df

    outer = _written.get()
    token = _written.set(own)
    try:
        yield keep
    finally:
        _written.reset(token)
        if outer is not None:
            outer += stays
        for path in set(own) - set(stays):
            _delete(spark, path)


def clean_up(spark: SparkSession) -> int:
    """Delete all tables that ``materialize`` wrote in this process and that are still there; their number.

    Results of operators may still read them: call it when those have been written or collected.
    """
    n = len(_left)
    while _left:
        _delete(spark, _left[-1])
    return n


def _delete(spark: SparkSession, path: str) -> None:
    if path in _left:
        _left.remove(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts lineage as checkpoint() does, but compressed and column by column;
    a lost executor loses nothing of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pagewright/{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    _left.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagewright_path = path
    return out


def small(df: DataFrame, limit: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows and about ``most`` bytes; reads no more rows than it must.

    A value of fixed width counts as 8 bytes, any other as its JSON.
    """
    loose = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    fixed = F.lit(8 * (len(df.columns) - len(loose)))
    width = fixed + F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in loose]))) if loose else fixed
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.sum(width)).first()
    return rows <= limit and (size or 0) <= most


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Set the session to at most ``rows`` rows and about ``size`` bytes in an Arrow batch, for plans that run later.

    Settings that are tighter stay. ``bounded`` is for plans that run at once.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < held <= most:
            spark.conf.set(name, str(most))


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """``bound_batches`` for what runs inside; the session's own settings come back."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {name: spark.conf.get(name) for name in names}
    bound_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def broadcast_if(df: DataFrame, is_small: bool) -> DataFrame:
    return F.broadcast(df) if is_small else df
