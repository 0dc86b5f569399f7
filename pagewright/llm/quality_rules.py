"""Quality rules: repetition counts and bands of zstandard ratios.

A text's ratio is compressed size over size. The whole text and each chunk of
``CHUNK`` bytes are compressed; what is left after the last full chunk is tested as the
text's last ``CHUNK`` bytes, so that every byte is in a chunk. The text is rejected if its
whole ratio leaves the band of its length class, or if more than ``BAD_CHUNKS`` of its
chunks leave the chunk band. A text under ``CHUNK`` bytes has no chunk of its own, and its class's
band takes the place of the chunk band.

Limits follow the corpus. Ratios fall as texts get longer, so each length class (a power of
two bytes; all under 2 ** ``FIRST`` are one class) has a line of its own, ratio against the logarithm of
the size, through its trusted texts, and the spread of theirs about it; the band reaches
``BELOW`` spreads below the line and ``ABOVE`` above. All chunks are of one size and have one
band, from those of trusted texts. Trusted are texts labelled good, if there are labels,
else all that pass the base rules; every one counts. A class with fewer than
``LEAST`` of them has the limits of ``BANDS``, which are wide.

Null counts as an empty text: no words, every count 0, base_failed true. Very long
texts are processed whole. Windows are compared by 64-bit hashes mixed from word
numbers that are exact within the text. Repeated rows get equal results. Labels that are null
are ignored, and a text with labels of both kinds isn't trusted. Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common
from pagewright.llm.quality_classifier import HELD_OUT, fold

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEVEL = 3
CHUNK = 4096
#: (size in bytes from which the class begins, least ratio, greatest ratio) of a whole text.
BANDS = ((1, 0.35, 1.40), (256, 0.35, 0.90), (1024, 0.30, 0.75), (4096, 0.25, 0.65), (16384, 0.20, 0.60), (65536, 0.15, 0.60))
CHUNK_BAND = (0.25, 0.75)
BAD_CHUNKS = 0.25
FIRST = 8
SHORT = FIRST - 1
BELOW, ABOVE, LEAST = 3.0, 6.0, 20
#: A spread counts as so much at least: texts that repeat have none.
LEAST_SPREAD = 0.004
#: The quartiles of a normal distribution are so many deviations apart.
QUARTILES = 1.349
FIELDS = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_bytes", pa.int64()), ("ratio", pa.float64()), ("chunks", pa.list_(pa.float32()))])
MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += mixed[k : k + n] * MIX[k]
    h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Limits:
    """Bands of length classes (class: slope and middle of its line, spread) and of chunks (least, greatest)."""

    lines: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    chunk: tuple[float, float] = CHUNK_BAND

    def band(self, size: int) -> tuple[float, float]:
        """Least and greatest ratio of a text of ``size`` bytes."""
        if (line := self.lines.get(max(int(log2(size)), SHORT))) is not None:
            slope, middle, spread = line
            return middle + slope * log2(size) - BELOW * spread, middle + slope * log2(size) + ABOVE * spread
        return [(low, high) for least, low, high in BANDS if size >= least][-1]


def ratios(raw: bytes, compress) -> tuple[float, list[float]]:
    """Ratio of the whole and of each chunk; an empty text has ratio 0 and no chunks."""
    if not raw:
        return 0.0, []
    starts = [*range(0, len(raw) - CHUNK + 1, CHUNK)]
    if starts and len(raw) % CHUNK:
        starts.append(len(raw) - CHUNK)
    return len(compress(raw)) / len(raw), [len(compress(raw[i : i + CHUNK])) / CHUNK for i in starts]


def bands(raw: bytes, compress, limits: Limits = Limits()) -> tuple[float, int, int, bool]:  # noqa: B008
    """Whole ratio, chunks outside the chunk band, chunks, and the verdict on one text."""
    ratio, chunks = ratios(raw, compress)
    if not raw:
        return ratio, 0, 0, True
    bad = sum(not limits.chunk[0] <= r <= limits.chunk[1] for r in chunks)
    low, high = limits.band(len(raw))
    return ratio, bad, len(chunks), low <= ratio <= high and bad <= BAD_CHUNKS * len(chunks)


def measure(text: str | None, compress) -> tuple:
    raw = (text or "").encode("utf-8", "replace")
    text = text or ""
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    repeats = repeated_words(ids)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return (len(words), len(text) - sum(map(text.count, SPACES.decode())), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, len(raw), *ratios(raw, compress))


def measures(text: Column) -> Column:
    """struct of the counts, the size and the ratios of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            columns = list(zip(*[measure(t.as_py(), compress) for t in batch], strict=True)) or [[]] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], fields=list(FIELDS))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.float32()): "array<float>"}
    return F.arrow_udf(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in FIELDS))(text)


def _class() -> Column:
    return F.greatest(F.floor(F.log2(F.greatest(F.col("n_bytes"), F.lit(1)))).cast("int"), F.lit(SHORT))


def _spread(quartiles: list[float]) -> float:
    return max((quartiles[2] - quartiles[0]) / QUARTILES, LEAST_SPREAD)


def learn(trusted: DataFrame) -> Limits:
    """Limits from all trusted texts (n_bytes, ratio, chunks)."""
    each = trusted.where("n_bytes > 0").select(_class().alias("class"), F.log2("n_bytes").alias("log"), "ratio")
    slopes = each.groupBy("class").agg(F.coalesce(F.regr_slope("ratio", "log"), F.lit(0.0)).alias("slope"), F.count("*").alias("n"))
    # A class is a power of two bytes, so there are few.
    lines = {r["class"]: r["slope"] for r in slopes.where(F.col("n") >= LEAST).collect()}
    found: dict[int, tuple[float, float, float]] = {}
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias("q")
    if lines:
        slope = F.element_at(F.create_map(*[F.lit(x) for pair in lines.items() for x in pair]), F.col("class"))
        left = each.where(F.col("class").isin(list(lines))).groupBy("class").agg(quartiles(F.col("ratio") - slope * F.col("log")))
        found = {r["class"]: (lines[r["class"]], r.q[1], _spread(r.q)) for r in left.collect()}
    n, q = trusted.select(F.explode("chunks").alias("c")).agg(F.count("*"), quartiles(F.col("c").cast("double"))).first()
    return Limits(found, (q[1] - BELOW * _spread(q), q[1] + ABOVE * _spread(q)) if n >= LEAST else CHUNK_BAND)


def verdict(limits: Limits) -> list[Column]:
    """bad_chunks, n_chunks and kept of a measured row (n_bytes, ratio, chunks, base_failed)."""
    fixed = F.when(F.lit(False), F.lit(None).cast("struct<low:double,high:double>"))
    for least, low, high in reversed(BANDS):
        fixed = fixed.when(F.col("n_bytes") >= least, F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))
    band = fixed
    if limits.lines:
        line = F.create_map(*[x for k, v in limits.lines.items() for x in (F.lit(k), F.struct(*[F.lit(float(y)).alias(n) for y, n in zip(v, ("slope", "middle", "spread"), strict=True)]))])
        own = F.try_element_at(line, _class())
        centre = own["middle"] + own["slope"] * F.log2(F.greatest(F.col("n_bytes"), F.lit(1)))
        band = F.coalesce(F.when(own.isNotNull(), F.struct((centre - BELOW * own["spread"]).alias("low"), (centre + ABOVE * own["spread"]).alias("high"))), fixed)
    low, high = limits.chunk
    bad = F.size(F.filter("chunks", lambda r: ~r.cast("double").between(low, high)))
    inside = F.coalesce(F.col("ratio").between(band["low"], band["high"]), F.lit(True)) & (bad <= BAD_CHUNKS * F.size("chunks"))
    return [bad.cast("long").alias("bad_chunks"), F.size("chunks").cast("long").alias("n_chunks"), (~F.col("base_failed") & inside).alias("kept")]


def rules(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, the base counts, base_failed, ratio, bad_chunks, n_chunks, kept) of each row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality: 1 for good) say which texts are trusted.
    """
    with common.scratch(docs.sparkSession) as keep, common.bounded(docs.sparkSession):
        measured = keep(common.materialize(docs.select("doc_id", measures(F.col("text")).alias("x")).select("doc_id", "x.*"), "measures"))
        trusted = measured.where(~F.col("base_failed"))
        good = None
        if labels is not None:
            said = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
            good = common.materialize(said.where((F.col("low") == 1) & (F.col("high") == 1)).select("doc_id"), "good")
        if good is not None and good.limit(1).count():
            trusted = trusted.join(good, "doc_id", "left_semi")
        limits = learn(trusted)
    counts = [f.name for f in FIELDS if f.name not in ("n_bytes", "chunks")]
    return measured.select("doc_id", *counts, *verdict(limits))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As the classifier does, labels of the held-out third are left for measuring.
    labels = common.table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != HELD_OUT)
    return rules(common.table(spark, sf_dir, "documents"), labels)
