"""Quality score from compression: which of two zstandard dictionaries helps more.

One dictionary is trained on texts labelled good and one on texts labelled bad. A
text is cut into chunks of ``CHUNK`` bytes, each chunk is compressed with either
dictionary, and the sizes are summed over the whole text. Their difference, divided
by the text's size, goes through a logistic curve fitted on labelled texts that the
dictionaries haven't seen. Chunks let a dictionary count in every part of a long text,
where a compressor would else live on what it has read.

Fitting uses a bounded sample: ``PER_CLASS`` labelled rows of either class, of at most
``MAX_FIT_BYTES`` bytes each, chosen by a hash of doc_id. Labels are read only from
rows outside the held-out third. Scoring covers every row and every byte.

Null and empty texts, and texts of blanks, have difference 0 and get the curve's value
there. Repeated rows get equal scores. Without labels of both classes there is nothing
to learn: every score is the share of label 1 (0.5 without labels). Columns beyond
those named are ignored; labels that are null or neither 0 nor 1 aren't used, nor are those of
a doc_id that is labelled both. A label repeated for a doc_id counts once. Of rows that repeat
a chosen doc_id the smallest text is fitted on, so that the driver gets a text per chosen id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common

PER_CLASS = 1500
MAX_FIT_BYTES = 40_000
CHUNK = 2048
DICT_BYTES = 64 * 1024
LEVEL = 3
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    """Two dictionaries (none for the constant model) and the logistic curve."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scorer(self):
        """A function from text to score."""
        if not self.good:
            return lambda text: _logistic(self.intercept)
        difference = differ(self.good, self.bad)
        return lambda text: _logistic(self.slope * difference(text) + self.intercept)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _compressor(dictionary: bytes):
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False).compress


def differ(good: bytes, bad: bytes):
    """Difference of a text's sizes under the two dictionaries, per byte; positive: like the good texts."""
    by_good, by_bad = _compressor(good), _compressor(bad)

    def of(text: str | None) -> float:
        raw = (text or "").encode("utf-8", "replace")
        if not raw.strip():
            return 0.0
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        return sum([len(by_bad(p)) - len(by_good(p)) for p in parts]) / len(raw)

    return of


def _dictionary(texts: list[str]) -> bytes:
    samples = [raw[i : i + CHUNK] for t in texts if (raw := t.encode("utf-8", "replace")) for i in range(0, len(raw), CHUNK)]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the texts themselves serve
        return b"".join(samples)[-DICT_BYTES:]


def fit(good: list[str], bad: list[str], share_good: float) -> Model:
    """Dictionaries from the even places of either list, the curve from the odd ones.

    ``share_good`` is the share of label 1 among all labels; it weighs the classes.
    """
    share = min(max(share_good, 1e-3), 1 - 1e-3)
    constant = Model(b"", b"", 0.0, math.log(share / (1 - share)))
    if len(good) < 4 or len(bad) < 4 or not any(map(str.strip, good[::2])) or not any(map(str.strip, bad[::2])):
        return constant
    dictionaries = _dictionary(good[::2]), _dictionary(bad[::2])
    if not all(dictionaries):
        return constant
    of = differ(*dictionaries)
    x = np.array([of(t) for t in good[1::2]] + [of(t) for t in bad[1::2]])
    y = np.r_[np.ones(len(good[1::2])), np.zeros(len(bad[1::2]))]
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    scale = x.std() or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    w = np.array([0.0, 0.0])
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return Model(*dictionaries, float(w[0] / scale), float(w[1]))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a sample: the ``per_class`` labelled ids of either class with the smallest hash."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where(F.col("quality") == F.col("most")).drop("most")
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model(b"", b"", 0.0, 0.0)
    chosen: dict[int, int] = {}
    for label in counts:
        rows = known.where(F.col("quality") == label).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
        chosen |= {r[0]: label for r in rows}
    short = F.octet_length("text") <= MAX_FIT_BYTES
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(chosen)) & short).groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    by = {label: [t for i, t in texts if chosen[i] == label] for label in (0, 1)}
    return fit(by[1], by[0], counts.get(1, 0) / total)


def score(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for batch in batches:
            yield pa.array([of(t.as_py()) for t in batch], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text"), model) >= 0.5)
