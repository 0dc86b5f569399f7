"""Toxicity score: a logistic classifier that may not change when a group's name is swapped.

A text is seen as rates of its words and of their first 4 to 8 characters. A feature's value
is log(1 + 200 c / (n + 50)) of its count c in n words, over the whole text. Features are those
whose mean differs most between the classes. The classifier is fitted by Newton's method on
the weighted log loss plus two penalties: a ridge, and for every labelled sentence that names a
group (``GROUPS``) the squared change of its logit when the name is swapped for each other name of
its kind. A group that is often insulted in the labelled texts hence lends no weight of its own
to a neutral mention.

Fitting uses a bounded sample: ``PER_CLASS`` labelled ids of either class, chosen by a hash of
doc_id, with texts of at most ``MAX_FIT_BYTES`` bytes, and at most ``MAX_PAIRS`` swapped sentences.
Labels are read only from rows outside the held-out third. Scoring covers every row, every word.

Null and empty texts, and texts without words, have no features and get the intercept's score.
Repeated rows get equal scores. Without labels of both classes there is nothing to learn: every
score is the share of label 1 (0 without labels, as nothing is known to be toxic). Columns beyond those
named are ignored; labels that are null or neither 0 nor 1 aren't used, nor are those of a doc_id
that is labelled both. Of rows that repeat a chosen doc_id the smallest text is fitted on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common
from pagewright.llm.quality_classifier import HELD_OUT, fold

PER_CLASS = 2000
MAX_FIT_BYTES = 20_000
MAX_PAIRS = 4000
MAX_FEATURES = 600
#: Least difference of class means, in standard errors, that makes a feature.
LEAST_Z = 3.5
SPACE = 1 << 20
RIDGE, SWAP = 1e-4, 1.0
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Names of groups by kind; a name is swapped for the others of its row.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian"), ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés", "immigrés"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados", "inmigrantes"),
)


def marks(word: str) -> list[int]:
    """Places in the hashed space of a word and of its beginnings."""
    return [zlib.crc32(x.encode("utf-8", "replace")) % SPACE for x in dict.fromkeys([f"^{word}$", *(f"^{word[:k]}" for k in range(4, min(len(word), 8) + 1))])]


def rates(words: Counter, places) -> dict[int, float]:
    """Features of a text given as counts of words; ``places`` gives a word's."""
    found: dict[int, int] = {}
    for word, n in words.items():
        for p in places(word):
            found[p] = found.get(p, 0) + n
    total = sum(words.values()) + 50
    return {p: math.log1p(200 * n / total) for p, n in found.items()}


def counted(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class Model:
    """Weights of the chosen places and the intercept."""

    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = -30.0

    def scorer(self):
        """A function from text to score."""
        weights = self.weights
        places = lru_cache(1 << 16)(lambda word: [p for p in marks(word) if p in weights])

        def of(text: str | None) -> float:
            logit = self.intercept + sum(weights[p] * x for p, x in rates(counted(text), places).items())
            return 1 / (1 + math.exp(-min(max(logit, -30.0), 30.0)))

        return of


def swaps(text: str, groups: Iterable[tuple[str, ...]] = GROUPS) -> Iterator[tuple[Counter, Counter]]:
    """Each sentence that names a group, and the same with the name swapped for each other of its kind."""
    others = {name: [o for o in group if o != name] for group in groups for name in group}
    for sentence in SENTENCE.findall(text.lower()):
        words = Counter(WORD.findall(sentence))
        for name in [w for w in words if w in others]:
            for other in others[name]:
                changed = words.copy()
                changed[other] += changed.pop(name)
                yield words, changed


def fit(toxic: list[str], neutral: list[str], share: float, groups: Iterable[tuple[str, ...]] = GROUPS, swap: float = SWAP) -> Model:
    """Fit on the texts of both classes; ``share``, of label 1 among all labels, weighs the classes."""
    if not toxic or not neutral:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model({}, float(np.log(p / (1 - p)))) if toxic or neutral else Model()
    share = min(max(share, 1e-3), 1 - 1e-3)
    texts, y = [*toxic, *neutral], np.r_[np.ones(len(toxic)), np.zeros(len(neutral))]
    places = lru_cache(1 << 16)(marks)
    found = [(np.fromiter(x, np.int32, len(x)), np.fromiter(x.values(), np.float32, len(x))) for x in (rates(counted(t), places) for t in texts)]
    row = np.repeat(np.arange(len(found), dtype=np.int32), [len(p) for p, _ in found])
    col, val = np.concatenate([p for p, _ in found]), np.concatenate([v for _, v in found]).astype(np.float64)
    del found
    one = y[row] == 1
    sums = [np.bincount(col[m], val[m], SPACE) for m in (one, ~one)]
    spread = np.bincount(col, val**2, SPACE) / len(y)
    z = (sums[0] / len(toxic) - sums[1] / len(neutral)) / np.sqrt(spread * (1 / len(toxic) + 1 / len(neutral)) + 1e-6)
    chosen = np.argsort(-np.abs(z), kind="stable")[:MAX_FEATURES]
    chosen = np.sort(chosen[np.abs(z[chosen]) >= LEAST_Z])
    at = np.full(SPACE, -1)
    at[chosen] = np.arange(len(chosen))

    def dense(rows, cols, values, n):
        out = np.zeros((n, len(chosen) + 1))
        held = at[cols] >= 0
        out[rows[held], at[cols[held]]] = values[held]
        return out

    a = dense(row, col, val, len(y))
    a[:, -1] = 1
    curve = np.diag(np.r_[np.full(len(chosen), RIDGE), 1e-9])
    pairs = []
    for text in texts:
        for pair in swaps(text, groups):
            if len(pairs) < MAX_PAIRS:
                pairs.append(pair)
    if pairs:
        change = np.zeros((len(pairs), len(chosen) + 1))
        for i, (before, after) in enumerate(pairs):
            for sign, words in ((1, before), (-1, after)):
                for p, v in rates(words, places).items():
                    if at[p] >= 0:
                        change[i, at[p]] += sign * v
        curve += swap * change.T @ change / len(pairs)
    weight = np.where(y == 1, share / len(toxic), (1 - share) / len(neutral))
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(share / (1 - share))
    loss = lambda w: weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ w)) + w @ curve @ w / 2
    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + curve @ w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + curve + 1e-9 * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-10:
            break
    return Model(dict(zip(chosen.tolist(), w[:-1].tolist(), strict=True)), float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a sample: the ``per_class`` labelled ids of either class with the smallest hash."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where(F.col("toxic") == F.col("most")).drop("most")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = {r[0]: label for label in counts for r in known.where(F.col("toxic") == label).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()}
    if not chosen:
        return Model()
    short = F.octet_length("text") <= MAX_FIT_BYTES
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(chosen)) & short).groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    by = {label: [t for i, t in texts if chosen[i] == label] for label in (0, 1)}
    return fit(by[1], by[0], counts.get(1, 0) / sum(counts.values()))


def score(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for batch in batches:
            yield pa.array([of(t.as_py()) for t in batch], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
