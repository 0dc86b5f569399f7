"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct ``WIDTH``-word shingles. Minima are taken as the
threshold's ``SCHEMES`` entry says; bands of them give candidate buckets; the low two
bits of the first ``HASHES`` are packed into two bit planes, and counts of equal bits
give a similarity corrected for chance collisions. Pairs clearly under the threshold by that estimate
or by set size are dropped; the rest are confirmed by counting shared shingles.

Documents of equal sets are one class, with the smallest doc_id to stand for it. In a
bucket, every member is first paired with one centre only, so a large group costs as
many pairs as it has members; confirmed links merge into components. Only buckets that
still hold several components are then joined with themselves, in blocks of bounded
size, for pairs between different components. That leaves no link out: each pair that
shares a bucket is confirmed, refuted, or inside a component already.

The threshold is a parameter, in percent: ``PERCENT`` in op6, ``STAGE_PERCENT`` in the
pipeline's stage. Two sets at the threshold miss all buckets with probability below 1e-6,
and the one estimate that their pair goes through, that of the centres' pass or that of
the later one, drops it with at most ``LOSS``: below 2e-6 in all.

Null and empty texts have no shingles and are linked with nothing; texts under
``WIDTH`` words are one shingle. Repeated rows are one class. Rows that repeat a doc_id
with different texts are decided by their texts: each is linked as its own text is, and a
component's id is the smallest doc_id of its rows. Rows with a null doc_id are linked with
nothing, have a null component and are kept. Columns beyond doc_id and text are ignored, whatever
their names. Texts of any length are read whole, in runs of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, lgamma, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common
from pagewright.llm.components import components

WIDTH = 5
#: Thresholds of op6 and of the pipeline's stage.
PERCENT, STAGE_PERCENT = 85, 80
#: Minima of the first estimate.
HASHES = 256
#: Probability that an estimate drops a pair at the threshold.
LOSS = 1e-6
#: Minima of the second estimate.
LONG = 1024
#: Ids that may be broadcast to pick texts; beyond it texts are shuffled by id.
BROADCAST_IDS = 1_000_000
BLOCK = 2048
#: An id in more pairs than this, and in more than one of ``HOTS``, is dealt over several tasks.
HOT, HOTS = 4096, 10_000
KNOWN_WORDS = 300_000


class _Hashes(dict):
    """64-bit hashes of words, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PLACES = _mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def _family(first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Scales and shifts of ``size`` hash functions."""
    seeds = _mix(np.arange(first, first + 2 * size, dtype=np.uint64)) >> np.uint64(32)
    return (seeds[:size] | np.uint64(1)).astype(np.uint32)[:, None], seeds[size:].astype(np.uint32)[:, None]


class Scheme(NamedTuple):
    """The bands of a threshold: as many as miss a pair at it with probability below 1e-6."""

    bands: int
    rows: int
    family: tuple[np.ndarray, np.ndarray]
    scale: np.ndarray


def _scheme(bands: int, rows: int) -> Scheme:
    scale = _mix(np.arange(5000, 5000 + bands * rows, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
    return Scheme(bands, rows, _family(1000, max(HASHES, bands * rows)), scale)


LONG_FAMILY = _family(10_000, LONG)
SCHEMES = {85: _scheme(36, 7), 80: _scheme(46, 6)}


def shingles(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64) of a text."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - WIDTH + 1
    h = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        h += _mix(w[k : k + n] + PLACES[k]) * PLACES[k]
    return np.unique(_mix(h))


def minima(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    scale, shift = family
    out = np.full(len(scale), 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    step = 131_072 // len(scale)
    for lo in range(0, len(x), step):
        np.minimum(out, (x[lo : lo + step][None, :] * scale + shift).min(axis=1), out=out)
    return _mix(out.astype(np.uint64) + np.uint64(1))


def bit_planes(m: np.ndarray) -> np.ndarray:
    """The low bits of all minima, then the second lowest, packed into 64-bit words."""
    return np.packbits(np.stack([m & np.uint64(1), (m >> np.uint64(1)) & np.uint64(1)]).astype(np.uint8), axis=1).ravel().view(np.int64)


def signature(s: np.ndarray, scheme: Scheme) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Set size, two halves of the set's digest, band keys, bit planes."""
    if not len(s):
        return 0, 0, 0, np.empty(0, np.int64), np.empty(0, np.int64)
    m = minima(s, scheme.family)
    keys = _mix((m[: scheme.bands * scheme.rows].reshape(scheme.bands, scheme.rows) * scheme.scale).sum(axis=1, dtype=np.uint64)).view(np.int64)
    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return len(s), int(digest[0]), int(digest[1]), keys, bit_planes(m[:HASHES])


def _signed(text: Column, percent: int) -> Column:
    scheme = SCHEMES[percent]
    fields = pa.struct([("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for batch in batches:
            columns = list(zip(*[signature(shingles(t.as_py(), hashes), scheme) for t in batch], strict=True)) or [[]] * 5
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=list(fields))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n long, d1 long, d2 long, bands array<long>, planes array<long>")(text)


def _of_sets(text: Column, of) -> Column:
    """array<long> that ``of`` makes of each text's shingle set."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for batch in batches:
            yield pa.array([of(shingles(t.as_py(), hashes)) for t in batch], pa.list_(pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>")(text)


def of_texts(ids: DataFrame, classes: DataFrame, docs: DataFrame, of, name: str) -> DataFrame:
    """(id, s): what ``of`` makes of the sets of the classes in ``ids`` (id, distinct), each from the one row that stands for it."""
    rows = ids.join(classes.select("id", "doc_id", "t"), "id")
    rows = common.broadcast_if(rows, common.small(rows, BROADCAST_IDS))
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(rows, ["doc_id", "t"])
    return common.materialize(texts.select("id", _of_sets(F.col("text"), of).alias("s")).dropDuplicates(["id"]), name)


@cache
def least_equal(hashes: int, percent: int) -> int:
    """The most equal bit pairs to ask of ``hashes`` so that a pair at the threshold has fewer with ``LOSS`` at most (binomial tail)."""
    p = 0.25 + 0.75 * percent / 100  # two bits agree by chance in one of four cases
    least, tail = -1, 0.0
    while tail <= LOSS:
        least += 1
        tail += exp(lgamma(hashes + 1) - lgamma(least + 1) - lgamma(hashes - least + 1) + least * log(p) + (hashes - least) * log(1 - p))
    return least


def likely(a: str, b: str, hashes: int, percent: int) -> Column:
    """Whether sizes and estimate leave a link possible between rows a and b (columns n, p0, p1, ...)."""
    half = hashes // 64
    differ = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}")).bitwiseOR(F.col(f"{a}.p{i + half}").bitwiseXOR(F.col(f"{b}.p{i + half}")))) for i in range(half)), F.lit(0))
    sizes = 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return sizes & (hashes - differ >= least_equal(hashes, percent))


def _planes(column: str, hashes: int) -> list[Column]:
    return [F.col(column)[i].alias(f"p{i}") for i in range(2 * hashes // 64)]


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str, other: str, n: int, hot: int) -> DataFrame:
    """``pairs`` joined with the sets (id, s) of their ``side`` as s<side>.

    An id in more than ``hot`` pairs, and in more than one of ``HOTS``, gets its set copied to as many parts as it
    needs, and its pairs are dealt over them by ``other``. There are fewer than ``HOTS`` such ids, so they are broadcast.
    """
    many = max(hot, n // HOTS)
    if n <= many:
        return pairs.join(sets.select(F.col("id").alias(side), F.col("s").alias(f"s{side}")), side)
    parts = F.broadcast(pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > many).select(side, F.ceil(F.col("n") / many).alias("parts")))
    dealt = pairs.join(parts, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))).drop("parts")
    copies = sets.select(F.col("id").alias(side), F.col("s").alias(f"s{side}")).join(parts, side, "left")
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [side, "part"]).drop("part")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, hot: int = HOT) -> DataFrame:
    """Those of ``pairs`` (u, v: ids of classes; a written table) whose full sets meet the threshold."""
    wanted = common.materialize(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct(), "wanted")
    sets = of_texts(wanted, classes, docs, lambda s: s.view(np.int64), "sets")
    n = pairs.count()
    both = _with_sets(_with_sets(pairs, sets, "u", "v", n, hot), sets, "v", "u", n, hot)
    shared = F.size(F.array_intersect("su", "sv")).cast("long")
    whole = F.size("su") + F.size("sv")
    return both.where(100 * shared >= percent * (whole - shared)).select("u", "v")


def links(docs: DataFrame, classes: DataFrame, percent: int, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(id, component) of the classes that are linked with another; component: the smallest id of it."""
    signs = classes.select("id", "n", *_planes("planes", HASHES))
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where(F.col("centre") < F.col("last"))
    members = common.materialize(rows.join(shared.select("bucket", "centre"), "bucket"), "buckets")
    near = members.where(F.col("id") != F.col("centre")).select(F.col("id").alias("u"), F.col("centre").alias("v")).distinct()
    near = near.join(signs.alias("a"), F.col("u") == F.col("a.id")).join(signs.alias("b"), F.col("v") == F.col("b.id")).where(likely("a", "b", HASHES, percent)).select("u", "v")
    near = common.materialize(near, "near")
    linked = common.materialize(confirm(near, classes, docs, percent, hot), "linked")
    first = components(linked)

    # Buckets that still hold several components.
    own = members.select("id", "bucket", "centre").join(first, "id", "left").select("id", "bucket", "centre", F.coalesce("component", "id").alias("component"))
    mixed = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where(F.col("low") < F.col("high"))
    rest = own.join(mixed.select("bucket", "size"), "bucket")
    parts = F.ceil(F.col("size") / block)
    rest = common.materialize(rest, "mixed")
    longer = of_texts(common.materialize(rest.select("id").distinct(), "rest-ids"), classes, docs, lambda s: bit_planes(minima(s, LONG_FAMILY)), "long-planes")
    # Sizes of a link's sets are within the threshold of each other: they are in the same step of sizes or in the next.
    step = F.floor(F.log(F.col("n")) / (log(100 / percent) * (1 + 1e-9)))
    rest = rest.join(classes.select("id", "n", "bands").join(longer, "id").select("id", "n", *_planes("s", LONG), "bands"), "id").withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("parts", parts).withColumn("step", step)
    rest = common.materialize(rest, "rest")
    left = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # The second row stands in its own step and in the one below, so that one join gives pairs of both kinds.
    first_row = left.select("*", F.col("part").alias("i"), F.col("with").alias("j")).alias("a")
    second_row = left.select("*", F.col("with").alias("i"), F.col("part").alias("j"), F.explode(F.array(F.lit(0), F.lit(1))).alias("below")).withColumn("step", F.col("step") - F.col("below")).alias("b")
    same = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    other = (F.col("a.component") != F.col("b.component")) & (F.col("a.id") != F.col("b.centre")) & (F.col("b.id") != F.col("a.centre"))
    # A pair counts in the first of its common buckets; one of a step counts in one of its two orders.
    here = F.element_at(F.array_intersect("a.bands", "b.bands"), 1) == F.col("a.bucket")
    once = (F.col("b.below") == 1) | (F.col("a.i") < F.col("a.j")) | ((F.col("a.i") == F.col("a.j")) & (F.col("a.id") < F.col("b.id")))
    pairs = first_row.join(second_row, same & once & other & likely("a", "b", LONG, percent) & here).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    pairs = common.materialize(pairs, "rest-pairs")
    if not pairs.limit(1).count():
        return first
    return components(linked.union(confirm(pairs, classes, docs, percent, hot)))


def numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with an id of their own: the doc_id that stands for them, or where it stands for several classes (rows
    repeat it with different texts) a large number made of the set's digest."""
    several = common.materialize(classes.groupBy("doc_id").agg(F.count("*").alias("classes")).where(F.col("classes") > 1).select("doc_id"), "repeated-ids")
    if not several.limit(1).count():
        return classes.withColumn("id", F.col("doc_id"))
    several = common.broadcast_if(several, common.small(several, BROADCAST_IDS)).withColumn("again", F.lit(True))
    made = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("d1", "d2"), 2))
    return common.materialize(classes.join(several, "doc_id", "left").withColumn("id", F.when(F.col("again"), made).otherwise(F.col("doc_id"))).drop("again"), "numbered")


def near_dedup(docs: DataFrame, percent: int = PERCENT, hashed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text) at a threshold in ``SCHEMES``; text_hash too if asked."""
    docs = docs.select("doc_id", "text")
    with common.scratch(docs.sparkSession) as keep, common.bounded(docs.sparkSession):
        signed = docs.select("doc_id", F.xxhash64("text").alias("t"), _signed(F.col("text"), percent).alias("x")).select("doc_id", "t", "x.*")
        signed = keep(common.materialize(signed, "signatures"))
        of_class = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        # Rows of equal digests have equal sets, so any row's signature is the class's.
        classes = of_class.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "t")).alias("r"), *[F.any_value(c).alias(c) for c in ("n", "bands", "planes")])
        classes = keep(common.materialize(classes.select("d1", "d2", "r.doc_id", "r.t", "n", "bands", "planes"), "classes"))
        classes = keep(numbered(classes))
        found = links(docs, classes, percent).join(classes.select("id", "doc_id"), "id")
        found = found.join(found.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("id", "least")
        found = keep(common.materialize(found, "found"))
    component = classes.join(found, "id", "left").select("d1", "d2", F.coalesce("least", "doc_id").alias("component"))
    out = signed.select("doc_id", "t", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("d1")).alias("d1"), "d2").join(component, ["d1", "d2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *([F.col("t").alias("text_hash")] if hashed else []))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group at ``STAGE_PERCENT`` stays.

    A row with a null doc_id takes a large id made of its text, so that it is linked as
    others are. Of rows that repeat doc_id and text one stays, of null and empty texts too.
    Of rows that repeat doc_id with different texts, those whose doc_id isn't the smallest of
    their group go; the others stay.
    """
    made = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("text"), 2))
    row, text, times = (common.unused(docs, c) for c in ("_id", "_text", "_times"))
    own = docs.withColumns({row: F.coalesce("doc_id", made), text: F.xxhash64("text")})
    # The id alone doesn't name a row, so the text's hash goes with it.
    key = [row, text]
    decided = near_dedup(own.select(F.col(row).alias("doc_id"), "text"), STAGE_PERCENT, hashed=True)
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias(row), F.col("text_hash").alias(text)).distinct()
    repeated = common.materialize(own.groupBy(*key).agg(F.count("*").alias(times)).where(F.col(times) > 1).select(*key), "repeated")
    if not repeated.limit(1).count():
        return own.join(gone, key, "left_anti").select(docs.columns)
    left = common.materialize(own.join(gone, key, "left_anti"), "left")
    several = common.broadcast_if(repeated, common.small(repeated, BROADCAST_IDS))
    one = left.join(several, key, "left_semi").dropDuplicates(key)
    return left.join(several, key, "left_anti").select(docs.columns).unionByName(one.select(docs.columns))
