"""Personal data by patterns, and by contexts that are bootstrapped from what they find.

Base spans come from four expressions with checks: email, ip, card, phone. They, and a
list of identifiers that are known already (leaked secrets, say), seed a graph: a mention
(base span, other run of identifier characters with a digit or an @, or groups of digits
with single blanks, hyphens or brackets between them) is linked with the lexical
patterns of its left context, one to three words.

Patterns and instances are scored in ``ROUNDS`` rounds of joins and aggregations. A
pattern's instances of a kind count for it with their scores, those that can't be of the
kind (by shape, or as seeds of another) against it, and those not scored yet a little
against it (``UNSURE`` each); one more counts against every pattern, so that few
instances don't make a sure one. An instance's score is 1 for seeds, else that one of its
accepted patterns is right (noisy or). Patterns of enough support and confidence then mark
mentions of the kind's shape as further spans. Base spans always stay, and known
identifiers are spans wherever they stand.

The text is scanned once; what it gives (spans, mentions, contexts) is written as a
table, and all further steps read that. Graph edges are distinct (pattern, instance)
pairs, counted before they are shuffled; accepted patterns are broadcast only while
they are few and small.

Null and empty texts have no spans. Repeated rows get equal results. Columns beyond doc_id
and text are ignored, whatever their names. Texts of any length are scanned whole: the
expressions are anchored or possessive, so that long runs cost linear time, and offsets and
overlaps of n matches are worked out in blocks of about the root of n. Offsets are code
points from 0, end exclusive. Two limits bound what the method can learn, not what the base finds: a context is the
last ``CONTEXT`` (48) code points before a mention, and a mention of a secret has 20 to 128 characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Kinds that have no expression of their own: only known identifiers seed them.
KNOWN_KINDS = ("secret",)
#: The same matches as the plain expressions: a start inside a run can match only if the run's start does,
#: so that runs are entered at their start (or where the match before ended) and never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
RUN = "A-Za-z0-9._%+@-"
MENTION = rf"(?<![{RUN}])(?:[A-Za-z._%+@-]*+[0-9][{RUN}]*+|[A-Za-z._%+-]*+@[{RUN}]*+)"
GROUP = r"[0-9]++(?![A-Za-z_%+@]|[.-][A-Za-z]|\.[0-9])"
#: Groups of digits, all that follow each other; those without a blank or bracket are runs anyway.
SPACED = rf"(?<![{RUN}])\+?\(?{GROUP}(?:(?:\)[\x20-]?|\x20\(|[\x20-]){GROUP})++"
#: What an instance of a kind must look like to be discovered.
SHAPES = {"email": r"[A-Za-z0-9]@[A-Za-z0-9]", "ip": r"^[0-9]+(\.[0-9]+){3}$", "card": r"^([0-9][\x20-]?){12,19}$", "phone": r"^\+?\(?[0-9][\x20()0-9.-]{6,18}$", "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9._+%-]{20,128}$"}
MIN_MENTION = 6
CONTEXT = 48
ORDERS = 3
ROUNDS = 3
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
UNSURE = 0.1
BROADCAST_ROWS = 20_000
SPAN = "array<struct<start:int,end:int,surface:string,left:string>>"
MORE = "array<struct<kind:string,start:int,end:int>>"
#: The tables hold no list of leaked secrets: two of three distinct runs of 40 hexadecimal digits stand for it, by hash.
DEMO_SECRET, DEMO_PARTS = r"^[0-9A-Fa-f]{40}$", 3


def _offsets(lengths: Column, width: Column) -> Column:
    """Where each block of ``width`` lengths begins: the sum of all before it."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    return common.let(F.transform(blocks, lambda b: total(F.slice(lengths, b * width + 1, width))), lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, 1, b))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, surface, left>> of the leftmost non-overlapping matches; left: the text just before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"))

    def placed(x: Column) -> Column:
        def span(p: Column, i: Column) -> Column:
            block = F.floor(i / x["width"]).cast("int")
            before = F.aggregate(F.slice(x["lengths"], block * x["width"] + 1, i % x["width"]), F.lit(0), lambda a, n: a + n)
            start = F.get(x["offsets"], block) + before + F.char_length(p["between"])
            last = F.coalesce(F.get(x["pairs"], i - 1)["found"], F.lit(""))
            left = F.right(F.concat(last, p["between"]), F.lit(CONTEXT))
            return F.struct(start.alias("start"), (start + F.char_length(p["found"])).alias("end"), p["found"].alias("surface"), left.alias("left"))

        return F.transform(x["pairs"], span)

    def measured(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.char_length(x["between"]) + F.char_length(x["found"]))
        width = F.ceil(F.sqrt(F.size(p))).cast("int")
        whole = common.let(F.struct(lengths.alias("lengths"), width.alias("width"), p.alias("pairs")), lambda x: common.let(F.struct(x["lengths"].alias("lengths"), x["width"].alias("width"), x["pairs"].alias("pairs"), _offsets(x["lengths"], x["width"]).alias("offsets")), placed))
        return F.when(F.size(p) > 0, whole).otherwise(F.array().cast(SPAN))

    return common.let(pairs, measured)


def luhn(digits: Column) -> Column:
    def weight(i: Column) -> Column:
        d = F.substring(digits, -i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)))
    return F.aggregate(F.transform(places, lambda i: F.coalesce(weight(i), F.lit(0))), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, surface: Column) -> Column:
    digits = F.regexp_replace(surface, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return surface.rlike(rf"^{PART}(\.{PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    may = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
    may = may & text.rlike("[0-9]") if kind != "email" else may
    kept = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["surface"]))
    return F.when(may, kept).otherwise(F.array().cast(SPAN))


def apart(mentions: Column, spans: Column) -> Column:
    """Those of ``mentions`` that overlap none of ``spans`` (both with start and end).

    Spans are dealt over cells of the text, about the root of the number of mentions, so that a mention is held
    against the spans of its cells only.
    """

    def free(x: Column) -> Column:
        reach = F.array_max(F.transform(x["spans"], lambda s: s["end"])) + 1
        cell = F.ceil(reach / F.ceil(F.sqrt(F.size(x["mentions"])))).cast("int")

        def kept(y: Column) -> Column:
            def clear(m: Column) -> Column:
                near = F.flatten(F.slice(y["cells"], F.floor(m["start"] / y["cell"]).cast("int") + 1, F.floor((m["end"] - 1) / y["cell"]).cast("int") - F.floor(m["start"] / y["cell"]).cast("int") + 1))
                return ~F.exists(near, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))

            return F.filter(y["mentions"], clear)

        cells = common.let(F.struct(x["spans"].alias("spans"), cell.alias("cell"), reach.alias("reach")), lambda z: F.transform(F.sequence(F.lit(0), F.floor(z["reach"] / z["cell"]).cast("int")), lambda c: F.filter(z["spans"], lambda s: (s["start"] < (c + 1) * z["cell"]) & (s["end"] > c * z["cell"]))))
        return common.let(F.struct(x["mentions"].alias("mentions"), cell.alias("cell"), cells.alias("cells")), kept)

    both = F.struct(mentions.alias("mentions"), spans.alias("spans"))
    return common.let(both, lambda x: F.when((F.size(x["spans"]) == 0) | (F.size(x["mentions"]) == 0), x["mentions"]).otherwise(free(x)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, one column of spans per kind, other): other: mentions that overlap no base span."""
    own = docs.select("doc_id", *common.row_key(F.col("doc_id"), F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast(SPAN)
    runs = F.when(F.col("text").rlike("[0-9@]"), matches(F.col("text"), MENTION)).otherwise(none)
    spaced = F.when(F.col("text").rlike(r"[0-9)][\x20()]+[0-9]"), F.filter(matches(F.col("text"), SPACED), lambda m: m["surface"].rlike(r"[\x20()]"))).otherwise(none)
    every = F.filter(F.concat(runs, spaced), lambda m: F.char_length(m["surface"]) >= MIN_MENTION)

    def free(x: Column) -> Column:
        ends = F.transform(F.concat(*[x[k] for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(*[x[k].alias(k) for k in KINDS], apart(x["every"], ends).alias("other"))

    # All of a row's spans are worked out once, whichever of them is asked for.
    found = common.let(F.struct(*[base_spans(F.col("text"), k).alias(k) for k in KINDS], every.alias("every")), free)
    return own.select("doc_id", "k1", "k2", found.alias("x")).select("doc_id", "k1", "k2", "x.*")


def contexts(left: Column) -> Column:
    """The last one to ``ORDERS`` words before a mention, in lower case, digits as 0; fewer at the text's start."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(left), "[0-9]", "0"), common.SPACE_GAP, -1), "")
    # The first word may have been cut.
    words = F.when(F.char_length(left) >= CONTEXT, F.slice(words, 2, CONTEXT)).otherwise(words)
    each = F.transform(F.sequence(F.lit(1), F.lit(ORDERS)), lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " ")))
    return F.array_compact(each)


def mentions(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(k1, k2, kind, start, end, surface, pattern): a row per mention and pattern; kind is null for others than seeds.

    pattern is null in the one row of a mention without a word before it.
    """
    parts = [found.select("k1", "k2", F.lit(k if k in KINDS else None).cast("string").alias("kind"), F.inline(k)) for k in (*KINDS, "other")]
    each = reduce(DataFrame.unionByName, parts)
    if known is not None:
        known = known.where(F.col("surface").isNotNull() & F.col("kind").isin(*KINDS, *KNOWN_KINDS)).groupBy("surface").agg(F.min("kind").alias("held"))
        each = each.join(common.broadcast_if(known, common.small(known, BROADCAST_ROWS)), "surface", "left").withColumn("kind", F.coalesce("kind", "held"))
    return each.select("k1", "k2", "kind", "start", "end", "surface", F.explode_outer(contexts(F.col("left"))).alias("pattern"))


def _could(kind: str) -> Column:
    """Whether an instance (surface, kind: null or what it seeds) can be of ``kind``."""
    return F.when(F.col("kind").isNull(), F.col("surface").rlike(SHAPES[kind])).otherwise(F.col("kind") == kind)


def bootstrap(each: DataFrame, rounds: int = ROUNDS, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (pattern, kind, confidence) and scores of instances (surface, kind, score)."""
    with common.scratch(each.sparkSession) as keep:
        seeds = each.where("kind IS NOT NULL").groupBy("surface").agg(F.max("kind").alias("kind"))
        seeds = common.materialize(seeds.withColumn("score", F.lit(1.0)), "seeds")
        pairs = each.where("pattern IS NOT NULL").select("pattern", "surface").distinct()
        edges = common.materialize(pairs.join(seeds.select("surface", "kind"), "surface", "left"), "edges")
        kinds = (*KINDS, *KNOWN_KINDS)
        able = edges.groupBy("pattern").agg(F.count("*").alias("size"), *[F.count_if(_could(k)).alias(k) for k in kinds])
        able = able.select("pattern", "size", F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("kind", "able")).where("able > 0")
        able = common.materialize(able, "able")
        scores, patterns = seeds, None
        for _ in range(rounds):
            scored = edges.select("pattern", "surface").join(scores, "surface")
            sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("n")).where(F.col("n") >= support)
            against = (F.col("size") - F.col("able")) + UNSURE * (F.col("able") - F.col("n")) + 1
            patterns = sums.join(able, ["pattern", "kind"]).select("pattern", "kind", (F.col("sum") / (F.col("sum") + against)).alias("confidence")).where(F.col("confidence") >= confidence)
            patterns = common.materialize(patterns, "patterns")
            few = common.small(patterns, BROADCAST_ROWS)
            reached = edges.where("kind IS NULL").select("pattern", "surface").join(common.broadcast_if(patterns, few), "pattern")
            shape = reduce(lambda a, k: a.when(F.col("kind") == k, F.col("surface").rlike(SHAPES[k])), kinds, F).otherwise(False)
            guess = reached.where(shape).groupBy("surface", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
            scores = common.materialize(seeds.unionByName(guess), "scores")
        return keep(patterns), keep(scores)


def discover(each: DataFrame, patterns: DataFrame, scores: DataFrame, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(k1, k2, kind, start, end) of mentions that accepted patterns mark."""
    others = each.where("kind IS NULL").drop("kind")
    marked = others.join(common.broadcast_if(patterns, common.small(patterns, BROADCAST_ROWS)), "pattern")
    # Scores of others than seeds are of the kind's shape.
    sure = marked.join(scores.where(F.col("score") >= confidence), ["surface", "kind"])
    return sure.select("k1", "k2", "kind", "start", "end").distinct()


def _listed(column: Column, kind: str) -> Column:
    return F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame, known=None) -> DataFrame:
    """(doc_id, a column of base spans per kind, more): more: array<struct<kind, start, end>> of further spans, or null.

    ``known``: identifiers that are known already (surface, kind: of ``KINDS`` or ``KNOWN_KINDS``), or a function that
    makes them of what ``scan`` found.
    """
    with common.scratch(docs.sparkSession) as keep:
        found = keep(common.materialize(scan(docs), "spans"))
        each = common.materialize(mentions(found, known(found) if callable(known) else known), "mentions")
        patterns, scores = bootstrap(each)
        named = each.where(F.col("kind").isin(*KNOWN_KINDS)).select("k1", "k2", "kind", "start", "end")
        base = reduce(DataFrame.unionByName, [found.select("k1", "k2", F.lit(k).alias("kind"), F.inline(k)).select("k1", "k2", "kind", "start", "end") for k in KINDS])
        listed = each.where(F.col("kind").isin(*KINDS)).select("k1", "k2", "kind", "start", "end").join(base, ["k1", "k2", "kind", "start", "end"], "left_anti") if known is not None else named.limit(0)
        more = longest(discover(each, patterns, scores).unionByName(named).unionByName(listed))
        more = more.groupBy(*common.KEY).agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("more"))
        more = keep(common.materialize(more, "more-spans"))
    return found.drop("other").join(more, common.KEY, "left")


def longest(spans: DataFrame) -> DataFrame:
    """``spans`` (k1, k2, kind, start, end), distinct, without those that are part of a longer one of their kind."""
    # A span's holders come before it in this order.
    before = Window.partitionBy(*common.KEY, "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    held = spans.distinct().withColumn("reach", F.max("end").over(before))
    return held.where(F.col("reach").isNull() | (F.col("reach") < F.col("end"))).drop("reach")


def demo_known(found: DataFrame) -> DataFrame:
    """Stands for a list of leaked secrets, see ``DEMO_SECRET``; the others are left for patterns to find."""
    runs = found.select(F.explode("other.surface").alias("surface")).where(F.col("surface").rlike(DEMO_SECRET) & (F.pmod(F.xxhash64(F.lower("surface")), F.lit(DEMO_PARTS)) != 0))
    return runs.distinct().select("surface", F.lit("secret").alias("kind"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), demo_known)
    base = F.array_join(F.concat(*[_listed(F.col(k), k) for k in KINDS]), ",")
    found = found.withColumn("more", F.coalesce("more", F.array().cast(MORE)))

    def every(kind: str) -> Column:
        new = F.transform(F.filter("more", lambda m: m["kind"] == kind), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
        if kind not in KINDS:
            return _listed(new, kind)
        own = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return _listed(F.array_sort(F.concat(own, new)), kind)

    spans = F.array_join(F.concat(*[every(k) for k in (*KINDS, *KNOWN_KINDS)]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    n_secret = F.size(F.filter("more", lambda m: m["kind"] == "secret")).cast("long")
    n_found = sum((F.size(k) for k in KINDS), F.size("more")).cast("long")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), n_secret.alias("n_secret"), n_found.alias("n_found"))
