"""Line dedup by distinct-site spread.

Each line of at least ``MIN_CHARS`` characters is hashed. HyperLogLog sketches of the
sites merge by aggregation per line hash. A line whose estimate is over twice
``min_sites`` is boilerplate; all others that occur often enough get exact distinct
counts of sites, as sites that share a register can make an estimate any bit too
small, but hardly too large. Of a boilerplate line, the occurrence in the row with the
smallest id (then its first line) stays in the corpus, every other is cut.

Sketches and counts combine before the shuffle, so a line that a third of all rows
share costs one row per task. Cut lines are gathered per document only. A document's
other lines keep their order; a document may end up empty.

Null texts have no lines and stay null; null sites count for nothing. Repeated rows
with equal id and text keep or lose lines together. Lines are whole strings between
line feeds, compared by 96 bits of hash. Columns beyond doc_id, text and source pass through,
whatever their names; ``mark`` must be a new name. Texts of any length are split whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common

MIN_SITES = 3
MIN_CHARS = 20
#: 128 registers.
ERROR = 0.1
LINE = ["h1", "h2"]


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, line, h1, h2, site) of each line that is long enough."""
    each = docs.select(*common.row_key(F.col("doc_id"), F.col("text")), F.col("source").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    return each.where(F.length("s") >= min_chars).select("k1", "k2", "line", F.xxhash64("s").alias("h1"), F.hash("s").alias("h2"), "site")


def boilerplate(each: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first) of lines on ``min_sites`` or more sites; first: (k1, k2, line) of the occurrence that stays."""
    place = F.struct("k1", "k2", "line")
    spread = each.groupBy(*LINE).agg(F.approx_count_distinct("site", ERROR).alias("about"), F.min(place).alias("first"), F.count("*").alias("n"))
    # As many sites need as many occurrences.
    spread = common.materialize(spread.where(F.col("n") >= min_sites), "line-spread")
    clear = spread.where(F.col("about") > 2 * min_sites)
    near = spread.where(F.col("about") <= 2 * min_sites)
    pairs = each.select(*LINE, "site").join(near.select(*LINE), LINE, "left_semi").distinct()
    exact = pairs.groupBy(*LINE).agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return clear.select(*LINE, "first").unionByName(near.join(exact, LINE, "left_semi").select(*LINE, "first"))


def cuts(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, cut): the numbers of the lines to cut from each document that has any."""
    with common.scratch(docs.sparkSession) as keep:
        each = common.materialize(lines(docs, min_chars), "lines")
        found = each.join(boilerplate(each, min_sites), LINE).where(F.struct("k1", "k2", "line") != F.col("first"))
        return keep(common.materialize(found.groupBy(*common.KEY).agg(F.collect_set("line").alias("cut")), "cuts"))


def without(text: Column, cut: Column) -> Column:
    """The text without the lines numbered in ``cut``; untouched where cut is null."""
    left = F.filter(F.split(text, "\n", -1), lambda s, i: ~F.array_contains(cut, i))
    return F.when(cut.isNull(), text).otherwise(F.array_join(left, "\n"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, mark: str = "_cut") -> DataFrame:
    """``docs`` plus ``mark`` (the numbers of the lines cut; null: none) with ``text`` cleaned."""
    k1, k2 = common.row_key(docs["doc_id"], docs["text"])
    found = cuts(docs, min_sites, min_chars)
    out = docs.join(found, (k1 == found["k1"]) & (k2 == found["k2"]), "left")
    return out.select(*[without(docs["text"], found["cut"]).alias("text") if c == "text" else docs[c] for c in docs.columns], found["cut"].alias(mark))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs = docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long"))
    out = cleaned(docs)
    n_cut = F.when(F.col("_cut").isNull(), 0).otherwise(F.size("_cut")).cast("long")
    return out.select("doc_id", "n_lines", n_cut.alias("n_cut"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose boilerplate lines; n_chars follows; documents left without any text go.

    A document goes only if lines were cut from it: its lines stay where they come first.
    """
    mark = common.unused(docs, "_cut")
    out = cleaned(docs, mark=mark)
    gone = F.col(mark).isNotNull() & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    return out.where(~gone).withColumn("n_chars", F.when(F.col(mark).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).drop(mark)


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents),
l AS (SELECT rid, doc_id, source, i AS line, s[i] AS x FROM (SELECT rid, doc_id, source, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS s FROM d WHERE text IS NOT NULL))),
e AS (SELECT * FROM l WHERE length(x) >= 20),
b AS (SELECT x, min(struct_pack(doc_id := doc_id, line := line)) AS first FROM e GROUP BY x HAVING count(DISTINCT source) >= 3),
c AS (SELECT l.rid, l.line, l.x, (b.x IS NOT NULL AND struct_pack(doc_id := l.doc_id, line := l.line) <> b.first) AS cut FROM l LEFT JOIN b ON l.x = b.x AND length(l.x) >= 20),
k AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (cut) AS n_cut, coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT cut), '') AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut, CAST(coalesce(length(kept), 0) AS BIGINT) AS n_chars_kept, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
