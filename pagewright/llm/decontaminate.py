"""Benchmark decontamination as a prefix-filtered join of word windows.

An item's windows are its runs of ``WINDOW`` words, or the whole item if it is
shorter. A document holds a window only if it holds all its words, so one word is a
necessary prefix: the window's rarest by counts over all documents. Document words
join the windows on that word. Length and position bounds drop candidates whose
window would not fit at that place, and the window is compared word by word.

The index is broadcast while it has at most ``broadcast_rows`` windows of bounded size. Beyond it,
document words first pass a sieve: a bit for each hash of an indexed word, ``SIEVE`` bits in all,
so that it can be broadcast however large the index is. Those that pass keep only the ``WINDOW``
words about their place and both sides are shuffled on the word; adaptive execution splits a
common word's partition.

Null and empty texts have no words, no hits, and windows from no item. Repeated
document rows get equal results; repeated items and items of equal text each count by
item_id. Windows of null item ids hit, but no item is counted for them. An empty benchmark hits nothing. Only the
columns named are read; n_words, n_hit, n_items and items take the place of columns of those names.
Texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common

WINDOW = 10
BROADCAST_ROWS = 100_000
#: Bits of the sieve; 64 make a row.
SIEVE = 1 << 24


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(words, item_ids): each different window once, with the items that have it; none for null ids."""
    items = benchmark.select("item_id", common.alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))))
    each = items.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at") + 1, size).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))


def index(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(token, offset, words, item_ids): windows under their rarest word."""
    rows = common.materialize(windows(benchmark, size), "windows")
    vocabulary = rows.select(F.explode("words").alias("token")).distinct()
    vocabulary = common.broadcast_if(vocabulary, common.small(vocabulary, BROADCAST_ROWS))
    seen = docs.select(F.explode(common.alnum_words(F.col("text"))).alias("token"))
    counts = seen.join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    each = rows.select("words", "item_ids", F.posexplode("words").alias("offset", "token"))
    ranked = each.join(counts, "token", "left").withColumn("order", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset"))
    first = ranked.groupBy("words", "item_ids").agg(F.min("order").alias("o"))
    return common.materialize(first.select("o.token", "o.offset", "words", "item_ids"), "window-index")


def sieve(tokens: DataFrame) -> DataFrame:
    """(slot, bits): a bit for the hash of every token; at most ``SIEVE`` / 64 rows."""
    at = F.pmod(F.xxhash64("token"), F.lit(SIEVE))
    return tokens.select(F.shiftright(at, 6).alias("slot"), _bit(at).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def sieved(near: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of ``near`` whose token may be one of ``tokens``: all that are, and few others."""
    at = F.pmod(F.xxhash64("token"), F.lit(SIEVE))
    held = near.withColumn("slot", F.shiftright(at, 6)).join(F.broadcast(sieve(tokens)), "slot")
    return held.where(F.col("bits").bitwiseAND(_bit(at)) != 0).drop("slot", "bits")


def matches(docs: DataFrame, windows: DataFrame, size: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(k1, k2, start, end, item_ids) of each window found in a document; words from 0, end exclusive."""
    keyed = docs.select(*common.row_key(F.col("doc_id"), F.col("text")), common.alnum_words(F.col("text")).alias("w"))
    start, length = F.col("pos") - F.col("offset"), F.size("words")
    near = keyed.select("k1", "k2", "w", F.posexplode("w").alias("pos", "token"))
    if common.small(windows, broadcast_rows):
        near = near.withColumn("from", F.lit(0))
        windows = F.broadcast(windows)
    else:
        low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        near = sieved(near, windows.select("token")).select("k1", "k2", "token", "pos", low.alias("from"), F.slice("w", low + 1, F.col("pos") - low + size).alias("w"))
    fits = (start >= F.col("from")) & (start - F.col("from") + length <= F.size("w"))
    found = near.join(windows, "token").where(fits & (F.slice("w", start - F.col("from") + 1, length) == F.col("words")))
    return found.select("k1", "k2", start.alias("start"), (start + length).alias("end"), "item_ids")


def hits(found: DataFrame) -> DataFrame:
    """Per document: words inside any match (union of the spans), and the items."""
    per = found.groupBy(*common.KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.flatten(F.collect_set("item_ids")).alias("items"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("spans", none, lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")))
    items = F.array_sort(F.array_distinct("items"))
    return per.select(*common.KEY, covered["n"].cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items and items (sorted array of item ids as text)."""
    found = hits(matches(docs, index(docs, benchmark, size), size, broadcast_rows))
    k1, k2 = common.row_key(docs["doc_id"], docs["text"])
    out = docs.join(found, (k1 == found["k1"]) & (k2 == found["k2"]), "left")
    extra = (F.size(common.alnum_words(docs["text"])).cast("long").alias("n_words"), F.coalesce(found["n_hit"], F.lit(0)).cast("long").alias("n_hit"), F.coalesce(found["n_items"], F.lit(0)).cast("long").alias("n_items"), F.coalesce(found["items"], F.array().cast("array<string>")).alias("items"))
    return out.select(*[docs[c] for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items")], *extra)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(matches(docs, index(docs, common.table(spark, sf_dir, "benchmark"))))
    own = docs.select("doc_id", *common.row_key(F.col("doc_id"), F.col("text")), F.size(common.alnum_words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce(F.array_join("items", ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return own.join(found, common.KEY, "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go."""
    found = matches(docs, index(docs, common.table(spark, sf_dir, "benchmark"))).select(*common.KEY).distinct()
    k1, k2 = common.row_key(docs["doc_id"], docs["text"])
    return docs.join(found, (k1 == found["k1"]) & (k2 == found["k2"]), "left_anti")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, len(w[s + 1:s + 10]) AS n, array_to_string(w[s + 1:s + 10], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, s, n, array_to_string(w[s + 1:s + n], ' ') AS win
    FROM (SELECT rid, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, ns)),
m AS (SELECT rid, s, iw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM m)) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""
