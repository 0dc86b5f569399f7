"""Page text indexes and substring search over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


def text_index(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) of pages (doc_id, page_no, words)."""
    return pages.select("doc_id", "page_no", T.index_text(F.col("words")).alias("text"))


HIT = "array<struct<word_idx:int,word_count:int,span_word_count:int,snippet:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


#: Characters of a snippet before the hit, and in all.
BEFORE, SHOWN = 10, 40


def within_word(query: str) -> str | None:
    """The pattern of a query that can only lie inside one word, which is searched word by word; else null."""
    cleaned, _ = T.clean_query(query)
    return None if not cleaned or T.SEPARATOR in cleaned or T.BLANK in cleaned else "(?i)" + re.sub(r"([^\w\s])", r"\\\1", cleaned)


def word_hits(words: Column, pattern: str) -> Column:
    """Hits in the words of an index text. Each word is tested once; a snippet is put together from the words about it."""

    def around(i: Column, w: Column) -> Column:
        first = F.greatest(i - BEFORE, F.lit(0))
        lead = F.length(F.array_join(F.slice(words, first + 1, i - first), T.SEPARATOR)) + F.when(i > first, 1).otherwise(0)
        near = F.array_join(F.slice(words, first + 1, i - first + SHOWN + 1), T.SEPARATOR)
        return T.shown(T.snippet(near, lead + F.regexp_instr(w, F.lit(pattern)) - 1))

    def hit(w: Column, i: Column) -> Column:
        return F.when(w.rlike(pattern), F.struct(i.cast("int").alias("word_idx"), F.lit(1).alias("word_count"), F.lit(1).alias("span_word_count"), around(i, w).alias("snippet")))

    return F.array_compact(F.transform(words, hit))


def page_hits(text: Column, query: str) -> Column:
    """Hits in one page's index text (word_idx, word_count, span_word_count, snippet), ignoring case, one a word.

    A blank in the query matches a blank inside a word or the border of two words.
    word_count takes such a query as one word; span_word_count counts what it spans. A query that lies inside a word goes
    through ``word_hits``; for others places and word numbers run along with the page's hits.
    """
    cleaned, count = T.clean_query(query)
    if not cleaned:
        return F.array().cast(HIT)
    if (inside := within_word(query)) is not None:
        return let(F.split(text, T.SEPARATOR), lambda words: word_hits(words, inside))
    literal = re.sub(r"([^\w\s⁠ ])", r"\\\1", cleaned)
    either = [literal] + ([literal.replace(T.BLANK, T.SEPARATOR)] if T.BLANK in cleaned else [])
    pattern = "(?i)(?:" + "|".join(either) + ")"
    lead = int(cleaned.startswith(T.BLANK))
    seps = lambda s: F.length(s) - F.length(F.translate(s, T.SEPARATOR, ""))

    def found(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        pairs = F.arrays_zip(F.slice(F.split(t, pattern, -1), 1, F.size(hits)).alias("before"), hits.alias("hit"))

        def step(a: Column, x: Column) -> Column:
            at, word = a["upto"] + F.length(x["before"]) + lead, a["words"] + seps(x["before"])
            span = F.lit(count) + seps(x["hit"]) - cleaned.count(T.SEPARATOR)
            # A leading blank that is a border is behind the hit's first word.
            word = word + (F.when(x["hit"].startswith(T.SEPARATOR), 1).otherwise(0) if lead else 0)
            row = F.struct(word.cast("int").alias("word_idx"), F.lit(count).alias("word_count"), span.cast("int").alias("span_word_count"), T.shown(T.snippet(t, at)).alias("snippet"))
            fresh = (F.size(a["out"]) == 0) | (a["last"] != word)
            return F.struct((a["upto"] + F.length(x["before"]) + len(cleaned)).alias("upto"), (a["words"] + seps(x["before"]) + seps(x["hit"])).alias("words"), word.alias("last"), F.when(fresh, F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"))

        none = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("words"), F.lit(-1).alias("last"), F.array().cast(HIT).alias("out"))
        return F.when(t.rlike(pattern), F.aggregate(pairs, none, step, lambda a: a["out"])).otherwise(F.array().cast(HIT))

    return let(text, found)


def search(index: DataFrame, query: str) -> DataFrame:
    """Hits (doc_id, page_no, word_idx, word_count, span_word_count, snippet) of ``page_hits`` in every page; nothing is shuffled."""
    return index.select("doc_id", "page_no", F.inline(page_hits(F.col("text"), query)))


def search_words(pages: DataFrame, query: str) -> DataFrame:
    """(doc_id, page_no, word_idx, value) of each word that a hit covers, while the page's words are at hand: no join."""

    if (inside := within_word(query)) is not None:
        hit = lambda w, i: F.when(F.translate(w, T.SEPARATOR + " ", T.BLANK * 2).rlike(inside), F.struct(i.cast("int").alias("word_idx"), w.alias("value")))
        return pages.select("doc_id", "page_no", F.inline(F.array_compact(F.transform("words", hit))))

    def covered(words: Column) -> Column:
        places = F.array_sort(F.array_distinct(F.flatten(F.transform(page_hits(T.index_text(words), query), lambda h: F.sequence(h["word_idx"], h["word_idx"] + h["span_word_count"] - 1)))))
        return F.transform(F.filter(places, lambda i: i < F.size(words)), lambda i: F.struct(i.alias("word_idx"), F.get(words, i).alias("value")))

    return pages.select("doc_id", "page_no", F.inline(let(F.col("words"), covered)))


def hit_words(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Words that each of stored hits covers: a range join of hits with words, as an equi-join on generated indexes."""
    words = pages.select("doc_id", "page_no", F.posexplode("words").alias("word_idx", "value"))
    covered = hits.select("doc_id", "page_no", F.explode(F.sequence("word_idx", F.col("word_idx") + F.col("span_word_count") - 1)).alias("word_idx")).distinct()
    return covered.join(words, ["doc_id", "page_no", "word_idx"])


def progressive(spark, folder: str, schema, query: str, checkpoint: str, sink):
    """Search pages as their files arrive; each page is searched once. Returns the streaming query."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def batch(df: DataFrame, _: int) -> None:
        sink(search(text_index(df), query))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
