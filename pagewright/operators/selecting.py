"""The state of a text selection as pointer events come in, and what it selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = -1


def letter_at(place: Column, inside: Column, cuts: Column, width: Column) -> Column:
    """Struct letter, offset of a pointer over a word: ``place`` is its foot on the base line (0 at the start, 1 at the end).

    ``cuts`` are the ends of all letters but the last, from the word's start. Inside the word's box the letter is the first whose
    end isn't before the pointer, outside the one whose end is nearest (the first of equals). The offset is the place less the
    end of the letter before. A word without letters has -1, one with a single letter its place.
    """
    n = F.size(cuts)
    shares = F.transform(cuts, lambda c: c / width)
    over = F.array_position(F.transform(shares, lambda c: place <= c), F.lit(True)).cast("int") - 1
    within = F.when(over >= 0, over).otherwise(n)
    gaps = F.transform(F.concat(shares, F.array(F.lit(1.0))), lambda c: F.abs(place - c))
    near = F.array_position(gaps, F.array_min(gaps)).cast("int") - 1
    letter = F.when(n == 0, 0).when(inside, within).otherwise(near)
    offset = F.when(letter == 0, place).otherwise(place - F.get(cuts, letter - 1))
    return F.struct(letter.cast("int").alias("letter"), offset.alias("offset"))


def states(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``events`` plus the selection after each, one selection for each of ``by``.

    Events have kind (start, extend, reset; others change nothing), page (from 1), word (its index in the page, null for none) and letter (null: the
    whole word). Added: anchor_ and focus_ page, word and letter (-1, null, -1 where there is none), is_backward, is_valid, is_selecting,
    and focus_left: the page that the focus left at this event, else null.

    A start moves the anchor only, a reset clears both ends; the direction is told anew at each extension of a valid selection and stays
    until the next. Each end is the last event of its kind since the last reset, so that windows take the place of a state that is passed on.
    """
    whole = Window.partitionBy(*by).orderBy(*order)
    since = Window.partitionBy(*by, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kind = F.coalesce(F.col("kind"), F.lit(""))
    page = F.when(kind.isin("start", "extend") & (F.coalesce("page", F.lit(0)) <= 0), F.raise_error(F.lit("a page's number is at least 1")).cast("int")).otherwise(F.col("page").cast("int"))
    point = F.struct(page.alias("page"), F.col("word").alias("word"), F.coalesce(F.col("letter").cast("int"), F.lit(NONE)).alias("letter"))
    held = events.withColumn("_epoch", F.count(F.when(kind == "reset", 1)).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    ends = held.withColumns({"_anchor": F.last(F.when(kind == "start", point), ignorenulls=True).over(since), "_focus": F.last(F.when(kind == "extend", point), ignorenulls=True).over(since)})
    a, f = F.col("_anchor"), F.col("_focus")
    valid = a["word"].isNotNull() & f["word"].isNotNull()
    same = (a["page"] == f["page"]) & (a["word"] == f["word"])
    turned = F.when(a["page"] != f["page"], a["page"] > f["page"]).when(same, a["letter"] > f["letter"]).otherwise(a["word"] > f["word"])
    told = ends.withColumn("_told", F.when((kind == "extend") & valid, turned))
    backward = F.coalesce(F.last("_told", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    before = F.coalesce(F.lag(f["page"]).over(Window.partitionBy(*by, "_epoch").orderBy(*order)), F.lit(NONE))
    added = {f"{end}_{part}": F.coalesce(x[part], F.lit(NONE)) if part != "word" else x[part] for end, x in (("anchor", a), ("focus", f)) for part in ("page", "word", "letter")}
    flags = {"is_backward": backward, "is_valid": valid, "is_selecting": F.coalesce(valid & (~same | ((a["letter"] != NONE) & (f["letter"] != NONE))), F.lit(False)), "focus_left": F.when((kind == "extend") & (before != f["page"]), before)}
    return told.withColumns({**added, **flags, "is_valid": F.coalesce(valid, F.lit(False))}).drop("_epoch", "_anchor", "_focus", "_told")


def is_word_selected(page: Column, word: Column) -> Column:
    """Whether a word lies in the selection that a row of ``states`` describes. Only indexes in the page are compared, on middle pages, too."""
    back = F.col("is_backward")
    first = lambda of: F.when(back, F.col(f"focus_{of}")).otherwise(F.col(f"anchor_{of}"))
    last = lambda of: F.when(back, F.col(f"anchor_{of}")).otherwise(F.col(f"focus_{of}"))
    return F.coalesce(F.col("is_valid") & page.between(first("page"), last("page")) & word.between(first("word"), last("word")), F.lit(False))


def words_at(asked: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """``asked`` (by, word_idx) with the word (by, word_idx, value) of that index; an index without a word is an error, as it is to a reader of the page."""
    found = asked.join(words.select(*by, "word_idx", "value", F.lit(True).alias("_found")), [*by, "word_idx"], "left")
    missing = F.raise_error(F.concat(F.lit("no word at index "), F.col("word_idx").cast("string"))).cast("string")
    return found.withColumn("value", F.when(F.col("_found"), F.col("value")).otherwise(missing)).drop("_found")
