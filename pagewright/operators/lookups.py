"""Lookups, anti joins and ordered gathers of the document model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import model as M
from pagewright.functions import text as T
from pagewright.operators import relations


def gathered(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """(by, out): each group's values as an array in ``order``."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"]).alias(out))


def with_default(left: DataFrame, right: DataFrame, by: list[str], value: str, default: Column) -> DataFrame:
    """``left`` plus ``value`` of the matching right row, else ``default``."""
    return left.join(right.select(*by, value), by, "left").withColumn(value, F.coalesce(value, default))


def not_reported(pages: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    return pages.join(done.select(*by), by, "left_anti")


def cached_range(lows: DataFrame, held: DataFrame, by: list[str], value: str) -> DataFrame:
    """A row for each number of each range (by, low, high), ``value`` null where ``held`` (by, place, value) has none."""
    wanted = lows.select(*by, F.explode(F.sequence("low", "high")).alias("place"))
    return wanted.join(held.select(*by, "place", value), [*by, "place"], "left")


def without_rows(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows for which ``gone`` doesn't hold; null counts as not gone."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def page_of(pages: DataFrame, number: Column, count: Column) -> DataFrame:
    """The page of a number from 1 to ``count``; another number raises an error."""
    checked = F.when(number.between(1, count), number).otherwise(F.raise_error(F.concat(F.lit("no page "), number.cast("string"))).cast("int"))
    return pages.where(F.col("page_no") == checked)


def pages_asked(asked: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """``asked`` (by, number) with the page of that number, counted from 1, of ``pages`` (by, page_no and more); problem says what is wrong with a number that none has.

    For many requests at once, where ``page_of`` would stop at the first wrong one.
    """
    rest = [c for c in pages.columns if c not in (*by, "page_no")]
    found = asked.join(pages.select(*by, F.col("page_no").alias("number"), *rest, F.lit(True).alias("_found")), [*by, "number"], "left")
    return found.withColumn("problem", F.when(F.col("_found").isNull(), F.concat(F.lit("no page "), F.coalesce(F.col("number").cast("string"), F.lit("null"))))).drop("_found")


def line_of_words(words: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """``words`` (by, word_idx) with the columns of the line that holds them, of ``lines`` (by, first_word, past and more); null where none does.

    A range join as an equi-join on the words that each line names, so that as many rows go through it as there are words in lines. They are sorted, never
    broadcast: Spark's estimate of their size is that of the lines.
    """
    named = lines.where("past > first_word").withColumn("word_idx", F.explode(F.sequence("first_word", F.col("past") - 1))).drop("first_word", "past")
    return words.join(named.hint("merge"), [*by, "word_idx"], "left")


def one_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*by, "_x.*")


def active_bookmark(views: DataFrame, bookmarks: DataFrame, by: list[str]) -> DataFrame:
    """``views`` (by, page, offset, rotation) plus active: the title of the bookmark that a scroll position is at, or null.

    On the view's page the one nearest to the offset counts (the first of equals; the only or, on a page turned
    sideways, the first one as it is); without one, the last of the closest earlier page. ``bookmarks`` (by, page,
    ord, title, y: from the page's lower edge) and the pages' ``height`` in ``views``. A negative offset lies on the page
    before, whose height is ``height_before``. The bookmarks of a page meet in one array.
    """
    up = (F.col("offset") < 0) & (F.col("page") > 1)
    at = views.withColumns({"_page": F.when(up, F.col("page") - 1).otherwise(F.col("page")), "_y": F.when(up, F.col("offset") + F.col("height_before")).otherwise(F.col("offset"))})
    pages = bookmarks.groupBy(*by, "page").agg(F.array_sort(F.collect_list(F.struct("ord", "title", F.coalesce("y", F.lit(0.0)).alias("y")))).alias("marks"))
    held = relations.as_of(at, pages.select(*by, F.col("page").alias("_since"), F.struct("page", "marks").alias("_marks")), by, "_page", "_since", "_marks")
    marks = F.col("_marks.marks")
    target = lambda m: F.when(F.col("rotation") == 180, m["y"]).otherwise(F.col("height") - m["y"])
    nearest = F.array_min(F.transform(marks, lambda m, i: F.struct(F.abs(F.col("_y") - target(m)).alias("d"), i.alias("i"), m["title"].alias("title"))))["title"]
    first = F.get(marks, F.lit(0))["title"]
    here = F.when((F.size(marks) == 1) | F.col("rotation").isin(90, 270), first).otherwise(nearest)
    active = F.when(F.col("_marks").isNull(), F.lit(None)).when(F.col("_marks.page") == F.col("_page"), here).otherwise(F.element_at(marks, -1)["title"])
    return held.withColumn("active", active).drop("_page", "_y", "_marks")


def selection_text(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, text) of selected words (by, page_no, word_idx, line_idx, value): words put together as they are read.

    Empty words count for nothing. A word that ends in a hyphen or connector at the end of a line loses it and is
    joined with the next line's first word; elsewhere a blank goes between words that punctuation doesn't join. One
    trailing blank goes. Lines are numbered by page, so nothing is joined across pages.
    """
    order = Window.partitionBy(*by).orderBy("page_no", "word_idx")
    held = words.where(F.col("value") != "")
    both = held.select(*by, "page_no", "word_idx", "value", *[f(c).over(order).alias(f"{n}_{c}") for c in ("value", "line_idx", "page_no") for n, f in (("last", F.lag), ("next", F.lead))], "line_idx")
    broken = lambda a, line, after, page, other: T.ends_hyphenated(a) & (after > line) & (page == other)
    glued = F.coalesce(broken(F.col("last_value"), F.col("last_line_idx"), F.col("line_idx"), F.col("last_page_no"), F.col("page_no")), F.lit(False))
    cut = F.coalesce(broken(F.col("value"), F.col("line_idx"), F.col("next_line_idx"), F.col("page_no"), F.col("next_page_no")), F.lit(False))
    joined = F.col("last_value").isNull() | glued | T.no_space_after(F.col("last_value")) | T.no_space_before(F.col("value"))
    own = F.when(cut, F.substring(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    piece = both.select(*by, "page_no", "word_idx", F.concat(F.when(joined, "").otherwise(" "), own).alias("_piece"))
    return gathered(piece, by, ["page_no", "word_idx"], "_piece", "_pieces").select(*by, F.regexp_replace(F.array_join("_pieces", ""), r"\s\z", "").alias("text"))


def partial_words(words: DataFrame, selections: DataFrame, by: list[str], full: Callable[[], Column] | None = None, partial: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Selected words with the part of their value that is selected: the first from start_letter, the last to end_letter, others whole.

    ``selections`` (by, start_page, start_word, start_letter, end_page, end_word, end_letter), in reading order. With
    ``full`` and ``partial`` a column ``mapped`` is added: what the first makes of a whole word, and the second of one that is
    selected from a letter to another, both included.
    """
    at, a, b = F.struct("page_no", "word_idx"), F.struct(F.col("start_page"), F.col("start_word")), F.struct(F.col("end_page"), F.col("end_word"))
    held = words.join(selections, by).where((at >= a) & (at <= b))
    low = F.when(at == a, F.col("start_letter")).otherwise(0)
    high = F.when(at == b, F.col("end_letter")).otherwise(F.length("value") - 1)
    part = F.substring(F.col("value"), low + 1, F.greatest(high - low + 1, F.lit(0)))
    cut = (low > 0) | (high < F.length("value") - 1)
    mapped = [F.when(cut, partial(low, high)).otherwise(full()).alias("mapped")] if full and partial else []
    return held.select(*words.columns, part.alias("part"), cut.alias("is_partial"), *mapped)


def sorted_places(rows: DataFrame, by: list[str], key: Callable[[], Column], arrival: list[str]) -> DataFrame:
    """``rows`` plus place: where each stands (from 0) in its group's collection, which is kept sorted by ``key``; of equal keys the one that arrived first."""
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(key(), *arrival)) - 1).cast("long"))


def combined_marks(letters: DataFrame, by: list[str]) -> DataFrame:
    """Letters (by, letter_idx, text_sequence, value) with combining marks put onto the letter before them in the same sequence."""
    order = Window.partitionBy(*by, "text_sequence").orderBy("letter_idx").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("value").rlike(r"^\p{M}+$")
    base = F.count_if(~mark).over(order)
    held = letters.withColumn("_base", base).withColumn("_mark", mark)
    grouped = held.groupBy(*by, "text_sequence", "_base").agg(F.array_sort(F.collect_list(F.struct("letter_idx", "value"))).alias("_x"))
    return grouped.select(*by, "text_sequence", F.col("_x")[0]["letter_idx"].alias("letter_idx"), F.array_join(F.transform("_x", lambda s: s["value"]), "").alias("value"))


def replaced(letters: DataFrame, by: list[str]) -> DataFrame:
    """Letters (by, letter_idx, value, span, replacement): the first of a span has all of its replacement, without soft
    hyphens, the others nothing; letters of no span stay."""
    first = F.row_number().over(Window.partitionBy(*by, "span").orderBy("letter_idx")) == 1
    new = F.when(first, F.replace("replacement", F.lit("­"), F.lit(""))).otherwise("")
    return letters.withColumn("value", F.when(F.col("span").isNull(), F.col("value")).otherwise(new))


def annotations(raw: DataFrame, page_height: Column) -> DataFrame:
    """Annotations (x0, y0, x1, y1: y upward, is_link, has_action, content, colour; matrix and date, if known) with a box, y downward, that have a
    link, an action or content.

    The box is that around the corners as ``matrix`` (a to f) takes them; an annotation whose own box is empty is none. A date is
    shown as ``text.pdf_date`` has it.
    """
    own = (F.abs(F.col("x1") - F.col("x0")) > 0) & (F.abs(F.col("y1") - F.col("y0")) > 0)
    told = F.col("is_link") | F.col("has_action") | (F.coalesce("content", F.lit("")) != "")
    corners = [(F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")]
    if "matrix" in raw.columns:
        m = F.col("matrix")
        corners = [(m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]) for x, y in corners]
    xs, ys = zip(*corners, strict=True)
    sides = {"x0": F.least(*xs), "x1": F.greatest(*xs), "y0": page_height - F.greatest(*ys), "y1": page_height - F.least(*ys)}
    dated = {"date": T.pdf_date(F.col("date"))} if "date" in raw.columns else {}
    return raw.where(own & told).withColumns({**sides, **dated, "is_interactive": F.col("is_link") & F.col("has_action"), "colour_space": M.colour_space(F.col("colour"))})


def _folded(rows: DataFrame, by: list[Column], order: list[str], ddl: str, step: Callable[[], Callable[[dict], object]], read: list[str], out: str) -> DataFrame:
    """``rows`` plus ``out``: what a fold over each group, in order, says of each row.

    ``step`` makes a group's function from row to value; it keeps what it must remember. Groups are sorted and streamed, so that
    a task holds one batch and one group's memory, however many rows the group has.
    """
    keyed = rows.select(F.struct(*by).alias("_by"), F.struct(*[F.col(c) for c in read]).alias("_read"), F.struct(*rows.columns).alias("_row"))
    kind = keyed.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, of = None, None
        for batch in batches:
            said = []
            for by_, row in zip(batch.column("_by").to_pylist(), batch.column("_read").to_pylist(), strict=True):
                if of is None or by_ != group:
                    group, of = by_, step()
                said.append(of(row))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(said, pa.bool_() if ddl == "boolean" else pa.string())], names=["_row", "_said"])

    placed = keyed.repartition("_by").sortWithinPartitions("_by", *[F.asc_nulls_first(f"_row.{c}") for c in order])
    found = placed.mapInArrow(run, f"_row {kind}, _said {ddl}")
    return found.select("_row.*", F.col("_said").alias(out))


def unique_names(files: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """``files`` plus unique: the name, with the first of .1, .2, ... before its extension that no earlier file has, where one has it.

    Given names count as well as made ones: after a.pdf and a.1.pdf, a second a.pdf is a.2.pdf. Only names that
    differ by such numbers can meet, so a folder is dealt out by what is left without them. A final dot goes.
    """
    full = F.coalesce(F.col(name), F.lit(""))
    extension = F.regexp_extract(full, r"\.[^.]*$", 0)
    root = F.substring(full, F.lit(1), F.length(full) - F.length(extension))
    extension = F.when(extension == ".", "").otherwise(extension)
    named = files.withColumns({"_root": root, "_extension": extension})

    def taken() -> Callable[[dict], str]:
        have: set[str] = set()
        upto: dict[tuple[str, str], int] = {}

        def of(row: dict) -> str:
            root, extension = row["_root"], row["_extension"]
            new, i = root + extension, upto.get((root, extension), 0)
            while new in have:
                i += 1
                new = f"{root}.{i}{extension}"
            upto[root, extension] = i
            have.add(new)
            return new

        return of

    family = [*[F.col(c) for c in by], F.regexp_replace("_root", r"(\.\d+)+$", "").alias("_family"), F.col("_extension").alias("_kind")]
    return _folded(named, family, order, "string", taken, ["_root", "_extension"], "unique").drop("_root", "_extension")


def changed(rows: DataFrame, by: list[str], at: str, key: str, seconds: float, order: list[str]) -> DataFrame:
    """Rows that are shown: not those without a key, nor those that repeat the key shown last at most ``seconds`` after it was shown.

    ``order`` settles ties of ``at``. What was suppressed isn't remembered.
    """
    times = rows.withColumns({"_at": F.unix_micros(F.col(at).cast("timestamp")), "_key": F.col(key).cast("string")})

    def notices() -> Callable[[dict], bool]:
        last: list = [None, None]

        def of(row: dict) -> bool:
            at, key = row["_at"], row["_key"]
            if not key or (key == last[1] and at is not None and last[0] is not None and at - last[0] <= seconds * 1_000_000):
                return False
            last[:] = [at, key]
            return True

        return of

    return _folded(times, [F.col(c) for c in by], [at, *order], "boolean", notices, ["_at", "_key"], "_shown").where("_shown").drop("_shown", "_at", "_key")
