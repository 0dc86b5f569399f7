"""Words of a line as one text, and boxes around parts of words in any direction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import oriented, segmentation
from pagewright.operators.segmentation import BL, BR, Groups

#: Words of a bin, by which spans and words meet.
BIN = 16
#: The least spread of base points along x at which a line through them isn't upright.
FLAT = 1e-3


def line_links(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, first_word, last_word, url): the first link in each line (by) of words (by, word_idx, value), which are read without blanks between.

    The link's place in the line's text leads back to words by the sums of lengths before them; lines without a link aren't looked into.
    """
    lines = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("word_idx", F.coalesce("value", F.lit("")).alias("value")))).alias("_words"))
    text = lines.withColumn("_text", F.array_join(F.transform("_words", lambda w: w["value"]), "")).withColumn("url", T.link(F.col("_text"))).where("url <> ''")
    at = text.select(*by, "url", (F.instr("_text", F.col("url")) - 1).alias("_from"), F.inline("_words"))
    end = F.sum(F.length("value")).over(Window.partitionBy(*by).orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0))
    placed = at.withColumn("_end", end).withColumn("_begin", F.col("_end") - F.length("value"))
    inside = (F.col("_begin") < F.col("_from") + F.length("url")) & (F.col("_end") > F.col("_from"))
    return placed.where(inside).groupBy(*by, "url").agg(F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"))


def boxes(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, box) around boxes (by, ord, box) of each group in whatever direction they read: upright, turned by quarters, or along the line of least squares through their base lines' ends.

    The line stands beside each part by windows of its group, then one aggregation takes the least and greatest of the corners turned onto it: parts dealt by
    any of ``by`` stay where they are. Of the four labellings of the corners the one counts whose lower edge is nearest in angle to the way from the first
    box's lower left corner to the last one's lower right. A single oblique box stays as it is.
    """
    b, group = F.col("box"), Window.partitionBy(*by)
    ends = [b["blx"], b["brx"]], [b["bly"], b["bry"]]
    middle = parts.withColumns({"_o": G.orientation(b), **{n: F.avg((v[0] + v[1]) / 2).over(group) for n, v in zip(("_mx", "_my"), ends, strict=True)}})
    off = [[v - F.col(m) for v in e] for m, e in zip(("_mx", "_my"), ends, strict=True)]
    line = middle.withColumns({"_sxx": F.sum(off[0][0] * off[0][0] + off[0][1] * off[0][1]).over(group), "_sxy": F.sum(off[0][0] * off[1][0] + off[0][1] * off[1][1]).over(group)})
    slope = F.when(F.col("_sxx") > FLAT, F.atan(F.col("_sxy") / F.when(F.col("_sxx") > FLAT, F.col("_sxx"))))
    line = line.withColumn("_slope", slope).withColumns({"_cos": F.coalesce(F.cos("_slope"), F.lit(0.0)), "_sin": F.coalesce(F.sin("_slope"), F.lit(1.0))})
    c, s = F.col("_cos"), F.col("_sin")
    turned = [(c * b[f"{k}x"] + s * b[f"{k}y"], c * b[f"{k}y"] - s * b[f"{k}x"]) for k in ("tl", "tr", "bl", "br")]
    sides = [F.min(F.least(*[x for x, _ in turned])).alias("_x0"), F.max(F.greatest(*[x for x, _ in turned])).alias("_x1"), F.min(F.least(*[y for _, y in turned])).alias("_y0"), F.max(F.greatest(*[y for _, y in turned])).alias("_y1")]
    held = line.groupBy(*by).agg(oriented.turned_box(F.col("_o"), b).alias("_straight"), F.count("*").alias("_n"), F.min_by("box", "ord").alias("_head"), F.max_by("box", "ord").alias("_tail"), F.first("_cos").alias("_cos"), F.first("_sin").alias("_sin"), *sides)
    back = lambda x, y: (c * F.col(x) - s * F.col(y), s * F.col(x) + c * F.col(y))
    corners = {n: v for k, at in (("tl", back("_x0", "_y0")), ("tr", back("_x1", "_y0")), ("bl", back("_x0", "_y1")), ("br", back("_x1", "_y1"))) for n, v in zip((f"_{k}x", f"_{k}y"), at, strict=True)}
    along = F.degrees(F.atan2(F.col("_tail.bry") - F.col("_head.bly"), F.col("_tail.brx") - F.col("_head.blx")))
    # Columns of their own keep the code of each small enough for the JVM to compile.
    placed = held.withColumns({**corners, "_along": along})
    rings = [[F.col(f"_{k}{axis}") for k in ring.split() for axis in "xy"] for ring in ("tl tr bl br", "bl tl br tr", "br bl tr tl", "tr br tl bl")]
    offs = placed.withColumns({f"_off{i}": F.abs(G.bound_180(G.rotation(G.box(*ring)) - F.col("_along"))) for i, ring in enumerate(rings)})
    way = offs.withColumn("_way", F.array_min(F.array(*[F.struct(F.col(f"_off{i}").alias("off"), F.lit(i).alias("i")) for i in range(4)]))["i"])
    fitted = F.when(F.col("_n") == 1, F.col("_head")).otherwise(G.box(*[F.element_at(F.array(*of), F.col("_way") + 1) for of in zip(*rings, strict=True)]))
    return way.select(*by, F.coalesce("_straight", fitted).alias("box"))


def span_boxes(spans: DataFrame, letters: DataFrame, by: list[str]) -> DataFrame:
    """(by, span_id, line_idx, box): one box a line around the letters that each span covers.

    ``spans`` (by, span_id, first_word, first_letter, last_word, last_letter): from a letter of one word to a letter of another, both included;
    null letters mean whole words. ``letters`` (by, word_idx, letter_idx in its word, line_idx, box). A page's spans meet its letters in one row, by bins of
    ``BIN`` words, so that letters dealt by page stay where they are; then the interval decides.
    """
    ends = ("span_id", "first_word", "first_letter", "last_word", "last_letter")
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("first_word") / BIN), F.floor(F.col("last_word") / BIN))))
    bins = binned.groupBy(*by, "_bin").agg(F.collect_list(F.struct(*ends)).alias("_spans"))
    paged = bins.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_spans"))).alias("_bins"))
    met = letters.join(paged, by).select(*letters.columns, F.inline(F.try_element_at("_bins", F.floor(F.col("word_idx") / BIN))))
    word, at = F.col("word_idx"), F.col("letter_idx")
    after = (word > F.col("first_word")) | ((word == F.col("first_word")) & (at >= F.coalesce("first_letter", F.lit(0))))
    before = (word < F.col("last_word")) | ((word == F.col("last_word")) & (F.col("last_letter").isNull() | (at <= F.col("last_letter"))))
    covered = met.where(after & before)
    return boxes(covered.select(*by, "span_id", "line_idx", F.struct("word_idx", "letter_idx").alias("ord"), "box"), [*by, "span_id", "line_idx"])


def letter_words(letters: DataFrame, by: list[str], row: int) -> DataFrame:
    """Letters (by, letter_idx, value, corners) of pages written in rows of ``row`` letters, as ``span_boxes`` takes them; blanks part words, and so do rows' ends."""
    order = Window.partitionBy(*by).orderBy("letter_idx")
    blank = F.col("value") == " "
    fresh = ~blank & (F.coalesce(F.lag(blank).over(order), F.lit(True)) | (F.col("letter_idx") % row == 0))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    named = letters.withColumns({"_fresh": fresh, "line_idx": F.floor(F.col("letter_idx") / row).cast("int")}).withColumns({"word_idx": F.count(F.when(F.col("_fresh"), 1)).over(so_far) - 1, "_start": F.last(F.when(F.col("_fresh"), F.col("letter_idx")), ignorenulls=True).over(so_far)})
    return named.where(~blank).select(*by, "word_idx", (F.col("letter_idx") - F.col("_start")).alias("letter_idx"), "line_idx", F.struct(*G.CORNERS).alias("box"))


class Placed(NamedTuple):
    """Letters of words that lie one after the other, pages too: each letter's row among all, its word (numbered through all pages), place in its word, and line. first: the first letter of
    each word, and their number; before: the number of words before each page, and of all."""

    at: np.ndarray
    word: np.ndarray
    place: np.ndarray
    line: np.ndarray
    first: np.ndarray
    before: np.ndarray


def placed(of: np.ndarray, blank: np.ndarray, pages: int, row: int) -> Placed:
    """What ``letter_words`` tells of letters of ``pages`` pages; ``of``: the page of each, ascending."""
    n = len(of)
    begins = np.searchsorted(of, np.arange(pages + 1))
    place = np.arange(n) - begins[of]
    fresh = ~blank & ((place % row == 0) | np.r_[True, blank[:-1]][:n])
    so_far = np.r_[0, np.cumsum(fresh)]
    at = np.flatnonzero(~blank)
    word = so_far[at + 1] - 1
    first = np.searchsorted(word, np.arange(so_far[-1] + 1))
    return Placed(at, word, np.arange(len(at)) - first[word], place[at] // row, first, so_far[begins])


def fitted_boxes(b: np.ndarray, held: Groups) -> np.ndarray:
    """``boxes`` of groups of oblique boxes that lie one after the other."""
    size = held.sizes()
    own = np.repeat(np.arange(len(size)), size)
    total = lambda v: np.add.reduceat(v, held.first)
    base = b[:, BL:]
    off = base - (total(base.mean(axis=1)) / size[:, None])[own, None]
    sxx, sxy = total((off[..., 0] * off[..., 0]).sum(axis=1)), total((off[..., 0] * off[..., 1]).sum(axis=1))
    lies = sxx > FLAT
    slope = np.arctan(sxy / np.where(lies, sxx, 1.0))
    c, s = np.where(lies, np.cos(slope), 0.0), np.where(lies, np.sin(slope), 1.0)
    x, y = c[own, None] * b[..., 0] + s[own, None] * b[..., 1], c[own, None] * b[..., 1] - s[own, None] * b[..., 0]
    (x0, y0), (x1, y1) = ([f.reduceat(f.reduce(v, axis=1), held.first) for v in (x, y)] for f in (np.minimum, np.maximum))
    corners = np.stack([np.stack([c * u - s * v, s * u + c * v], axis=-1) for u, v in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))], axis=1)
    rings = np.stack([corners, corners[:, [2, 0, 3, 1]], corners[:, [3, 2, 1, 0]], corners[:, [1, 3, 0, 2]]], axis=1)
    head, tail = b[held.first], b[held.first + size - 1]
    along = segmentation.direction(tail[:, BR] - head[:, BL])
    way = np.abs(segmentation.bound_180(segmentation.direction(rings[:, :, BR] - rings[:, :, BL]) - along[:, None])).argmin(axis=1)
    return np.where((size == 1)[:, None, None], head, rings[np.arange(len(size)), way])


def boxes_of(b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``boxes`` of groups 0, 1, ... that lie one after the other."""
    code = segmentation.orientations(b)
    oblique = segmentation.common(code, Groups(group)) == segmentation.OTHER
    out = np.empty((len(oblique), 4, 2))
    for other, box in ((False, lambda b, code, held: segmentation.group_boxes(b, code, held)[0]), (True, lambda b, _, held: fitted_boxes(b, held))):
        rows = np.flatnonzero(oblique[group] == other)
        if len(rows):
            number = np.cumsum(oblique == other) - 1
            out[oblique == other] = box(b[rows], code[rows], Groups(number[group[rows]]))
    return out


def _of_pages(f: Callable, row: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, of, value, b, _ in segmentation._parts(batch):
                blank = pc.fill_null(pc.equal(value, " "), True).to_numpy(zero_copy_only=False)
                page, numbers, box = f(part, of, placed(of, blank, part.num_rows, row), b)
                at = pa.array(page)
                head = [part.column("doc_id").cast(pa.int64()).take(at), part.column("page_no").cast(pa.int32()).take(at)]
                yield pa.RecordBatch.from_arrays([*head, *numbers, *[pa.array(np.ascontiguousarray(c)) for c in box.reshape(-1, 8).T]], names=["doc_id", "page_no", *names, *G.CORNERS])

    return run


_BOX = ", ".join(f"{c} double" for c in G.CORNERS)


def word_boxes_of_pages(pages: DataFrame, row: int, moved: Callable | None = None) -> DataFrame:
    """(doc_id, page_no, word_idx, corners): ``boxes`` of the words of pages, a row each: (doc_id, page_no) and arrays value and corners (or x0, y0, x1, y1).

    Words are those of ``letter_words``. ``moved`` (the pages, each letter's page, its place in its word, its box) gives letters other boxes.
    """

    def found(part: pa.RecordBatch, of: np.ndarray, letters: Placed, b: np.ndarray) -> tuple:
        own, b = of[letters.at], b[letters.at]
        box = boxes_of(b if moved is None else moved(part, own, letters.place, b), letters.word)
        page = own[letters.first[:-1]]
        return page, [pa.array(np.arange(len(page)) - letters.before[page])], box

    return pages.mapInArrow(_of_pages(found, row, ["word_idx"]), f"doc_id long, page_no int, word_idx long, {_BOX}")


def span_boxes_of_pages(pages: DataFrame, row: int) -> DataFrame:
    """(doc_id, page_no, span_id, line_idx, corners): ``span_boxes`` of the letters of pages, a row each, as ``word_boxes_of_pages`` takes them, with an array of spans.

    Letters that a span covers follow each other, so that it is looked up by its first and last letter.
    """

    def found(part: pa.RecordBatch, of: np.ndarray, letters: Placed, b: np.ndarray) -> tuple:
        spans = part.column("spans")
        page = pc.list_parent_indices(spans).to_numpy().astype(np.int64)
        field = dict(zip((f.name for f in spans.type.value_type), spans.flatten().flatten(), strict=True))
        known = lambda c, default: pc.fill_null(field[c].cast(pa.int64()), default).to_numpy(zero_copy_only=False)
        before, words = letters.before[page], np.diff(letters.before)[page]
        at = lambda w: letters.first[before + np.clip(w, 0, words)]
        first, last = known("first_word", 0), known("last_word", 0)
        lo = np.where(first < 0, at(first), np.minimum(at(first) + known("first_letter", 0), at(first + 1)))
        hi = np.minimum(at(last) + known("last_letter", len(of)) + 1, at(last + 1))
        n = np.maximum(hi - lo, 0)
        span = np.repeat(np.arange(len(n)), n)
        row_of = np.arange(len(span)) + np.repeat(lo - np.cumsum(n) + n, n)
        line = letters.line[row_of]
        fresh = np.r_[True, (np.diff(span) != 0) | (np.diff(line) != 0)][: len(span)]
        heads = np.flatnonzero(fresh)
        box = boxes_of(b[letters.at[row_of]], np.cumsum(fresh) - 1)
        return page[span[heads]], [field["span_id"].cast(pa.int32()).take(pa.array(span[heads])), pa.array(line[heads], pa.int32())], box

    return pages.mapInArrow(_of_pages(found, row, ["span_id", "line_idx"]), f"doc_id long, page_no int, span_id int, line_idx int, {_BOX}")


def count_words(value: Column, row: int) -> Column:
    """The number of words of an array of letters, as ``letter_words`` parts them."""
    return F.size(F.filter(value, lambda v, i: (v != " ") & ((i % row == 0) | (F.get(value, i - 1) == " "))))
