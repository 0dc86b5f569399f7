"""Hand-worked cases of the document operators."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import layoutmath as M
from pagewright.functions import text as T
from pagewright.operators import relations as R
from pagewright.operators import search as S
from pagewright.operators import segmentation


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rect(cx, cy, w, h, degrees, flipped):
    a = np.radians(degrees)
    corner = lambda x, y: (cx + x * np.cos(a) - y * np.sin(a), cy + x * np.sin(a) + y * np.cos(a))
    top, bottom = (h / 2, -h / 2) if not flipped else (-h / 2, h / 2)
    points = [corner(-w / 2, top), corner(w / 2, top), corner(-w / 2, bottom), corner(w / 2, bottom)]
    return G.box(*[F.lit(float(v)) for p in points for v in p])


def test_mirrored_boxes_turn_upright(spark):
    columns = []
    for degrees in (0, 34, 90, 137, 180, 215, 270, 313, -34, -90):
        for flipped in (False, True):
            b = rect(100, 200, 40, 16, degrees, flipped)
            columns += [G.is_mirrored(b) == G.is_mirrored(rect(100, 200, 40, 16, 0, flipped)), G.is_mirrored(G.unmirror(b)) == F.lit(False)]
    assert all(one(spark, *columns))
    assert one(spark, G.is_mirrored(rect(100, 200, 40, 16, 0, True)) != G.is_mirrored(rect(100, 200, 40, 16, 0, False)))[0]


def test_print_cells_and_places(spark):
    cells = lambda w, h, n: [tuple(c) for c in one(spark, M.cells(F.lit(w), F.lit(h), F.lit(n)))[0]]
    assert cells(1000, 800, 1) == [(0, 0, 1000, 800)]
    assert cells(600, 800, 2) == [(0, 0, 600, 400), (0, 400, 600, 400)]
    assert cells(1000, 600, 2) == [(0, 0, 500, 600), (500, 0, 500, 600)]
    assert cells(1000, 800, 4) == [(0, 0, 500, 400), (500, 0, 500, 400), (0, 400, 500, 400), (500, 400, 500, 400)]

    def placed(cell, bitmap, points, mode, scale=100, dpi=100):
        c = F.struct(*[F.lit(v).alias(n) for v, n in zip(cell, "xywh", strict=True)])
        return tuple(one(spark, M.placed(c, *[F.lit(v) for v in (*bitmap, *points, dpi, dpi, mode, scale)]))[0])

    assert placed((10, 20, 100, 200), (50, 50), (72, 72), "fit") == (10, 70, 100, 100)
    assert placed((0, 0, 1000, 1000), (1, 1), (72, 144), "actual")[2:] == (100, 200)
    assert placed((0, 0, 500, 500), (1, 1), (72, 72), "shrink")[2:] == (100, 100)
    assert placed((0, 0, 500, 500), (1, 1), (720, 720), "shrink")[2:] == (500, 500)
    assert placed((0, 0, 500, 500), (1, 1), (72, 72), "custom", 50)[2:] == (50, 50)
    assert one(spark, M.luma(F.lit(255), F.lit(0), F.lit(0)), M.luma(F.lit(255), F.lit(255), F.lit(255)))[:] == (76, 255)


def test_text_functions(spark):
    assert one(spark, T.page_ranges(F.lit("1-3, 5, x, 9"), F.lit(6)))[0] == [1, 2, 3, 5]
    assert one(spark, T.page_ranges(F.lit("x"), F.lit(6)))[0] is None
    for typed, pages in {"20-30": [10], "0-0": [1], "9-20": [9, 10], "5-3": None, "-5": None, "3-": None, "1-2-3": None, "2--3": None, "12": None, "+2": [2], "": None}.items():
        assert one(spark, T.page_ranges(F.lit(typed), F.lit(10)))[0] == pages, typed
    assert one(spark, T.readable_size(F.lit(16_567_501)))[0] == "15.8 MB"
    assert one(spark, T.pdf_date(F.lit("D:20240102030405+01'00'")))[0] == "2024-01-02 03:04:05 +01:00"
    assert one(spark, T.pdf_date(F.lit("soon")))[0] == "soon"
    assert one(spark, T.block_type(F.lit(" Picture ")), T.block_type(F.lit("odd")))[:] == ("image", "text")
    assert one(spark, T.allowed_uri(F.lit("example.org")), T.allowed_uri(F.lit("javascript:x")))[:] == ("http://example.org", None)
    for uri, opened in {"HTTP://x": None, "httpx": None, "http://x": "http://x", "file://": None, "file:///a": "file:///a", "": None, "mailto:a": "mailto:a"}.items():
        assert one(spark, T.allowed_uri(F.lit(uri)))[0] == opened, uri
    b = F.array(*[F.lit(v) for v in (2000.0, 0.0, 1000.0, 500.0)])
    assert tuple(one(spark, G.bbox_normalised(b, F.lit(2000.0), F.lit(1000.0)))[0]) == (2000.0, 0.0, 0.0, 500.0)


def test_search_spans_words_and_skips_doubled_punctuation(spark):
    pages = spark.createDataFrame([(1, 1, ["One", "of", "the", "Ones."]), (1, 2, ["none"])], "doc_id long, page_no int, words array<string>")
    index = S.text_index(pages)
    hits = [(r.page_no, r.word_idx, r.word_count, r.span_word_count) for r in S.search(index, "OF THE").collect()]
    assert hits == [(1, 1, 1, 2)]
    assert S.search(index, "").count() == 0
    assert S.search(index, "a--b").count() == 0
    assert {r.value for r in S.hit_words(S.search(index, "of the"), pages).collect()} == {"of", "the"}


def test_words_lines_and_blocks_of_a_page():
    rows = []
    for r, line in enumerate(["ab cd.", "ef"]):
        rows += [(1, 1, 100 * r + i, c, 72 + 6.0 * i, 62 + 14.0 * r, 78 + 6.0 * i, 72 + 14.0 * r) for i, c in enumerate(line)]
    page = pd.DataFrame(rows, columns=["doc_id", "page_no", "letter_idx", "value", "x0", "y0", "x1", "y1"])
    out = segmentation.layer(page)
    assert out.value.tolist() == ["ab", " ", "cd", ".", "ef"]
    assert out.line_idx.tolist() == [0, 0, 0, 0, 1]


def test_nearest_counts_different_distances(spark):
    items = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [-1.0]), (3, [2.0]), (4, [5.0])], "id long, v array<double>")
    out = R.nearest(items.where("id = 0"), items, R.squared_distance, 2)
    assert sorted(map(tuple, R.nearest(items, items, R.squared_distance, 2, block=1).collect())) == sorted(map(tuple, R.nearest(items, items, R.squared_distance, 2).collect()))
    assert sorted((r.item_id, r.rank) for r in out.collect()) == [(1, 1), (2, 1), (3, 2)]


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("b", 5, 12)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0)], "k string, t int, v double")
    assert {r.id: r.v for r in R.as_of(left, right, ["k"], "t", "t", "v").collect()} == {10: None, 11: 2.0, 12: None}


def test_progressive_search_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, ["some", "words"]), (2, 1, ["more", "words"])], "doc_id long, page_no int, words array<string>")
    pages.repartition(2).write.parquet(str(tmp_path / "in"))
    got = []
    S.progressive(spark, str(tmp_path / "in"), pages.schema, "words", str(tmp_path / "ck"), lambda df: got.extend(df.collect())).awaitTermination()
    assert sorted(got) == sorted(S.search(S.text_index(pages), "words").collect())
