"""Hand-worked cases of turned and oblique text, segment geometry, lookups, selections and JSON of the document model."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import model as M
from pagewright.operators import lookups as U
from pagewright.operators import oriented as O
from pagewright.operators import textlayer as L
from pagewright.sources import blocks_json


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def glyph(x, y, length, thick, turn):
    s = 1 if turn == 270 else -1
    ends = [(x + s * thick, y), (x + s * thick, y + s * length), (x, y), (x, y + s * length)]
    return [float(v) for p in ends for v in p]


@pytest.mark.parametrize(("turn", "name", "second"), [(90, "Rotate90", 190), (270, "Rotate270", 210)])
def test_boxes_of_turned_text_keep_the_height_of_their_letters(spark, turn, name, second):
    rows = [glyph(100, 200, 8, 6.0, turn), glyph(100, second, 0.1, 0.1, turn)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in G.CORNERS))
    b = G.box(*[F.col(c) for c in G.CORNERS])
    got = df.select(b.alias("b")).withColumn("o", G.orientation(F.col("b"))).agg(G.group_orientation(F.col("o")).alias("o"), O.turned_box(F.col("o"), F.col("b")).alias("b"))
    r = got.select("o", G.height(F.col("b")).alias("h"), G.width(F.col("b")).alias("w"), G.rotation(F.col("b")).alias("r"), "b.blx", "b.bly").first()
    assert r.o == name and r.h >= 5.5 and round(r.w, 1) == 10.1 and round(r.r) == (-90 if turn == 90 else 90) and (r.blx, r.bly) == (100, 200)


@pytest.mark.parametrize("degrees", [10, 60, 100, 170, -20, -100, -160])
def test_boxes_of_oblique_text_run_along_it(spark, degrees):
    a = math.radians(degrees)
    turn = lambda x, y: (50 + x * math.cos(a) - y * math.sin(a), 50 + x * math.sin(a) + y * math.cos(a))
    box = lambda x0, x1, h: [v for x, y in ((x0, -h), (x1, -h), (x0, 0), (x1, 0)) for v in turn(x, y)]
    rows = [(1, k, *box(6 * k, 6 * k + 5, 8 + k % 2)) for k in range(5)]
    df = spark.createDataFrame(rows, "w int, ord int, " + ", ".join(f"{c} double" for c in G.CORNERS))
    want = box(0, 29, 9)
    for least in (False, True):
        r = O.oblique_boxes(df, ["w"], least).first()
        assert np.allclose([r[c] for c in G.CORNERS], want, atol=1e-6), least


def test_least_area_box_against_all_directions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        points = rng.normal(size=(30, 2)) * (5, 1)
        r = O.least_area_box(points, 0.0)
        area = np.linalg.norm(r[1] - r[0]) * np.linalg.norm(r[2] - r[0])
        sweep = []
        for k in range(1800):
            c, s = math.cos(k * math.pi / 1800), math.sin(k * math.pi / 1800)
            turned = points @ np.array([[c, -s], [s, c]])
            sweep.append(np.prod(turned.max(axis=0) - turned.min(axis=0)))
        assert area <= min(sweep) + 1e-9


def test_blocking_of_segments(spark):
    seg = lambda *v: [F.lit(float(x)) for x in v]
    of = lambda i, j: one(spark, G.blocking(*seg(*i), *seg(*j)).alias("x"), G.overlapping_distance(G.blocking(*seg(*i), *seg(*j))).alias("d"))
    r = of((0, 0, 100, 0), (50, 14, 150, 14))
    assert (r.x.angle, r.x.overlap, r.x.distance, r.x.overlapped, r.d) == (0, 0.5, 14, True, 14)
    r = of((0, 0, 100, 0), (120, 14, 220, 14))
    assert r.x.overlap == pytest.approx(-0.2) and not r.x.overlapped and r.d == math.inf
    assert tuple(of((1, 2, 3, 4), (1, 2, 3, 4)).x) == (0, 1, 0, True)
    assert of((0, 0, 10, 0), (5, 0, 5, 10)).x.distance is None and of((0, 0, 10, 0), (0, 5, 10, 15)).d == math.inf
    c, s = math.cos(0.3), math.sin(0.3)
    turn = lambda x, y: (x * c - y * s, x * s + y * c)
    r = of((*turn(0, 0), *turn(100, 0)), (*turn(20, 9), *turn(70, 9)))
    assert r.x.overlap == pytest.approx(1) and abs(r.x.distance) == pytest.approx(9, abs=1e-5) and r.d == pytest.approx(9, abs=1e-5)


def test_duplicates_in_chains():
    rng = random.Random(4)
    rows = [(1, 1, i, rng.choice("ab"), float(x), 0.0, float(x) + 6, 10.0) for i, x in enumerate(rng.choice((0, 1, 2, 3, 9, 10)) for _ in range(40))]
    for keep in ("first", "last"):
        alive = []
        for r in rows:
            old = next((k for k, q in enumerate(alive) if q[3] == r[3] and abs(q[4] - r[4]) <= 2), None)
            if old is None:
                alive.append(r)
            elif keep == "last":
                alive[old] = r
        for value in "ab":
            of = [r for r in rows if r[3] == value]
            stays = L.survivors([(r[4], r[7], 2.0) for r in of], keep)
            assert [r[2] for r, s in zip(of, stays, strict=True) if s] == sorted(r[2] for r in alive if r[3] == value)


def test_selection_text_joins_what_line_ends_broke(spark):
    words = ["(", "over", ")", "lap-", "ping", "a", "", "b-", "c"]
    lines = [0, 0, 0, 0, 1, 1, 1, 1, 0]
    df = spark.createDataFrame([(1, 2 if i == 8 else 1, i, lines[i], w) for i, w in enumerate(words)], "d int, page_no int, word_idx int, line_idx int, value string")
    assert U.selection_text(df, ["d"]).first().text == "(over) lapping a b-c"


def test_active_bookmark(spark):
    marks = spark.createDataFrame([(1, 1, 1, "a", 700.0), (1, 1, 2, "b", 100.0), (1, 3, 1, "c", None)], "d int, page int, ord int, title string, y double")
    views = [(1, 0.0, 0, "a"), (1, 650.0, 0, "b"), (1, 650.0, 180, "a"), (1, 650.0, 90, "a"), (2, 0.0, 0, "b"), (2, -10.0, 0, "b"), (3, 5.0, 0, "c"), (4, 9.0, 0, "c")]
    df = spark.createDataFrame([(1, p, o, r, 800.0, 800.0, w) for p, o, r, w in views] + [(2, 1, 0.0, 0, 800.0, 800.0, None)], "d int, page int, offset double, rotation int, height double, height_before double, want string")
    assert all(r.active == r.want for r in U.active_bookmark(df, marks, ["d"]).collect())


def test_ids_follow_the_orders_that_sources_name(spark):
    blocks = [{}, {"source_id": "d:7"}, {}, {"source_id": "d:x"}, {"source_id": "d:2"}, {}]
    raw = spark.createDataFrame([(json.dumps({"doc_id": "d", "pages": {"1": blocks, "x": blocks}}),)], "json string")
    got = [r.id for r in blocks_json.pages_json(raw).orderBy("place").collect()]
    order, want = 0, []
    for b in blocks:
        want.append(order)
        named = b.get("source_id", "").partition(":")[2]
        order = (int(named) if named.isdigit() else order) + 1
    assert got == want


def test_names_paths_and_pieces(spark):
    r = one(spark, M.is_valid_path(F.lit("a/b.txt")), M.is_valid_path(F.lit("a/b?.txt")), M.is_valid_path(F.lit("a|b/c")), M.clean_append(F.array(F.lit("a\0b"), F.lit(" "), F.lit(None), F.lit("c"))), M.without_soft_hyphens(F.lit("so­ft")))
    assert tuple(r) == (True, False, False, "a bc", "soft")
    files = spark.createDataFrame([(1, "a.b.pdf"), (2, "a.b.pdf"), (3, "a"), (4, "a")], "n int, name string").withColumn("d", F.lit(1))
    assert [r.unique for r in U.unique_names(files, ["d"], "name", ["n"]).orderBy("n").collect()] == ["a.b.pdf", "a.b.1.pdf", "a", "a.1"]
    files = spark.createDataFrame(list(enumerate(["a.pdf", "a.pdf", "a.1.pdf", "a.pdf", "a.1.pdf", "b.", ".x", ".x", "", None])), "n int, name string").withColumns({"d": F.lit(1), "_row": F.lit("clash")})
    got = [r.unique for r in U.unique_names(files, ["d"], "name", ["n"]).orderBy("n").collect()]
    assert got == ["a.pdf", "a.1.pdf", "a.1.1.pdf", "a.2.pdf", "a.1.2.pdf", "b", ".x", ".1.x", "", ".1"]
    with pytest.raises(Exception, match="no page 9"):
        U.page_of(spark.range(3).withColumnRenamed("id", "page_no"), F.lit(9), F.lit(3)).collect()


def test_notices_are_compared_with_the_last_one_shown(spark):
    events = [(0, 0.0, "a"), (1, 2.0, "a"), (2, 4.0, "a"), (3, 5.0, "b"), (4, 5.5, "a"), (5, 8.5, "a"), (6, 8.6, None), (7, 8.6, ""), (8, 8.7, "a"), (9, 11.6, "a")]
    rows_ = spark.createDataFrame([(u, *e) for u in (1, 2) for e in events], "u int, n int, t double, m string").withColumn("ts", F.col("t").cast("timestamp"))
    got = U.changed(rows_, ["u"], "ts", "m", 3, ["n"])
    assert got.columns == rows_.columns and sorted((r.u, r.n) for r in got.collect()) == [(u, n) for u in (1, 2) for n in (0, 2, 3, 4, 8)]


def test_readers_tell_kinds_ids_and_levels_apart(spark):
    """Each case is one that the three kinds of file treat differently."""
    block = {"id": 7, "type": "footer", "source_label": "Paragraph_Title", "content": "c", "text": "t", "level": 3, "page": 4, "bbox": [1, 2, 0, 5]}
    whole = spark.createDataFrame([(json.dumps({"pages": {" 2 ": [block, {}]}}), json.dumps([block, {}]))], "json string, list string")
    page = [(r.page, r.id, r.type, r.source_label, r.content, r.bbox.w, r.title_level) for r in blocks_json.pages_json(whole).orderBy("place").collect()]
    assert page == [(2, 0, "footer", "Paragraph_Title", "c", -1.0, None), (2, 1, "", "", "", 0.0, None)]
    middle = [(r.page, r.own_page, r.id, r.type, r.content, r.bbox.w, r.level, r.title_level, r.contd) for r in blocks_json.middle_json(whole).orderBy("place").collect()]
    assert middle == [(2, 4, 7, "title", "c", 0.0, 3, 3, -1), (2, 0, 0, "text", "", 0.0, -1, None, -1)]
    flat = [(r.id, r.page, r.type, r.content, r.bbox.w, r.level) for r in blocks_json.inference_json(whole, "list").orderBy("place").collect()]
    assert flat == [(7, 4, "footer", "c", -1.0, 3), (0, 0, "", "", 0.0, -1)]
    listed = [(r.id, r.page, r.type, r.source_label, r.content, r.bbox.w) for r in blocks_json.content_list_json(whole, "list").orderBy("id").collect()]
    assert listed == [(0, 4, "text", "footer", "t", 0.0), (1, 1, "text", "", "", 0.0)]


def test_ids_of_a_long_page_in_one_pass(spark):
    blocks = [{"source_id": f"d:{i * 3}"} if i % 1000 == 999 else {} for i in range(20_000)]
    raw = spark.createDataFrame([(json.dumps({"pages": {"1": blocks}}),)], "json string")
    order, want = 0, []
    for i, b in enumerate(blocks):
        want.append(order)
        order = (i * 3 if b else order) + 1
    assert [r.id for r in blocks_json.pages_json(raw).orderBy("place").collect()] == want
