"""What has to hold for large tables: pages stay whole in one task, pairs aren't rows, sizes aren't guessed."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright import catalogue, catalogue_layout, catalogue_model  # noqa: F401 - the others add their queries
from pagewright.functions.geometry import CORNERS
from pagewright.operators import clusters, hierarchy, lookups, relations, segmentation, spans, tiles
from pagewright.operators import viewing as V
from pagewright.plans import layout
from pagewright.sources import blocks_json


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Texts of up to three pages in a folder of tables."""
    folder = tmp_path_factory.mktemp("sized")
    texts = [(i, ("A few words, " * (i * 20))[: i * 700] or None) for i in range(8)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["hit_rectangles", "letter_dedup_first", "letter_dedup_last", "word_extract", "oblique_word_boxes", "text_layer"])
def test_letters_of_a_page_are_never_shuffled(spark, docs, name):
    """The exchanges are that of whole pages, which ``layout.dealt`` asks for, and those of pages' sums."""
    found = catalogue.QUERIES[name](spark, docs)
    steps = plan(found).split("\n")
    assert all("partial_" in under for step, under in zip(steps, steps[1:], strict=False) if "ENSURE_REQUIREMENTS" in step)
    assert found.count() > 0


@pytest.mark.parametrize("name", ["word_extract", "text_layer"])
def test_pages_come_to_python_as_one_row_each(spark, docs, name):
    """Letters that are rows would be sorted by page before, all of a task's at once, and a page would come alone."""
    steps = plan(catalogue.QUERIES[name](spark, docs))
    assert "MapInArrow" in steps and "Sort" not in steps and "InPandas" not in steps


@pytest.mark.parametrize("name", ["letter_dedup_first", "letter_dedup_last"])
def test_doubles_are_found_in_pages_of_one_row(spark, tmp_path, name):
    """Letters were sorted as rows, four times a page, and texts of one id taken for one page."""
    spark.createDataFrame([(1, "a few words"), (1, "a few"), (2, "x" * 2005), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    steps = plan(found)
    assert "MapInArrow" in steps and "Window" not in steps and "InPandas" not in steps
    assert {(r.doc_id, r.page_no, r.n) for r in found.collect()} == {(1, 1, 16), (2, 1, 2000), (2, 2, 5)}


@pytest.mark.parametrize("name", ["hit_rectangles", "oblique_word_boxes"])
def test_boxes_are_found_in_pages_of_one_row(spark, docs, name):
    """Letters were rows, sorted and numbered by windows."""
    steps = plan(catalogue.QUERIES[name](spark, docs))
    assert "MapInArrow" in steps and "Window" not in steps and "Sort" not in steps


def test_boxes_of_pages_are_those_of_letters(spark, monkeypatch):
    """Upright, turned and oblique pages, an empty one, rows that end in a word; spans with and without letters, of words that aren't there."""
    monkeypatch.setattr(segmentation, "LETTERS", 150)
    pick, by, kinds = random.Random(3), ["doc_id", "page_no"], ", ".join(f"{c} double" for c in CORNERS)
    rows = []
    for doc, angle in enumerate((0, 90, 180, 270, 20, 200, 300)):
        c, s = round(math.cos(math.radians(angle)), 12), round(math.sin(math.radians(angle)), 12)
        for k in range(90):
            x, y = 6.0 * (k % 20), 14.0 * (k // 20) + (k % 3 if angle % 90 else 0)
            box = [v for u, w in ((x, y - 10), (x + 6, y - 10), (x, y), (x + 6, y)) for v in (c * u - s * w, s * u + c * w)]
            rows.append((doc, 1, k, pick.choice("ab  c"), *box))
    letters = spark.createDataFrame([*rows, (9, 1, 0, " ", *[0.0] * 8)], f"doc_id long, page_no int, letter_idx int, value string, {kinds}")
    named, pages = spans.letter_words(letters, by, 20), segmentation.gathered(letters)
    rounded = lambda df, *keys: sorted((*[r[k] for k in keys], *[round(r[c], 6) + 0.0 for c in CORNERS]) for r in df.collect())
    words = spans.boxes(named.withColumnRenamed("letter_idx", "ord"), [*by, "word_idx"]).select(*by, "word_idx", "box.*")
    assert rounded(spans.word_boxes_of_pages(pages, 20), *by, "word_idx") == rounded(words, *by, "word_idx")
    chosen = spark.createDataFrame([(0, 0, 1, 4, 0), (1, 3, None, 9, None), (2, 2, 7, 2, 9), (3, 5, 1, 900, 0), (4, 300, None, 400, None), (5, 6, 0, 4, 0)], "span_id int, first_word int, first_letter int, last_word int, last_letter int")
    paged = pages.crossJoin(chosen.agg(F.collect_list(F.struct(*chosen.columns)).alias("spans")))
    keys = [*by, "span_id", "line_idx"]
    want = spans.span_boxes(letters.select(*by).distinct().crossJoin(chosen.where("first_word <= last_word")), named, by).select(*keys, "box.*")
    assert rounded(spans.span_boxes_of_pages(paged, 20), *keys) == rounded(want, *keys)
    assert [r.n for r in pages.select("doc_id", spans.count_words(F.col("value"), 20).alias("n")).orderBy("doc_id").collect()][:7] == [r.n for r in named.groupBy("doc_id").agg((F.max("word_idx") + 1).alias("n")).orderBy("doc_id").collect()]


def test_pages_are_dealt_by_their_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 5000) for i in range(10)], "doc_id long, text string")
    monkeypatch.setattr(layout, "TASK", 2000)
    letters = layout.letters(docs)
    assert letters.rdd.getNumPartitions() == 25
    assert {r.n for r in letters.groupBy("doc_id", "page_no").agg(F.count("*").alias("n")).collect()} == {2000, 1000}


def test_words_named_by_lines_are_not_broadcast(spark):
    words = spark.range(5).select(F.lit(1).alias("page"), F.col("id").alias("word_idx"))
    lines = spark.range(1).select(F.lit(1).alias("page"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("first_word"), F.lit(3).cast("long").alias("past"))
    found = lookups.line_of_words(words, lines, ["page"])
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted((r.word_idx, r.line) for r in found.collect() if r.line is not None) == [(0, 0), (1, 0), (2, 0)]


def test_a_point_and_a_line_are_no_row(spark):
    """Points of one place are looked up once, lines of one place count as the smallest."""
    lines = spark.createDataFrame([(0, k, 0.0, 50.0, 10.0 * (k // 2)) for k in range(8)], "page int, line long, x0 double, x1 double, y1 double")
    words = lines.select("page", "line", F.col("line").alias("word_idx"), "x0", "x1", "y1")
    points = spark.createDataFrame([(i, 0, 5.0, 10.0 * (i % 3)) for i in range(30)] + [(None, 0, 5.0, 0.0)], "id long, page int, x double, y double")
    found = V.nearest_while_selecting(points, lines, words, ["page"], "id")
    assert {(r.id, r.line, r.word_idx) for r in found.collect()} == {(i, 2 * (i % 3), 2 * (i % 3)) for i in range(30)} | {(None, None, None)}
    inner = plan(found)
    assert "array_min" in inner and "SortAggregate(key=[id" not in inner


def test_nearest_vectors_equal_every_pair(spark):
    """Copies, ties, equal ids and rows without a vector; rows of few vectors, so that several meet."""
    rows = [(i, [float(i * 7919 % 23), float(i * 31 % 5), 0.5 * (i % 3)]) for i in range(90)] + [(3, [1.0, 1.0, 1.0]), (500, None), (None, [0.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows, "id long, v array<float>")
    good = items.where("id IS NOT NULL AND v IS NOT NULL")
    key = lambda df: sorted((r.query_id, r.item_id, round(r.distance, 4), r["rank"]) for r in df.collect())
    for k in (1, 2, 3):
        assert key(relations.nearest_vectors(items.where("id % 10 = 0"), items, k, chunk=8)) == key(relations.nearest(good.where("id % 10 = 0"), good, relations.squared_distance, k))


def test_every_vector_is_a_query(spark, tmp_path):
    """Ids that 100 divides were the only ones asked for."""
    rows = [(i, [float(i * 7919 % 23), float(i * 31 % 5)]) for i in range(1, 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set()
    for i, a in rows:
        far = {j: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for j, b in rows if j != i}
        want |= {(i, j, rank) for rank, d in enumerate(sorted(set(far.values()))[:2], 1) for j in far if far[j] == d}
    got = [(r.query_id, r.item_id, r["rank"]) for r in catalogue.QUERIES["knn2_ties"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_ids_of_a_long_page_take_time_in_proportion(spark):
    """Every block names an order: the marks are found once, not once a mark."""

    def seconds(n: int) -> float:
        blocks = [{"type": "t", "source_id": f"d:{3 * i}"} for i in range(n)]
        raw = spark.createDataFrame([(json.dumps({"pages": {"1": blocks}}),)], "json string")
        begin = time.time()
        assert [r.id for r in blocks_json.pages_json(raw).orderBy("place").collect()] == [0, *[3 * i + 1 for i in range(n - 1)]]
        return time.time() - begin

    seconds(10)
    assert seconds(3000) < 8


def test_pairs_of_points_are_no_rows(spark, monkeypatch):
    """A crowd and a far point: each round is as long as what it asks for, the nearest is found inside rows."""
    written = []
    monkeypatch.setattr(clusters, "cut", lambda df: written.append(plan(df)) or df.localCheckpoint())
    points = spark.createDataFrame([(0, i, float(i * 37 % 101), float(i * 61 % 103)) for i in range(900)] + [(0, 900, 5000.0, 5000.0)], "page int, id int, x double, y double")
    got = {r.id: r.distance for r in clusters.nearest(points, ["page"], "id", "x", "y").collect()}
    rows = points.collect()
    assert all(abs(got[a.id] - min(((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5 for b in rows if b.id != a.id)) < 1e-9 for a in rows)
    judged = [p for p in written if "_sure" in p and "_best" in p]
    assert "array_min" in judged[0] and "min(named_struct" not in judged[0]


def test_links_shrink_from_round_to_round(spark, monkeypatch):
    """A chain in order, and a node of its own: rows written in all stay within a few times the chain's."""
    rows = []

    def kept(df):
        out = df.localCheckpoint()
        rows.append(out.count())
        return out

    monkeypatch.setattr(clusters, "cut", kept)
    nodes = spark.createDataFrame([(0, i) for i in range(400)] + [(0, 999)], "page int, id int")
    links = spark.createDataFrame([(0, i, i + 1) for i in range(399)], "page int, id int, to int")
    got = {r.id: r.component for r in clusters.components(nodes, links, ["page"], "id", "to").collect()}
    assert got == {**{i: 0 for i in range(400)}, 999: 999}
    assert sum(rows) < 10 * 400


def test_nodes_of_paths_are_worked_out_once(spark):
    """Each level of a recursive query reads its nodes again, so they are written before."""
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    nodes = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(6)], "node_id int, parent_id int, place int").withColumn("place", F.udf(note, "int")("place"))
    assert {r.node_id: r.depth for r in hierarchy.paths(nodes, "int").collect()} == {i: i for i in range(6)}
    assert seen.value == 6


def test_wanted_tiles_are_not_sorted(spark):
    """Tables read in one piece would be broadcast, whose size Spark only guesses; beyond that the many wanted tiles stream by the few that are found."""
    wanted = spark.range(40).select((F.col("id") % 4).alias("page"), F.lit(1).alias("level"), (F.col("id") % 5).alias("key"), "id")
    held = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, -1, 0)], "page long, level int, key long")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        found = tiles.with_cache(wanted, held, ["page"])
        last = plan(found).split("Join", 1)
        got = {(r.page, r.key): (r.is_held, r.held_above) for r in found.collect()}
    finally:
        spark.conf.set(limit, before)
    assert last[0].endswith("ShuffledHash")
    assert found.count() == 40
    assert got == {(p, k): (p == 0 and k == 0, {1: 0 if k < 4 else None, 2: -1}.get(p)) for p in range(4) for k in range(5)}
