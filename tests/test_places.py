"""Hand-worked cases of files of a document, places under a pointer, glyph boxes and the streams."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright import streaming
from pagewright.functions import geometry as G
from pagewright.functions import model as M
from pagewright.operators import locating
from pagewright.sources import artifacts


def test_stage_files_prefer_the_wanted_model(spark):
    paths = ["/o/tree/b/x.json", "/o/tree/a/x.json", "/o/inference/c/x.json", "/o/inference/b/x.json", "/o/tree/b/y.txt", "/o/other/a/z.json"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = artifacts.stage_files(files, ["inference", "tree"], "a").collect()
    assert [tuple(r) for r in got] == [("x", "/o/inference/b/x.json", "/o/tree/a/x.json")]


@pytest.mark.parametrize(
    ("names", "plain", "marked"),
    [(["a.md", "b.md"], 0, None), (["a_T.md", "b.md"], None, 0), (["a.md", "a_t.MD", "b_t.md"], 0, 2), (["a.txt"], "none", None), (["x.txt", "b.md"], 1, None)],
)
def test_markdown_members(spark, names, plain, marked):
    members = spark.createDataFrame([(1, i, n, str(i)) for i, n in enumerate(names)], "k int, place int, path string, text string")
    got = [tuple(r) for r in artifacts.markdown_members(members, ["k"], "place", "_t").collect()]
    text = lambda i: None if i is None else str(i)
    assert got == ([] if plain == "none" else [(1, text(plain), text(marked))])


def test_embedded_files_are_listed_and_saved_whole(spark, tmp_path):
    rows = [(1, [("a/b.txt", b"one"), ("a/b.txt", b"two"), (None, None)]), (2, [("c", b"")]), (3, None)]
    documents = spark.createDataFrame(rows, "doc_id int, files array<struct<name:string,bytes:binary>>")
    listed = artifacts.embedded(documents, ["doc_id"])
    for _ in range(2):
        artifacts.save(listed, str(tmp_path))
    held = {os.path.relpath(os.path.join(d, f), tmp_path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(tmp_path) for f in fs}
    assert held == {"1/0/a_b.txt": b"one", "1/1/a_b.txt": b"two", "1/2/file": b"", "2/0/c": b""}


def test_a_path_is_opened_once(spark):
    files = spark.createDataFrame([("p", 2, "late"), ("p", 1, "early"), ("q", 5, "only")], "path string, at int, who string")
    assert {tuple(r) for r in artifacts.opened_once(files, F.col("at")).select("path", "who").collect()} == {("p", "early"), ("q", "only")}


def test_page_under_a_point_at_borders_gaps_and_nowhere(spark):
    pages = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 10.0, 10.0, 20.0), (1, 3, 2.0, 25.0, 8.0, 60.0)], "d int, page int, x0 double, y0 double, x1 double, y1 double")
    rows = [(1, 1, 5.0, 10.0, 1), (1, 2, 5.0, 10.0, 2), (1, 3, 5.0, 10.0, 3), (1, 4, 5.0, 22.0, 1), (1, 5, 1.0, 30.0, 1), (1, 6, 3.0, 59.0, 1), (1, 7, None, 5.0, 1), (2, 8, 5.0, 5.0, 1)]
    points = spark.createDataFrame(rows, "d int, id int, x double, y double, at int")
    got = {r.id: r.page for r in locating.page_over(points, pages, ["d"], 7.0).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: None, 5: None, 6: 3, 7: None, 8: None}


def test_first_run_ends_at_the_first_hidden(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, True), (1, 4, None), (1, 5, True), (2, 1, False), (3, 4, True), (3, 6, True)]
    places = spark.createDataFrame(rows, "d int, n int, seen boolean")
    assert {tuple(r) for r in locating.first_run(places, ["d"], "n", "seen").collect()} == {(1, 2, 4), (3, 4, 7)}


def test_nearest_of_page_takes_the_first_of_equals_and_no_nan(spark):
    rows = [(1, 0, 0.0), (1, 1, 2.0), (1, 2, -2.0), (1, 3, float("nan")), (2, 9, 1.0)]
    points = spark.createDataFrame(rows, "page int, id int, x double")
    got = {r.id: (r.nearest, r.distance) for r in locating.nearest_of_page(points, ["page"], "id", ["x"], lambda a, b: F.abs(a["x"] - b["x"])).collect()}
    assert got == {0: (1, 2.0), 1: (0, 2.0), 2: (0, 2.0), 3: (None, None), 9: (None, None)}


def test_glyph_boxes(spark):
    matrix = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (2, 0, 0, 2, 10, 30), strict=True)])
    flipped = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (2, 0, 0, -2, 10, 30), strict=True)])
    bounds = G.box(*[F.lit(float(v)) for v in (1, 3, 5, 3, 1, -1, 5, -1)])
    high = F.lit(100.0)
    r = spark.range(1).select(G.glyph_box(F.lit(4.0), F.lit(0.5), matrix, high).alias("g"), G.drawn_glyph_box(bounds, matrix, high).alias("d"), G.drawn_glyph_box(bounds, flipped, high).alias("f")).first()
    assert tuple(r.g) == (10, 68, 18, 68, 10, 70, 18, 70)
    assert tuple(r.d) == (12, 64, 20, 64, 10, 70, 18, 70)
    assert (r.f.tlx, r.f.tly) == (12, 68) and (r.f.blx, r.f.bly) == (10, 70)


def test_operators_and_widths(spark):
    r = spark.range(1).select(
        M.bears_on_text(F.lit("TJ")).alias("a"),
        M.bears_on_text(F.lit("re")).alias("b"),
        *[M.consistent_widths(F.array(*[F.lit(float(w)) for w in ws]).cast("array<double>"), F.lit(10.0)).alias(f"w{i}") for i, ws in enumerate([[4, 4], [4, 3.9], [6, 6], [6, 6.1], []])],
    ).first()
    assert tuple(r) == (True, False, True, False, True, False, False)


def test_documents_are_opened_as_they_arrive(spark, tmp_path):
    into, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    into.mkdir()
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (into / name).write_bytes(b"x")

    def run():
        stream = streaming.opened(spark, str(into)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        stream.awaitTermination()
        return sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(out).collect())

    assert run() == ["a.pdf", "b.PDF"]
    (into / "d.pdf").write_bytes(b"y")
    assert run() == ["a.pdf", "b.PDF", "d.pdf"]


def test_notices_are_not_repeated(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:03"), ("b", "2024-01-01 00:00:04")]
    spark.createDataFrame(rows, "text string, at string").selectExpr("text", "to_timestamp(at) AS at").write.parquet(source)
    stream = streaming.not_repeated(spark.readStream.schema("text string, at timestamp").parquet(source), "at", ["text"], "10 seconds")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b"]
