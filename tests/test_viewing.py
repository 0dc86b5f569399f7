"""Hand-worked cases of what readers see and touch, of trees and of archives."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import hierarchy as H
from pagewright.operators import viewing as V
from pagewright.sinks import markdown
from pagewright.sources import archives, blocks_json


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_zoom_steps_stop_at_both_ends(spark):
    z = spark.createDataFrame([(z,) for z in (0.01, 0.08, 0.9, 1.0, 64.0)], "z double")
    assert [tuple(r) for r in z.select(V.next_zoom(F.col("z")), V.previous_zoom(F.col("z"))).collect()] == [(0.08, 0.08), (0.125, 0.08), (1.0, 0.75), (1.25, 0.75), (64.0, 48.0)]


def test_the_page_with_most_area_in_view_counts_and_a_touch_is_none(spark):
    pages = spark.createDataFrame([(1, 1, 10, 0, 9), (1, 2, 10, 0, 4), (1, 3, 8, 0, 9), (1, 4, 10, 2, 11), (1, 5, 10, 0, 9)], "d int, page int, height int, left int, right int")
    views = spark.createDataFrame([(1, 10, 38, 1, 9)], "d int, view_top int, view_bottom int, view_left int, view_right int")
    seen = V.visible(V.stacked(pages, ["d"], "page", "height"), views, ["d"], "page")
    assert rows(seen) == [(1, 2, 30.0), (1, 3, 64.0), (1, 4, 70.0)]
    assert rows(V.most_visible(seen, ["d"], "page")) == [(1, 2, 4, 4)]
    ties = V.visible(V.stacked(pages.where("page IN (1, 5)"), ["d"], "page", "height"), views.withColumn("view_top", F.lit(5)).withColumn("view_bottom", F.lit(15)), ["d"], "page")
    assert rows(V.most_visible(ties, ["d"], "page")) == [(1, 1, 5, 1)]


def test_hit_test_takes_the_first_box_and_counts_borders(spark):
    boxes = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 10.0), (1, 3, 10.0, 0.0, 95.0, 10.0), (2, 1, 0.0, 0.0, 50.0, 50.0)], "page int, id int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 10.0, 5.0), (1, 9.0, 5.0), (1, 9.0, 5.0), (1, 96.0, 5.0), (1, 94.0, 10.0), (None, 1.0, 1.0)], "page int, x double, y double")
    got = {(r.page, r.x, r.y, r.box) for r in V.hit_test(points, boxes, ["page"], 16.0).collect()}
    assert got == {(1, 10.0, 5.0, 3), (1, 9.0, 5.0, 7), (1, 96.0, 5.0, None), (1, 94.0, 10.0, 3), (None, 1.0, 1.0, None)}
    assert V.hit_test(points, boxes, ["page"], 16.0).count() == 6


@pytest.mark.parametrize("back", [False, True])
def test_selection_bounds_its_first_and_last_page_only(spark, back):
    words = spark.createDataFrame([(1, p, w) for p in (1, 2, 3) for w in (0, 1, 2)], "d int, page_no int, word_idx int")
    ends = (3, 0, 1, 2) if back else (1, 2, 3, 0)
    chosen = spark.createDataFrame([(1, *ends)], "d int, anchor_page int, anchor_word int, focus_page int, focus_word int")
    assert rows(V.selected(words, chosen, ["d"])) == [(1, 1, 2, back), (1, 2, 0, back), (1, 2, 1, back), (1, 2, 2, back), (1, 3, 0, back)]


def test_tiles_go_clockwise_from_the_top_in_rings(spark):
    tiles = spark.createDataFrame([(1, c, r) for c in range(3) for r in range(3)], "page int, col int, row int")
    got = V.tile_order(tiles, F.lit(1.5), F.lit(1.5)).orderBy("page", F.round("distance2", 9), "angle").collect()
    assert [(r.col, r.row) for r in got] == [(1, 1), (1, 0), (2, 1), (1, 2), (0, 1), (2, 0), (2, 2), (0, 2), (0, 0)]


def test_fallback_prefers_the_nearest_coarser_tile(spark):
    form = "page int, level int, col int, row int"
    wanted = spark.createDataFrame([(1, 3, 5, 6), (1, 0, 1, 0), (2, 3, 5, 6)], form)
    held = spark.createDataFrame([(1, 1, 1, 1), (1, 0, 0, 0), (1, 4, 10, 12), (1, 2, 4, 3), (2, 2, 0, 0)], form)
    assert {tuple(r) for r in V.tile_fallback(wanted, held).collect()} == {(1, 3, 5, 6, 1), (1, 0, 1, 0, 2), (2, 3, 5, 6, None)}


def test_paths_sort_in_pre_order_and_leave_out_what_no_root_reaches(spark):
    nodes = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "a", 0), ("d", "c", 0), ("x", "y", 0)], "node_id string, parent_id string, place int")
    got = H.paths(nodes).orderBy("path").collect()
    assert [(r.node_id, r.path, r.depth) for r in got] == [("a", [0], 0), ("c", [0, 0], 1), ("d", [0, 0, 0], 2), ("b", [0, 1], 1)]


def test_nearest_word_while_selecting(spark):
    box = "page int, line int, x0 double, x1 double, y1 double"
    lines = spark.createDataFrame([(1, 0, 0.0, 100.0, 10.0), (1, 1, 0.0, 40.0, 30.0), (1, 2, 80.0, 90.0, 30.0), (1, 3, 5.0, 5.0, 12.0)], box)
    words = spark.createDataFrame([(1, 0, 0, 0.0, 30.0, 10.0), (1, 0, 1, 35.0, 100.0, 10.0), (1, 1, 2, 0.0, 15.0, 30.0), (1, 1, 3, 20.0, 40.0, 30.0), (1, 2, 4, 80.0, 90.0, 30.0)], "page int, line int, word_idx int, x0 double, x1 double, y1 double")
    # In line 0; beside the second line, where height counts more than width; left of all; tie of corners; other page; no key.
    points = spark.createDataFrame([(1, 1, 34.0, 11.0), (2, 1, 60.0, 29.0), (3, 1, -1.0, 10.0), (4, 1, 17.5, 30.0), (5, 2, 1.0, 1.0), (6, 1, 101.0, 30.0), (None, 1, 1.0, 1.0)], "id int, page int, x double, y double")
    got = V.nearest_while_selecting(points, lines, words, ["page"], "id").where("id IS NOT NULL").select("id", "line", "word_idx")
    assert rows(got) == [(1, 0, 1), (2, 1, 3), (3, None, None), (4, 1, 2), (5, None, None), (6, 2, 4)]
    assert V.nearest_while_selecting(points, lines, words, ["page"], "id").where("id IS NULL").first().line is None


def test_block_lookup_takes_the_first_block_and_drops_missing_ones(spark):
    nodes = spark.createDataFrame([(1, 10, 0, [5, 9, 6]), (1, 11, 1, [5]), (1, 12, 2, [])], "d int, node_id int, preorder int, block_ids array<int>")
    blocks = spark.createDataFrame([(1, 5, 1, "late"), (1, 5, 0, "first"), (1, 6, 2, "six")], "d int, id int, place int, content string")
    got = H.block_lookup(nodes, blocks, ["d"]).select("node_id", "place", "content")
    assert rows(got) == [(10, 0, "first"), (10, 2, "six"), (11, 0, "first")]
    assert rows(H.blocks_by_first_id(nodes, ["d"])) == [(1, 5, [5])]


def test_tree_json_to_rows_and_markdown(spark):
    tree = {"title": "T", "block_ids": [1, 2], "children": [{"title": "A", "children": [{"title": "B", "block_ids": [3]}]}, {"title": "C"}]}
    raw = spark.createDataFrame([(1, json.dumps(tree)), (2, "nonsense"), (3, None)], "d int, json string")
    nodes = archives.tree_json(raw)
    assert rows(nodes.select("d", "path", "title", "n_blocks")) == [(1, [0], "T", 2), (1, [0, 0], "A", 0), (1, [0, 0, 0], "B", 1), (1, [0, 1], "C", 0)]
    text = markdown.documents(nodes.select("d", "path", F.lit("title").alias("kind"), (F.size("path") - 1).alias("level"), "title", F.lit("").alias("content")), ["d"])
    assert text.first().markdown == "# T\n\n## A\n\n### B\n\n## C\n\n"


def test_archive_members_by_priority(spark):
    """What holds no result is passed over, down to a content list, after which nothing is tried."""
    block, tree, bare = '{"pages": {"1": [{}]}}', '{"tree": {"title": "t"}}', '{"pages": {"1": []}, "tree": null}'

    def packed(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, text in members:
                z.writestr(n, text)
        return out.getvalue()

    files = {
        "first": (packed(("x.json", block), ("a_content_list.json", "[{}]"), ("d/a_middle.json", tree)), "d/a_middle.json"),
        "broken": (packed(("a_middle.json", "{"), ("b_middle.json", block), ("middle.json", block)), "middle.json"),
        "list": (packed(("x.json", block), ("a_middle.json", bare), ("a_content_list.json", "[{}]")), "a_content_list.json"),
        "ends": (packed(("x.json", block), ("a_content_list.json", "[]")), None),
        "any": (packed(("z.txt", "x"), ("w.json", "[1]"), ("x.json", bare), ("y.json", block)), "y.json"),
        "none": (packed(("t.txt", "x")), None),
        "bad": (b"broken", None),
        "null": (None, None),
    }
    got = archives.archived_json(spark.createDataFrame([(k, v[0]) for k, v in files.items()], "path string, content binary"))
    assert {r.path: r.member for r in got.collect()} == {k: v[1] for k, v in files.items()}
    assert {r.json for r in got.where("path = 'any'").collect()} == {block}


def test_inference_stands_in_for_missing_pages(spark):
    form = "doc_id int, blocks array<int>"
    pages, inference = spark.createDataFrame([(1, [1])], form), spark.createDataFrame([(1, [2]), (2, [3])], form)
    trees = spark.createDataFrame([(2, "t"), (3, "u")], "doc_id int, tree string")
    got = blocks_json.combined(pages, inference, trees).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, [1], [2], None, True, True, False), (2, [3], [3], "t", False, True, True), (3, None, None, "u", False, False, True)]


def test_flat_files_are_an_array_or_nothing(spark):
    raw = spark.createDataFrame([('[{"text": "a", "category": "title", "box": [1, 2, 3, 5]}, {"content": "b", "text": "c", "page": 4}]',), ('{"a": 1}',), (None,)], "json string")
    got = blocks_json.content_list_json(raw).orderBy("id").select("id", "page", "type", "content").collect()
    assert [tuple(r) for r in got] == [(0, 1, "title", "a"), (1, 4, "text", "c")]
    assert blocks_json.inference_json(raw).where("place = 1").first().content == "b"


def test_tree_nodes_have_boxes_of_their_pages(spark):
    tree = {"title": "T", "location": [{"page": 1, "bbox": [0, 0, 2000, 10]}, {"page": 3, "bbox": [0, 0, 2000, 10]}, {"bbox": [1]}], "children": [{"level": 2, "block_ids": [1, 2], "title": "a"}]}
    raw = spark.createDataFrame([(1, json.dumps({"page_size": {"1": [1000, 500], "x": [1, 1], "3": [5]}, "tree": tree})), (2, "[1]"), (3, "no"), (4, '{"tree": null}'), (5, '{"tree": "text"}')], "d int, json string")
    got = blocks_json.tree_nodes(raw, ["d"], under="$.tree", normalised=True).orderBy("path").collect()
    assert [(r.d, r.path, r.title, r.level, r.block_ids, r.n_children) for r in got] == [(1, [0], "T", 0, [], 1), (1, [0, 0], "a", 2, [1, 2], 0)]
    assert [tuple(x) for x in got[0].locations] == [(1, 0.0, 0.0, 2.0, 0.02), (3, 0.0, 0.0, 2000.0, 10.0), (0, 0.0, 0.0, 0.0, 0.0)]


def test_markdown_goes_to_a_folder_for_each_document(spark, tmp_path):
    nodes = spark.createDataFrame([(1, [0, 1], "title", 1, "B", ""), (1, [0], "title", 0, "A", ""), (2, [0], "caption", 0, "", "c")], "d int, path array<int>, kind string, level int, title string, content string")
    markdown.write(nodes, "d", str(tmp_path / "out"))
    assert [p.read_text() for d in (1, 2) for p in (tmp_path / "out" / f"d={d}").glob("part-*")] == ["# A\n\n## B\n\n\n", "*c*\n\n\n"]


def test_trees_of_any_depth_are_read_whole(spark):
    from pagewright.sources import archives

    tree = {"title": "leaf", "block_ids": [1, 2]}
    for level in range(30, 0, -1):
        tree = {"title": f"n{level}", "block_ids": [], "children": [{"title": "side"}, tree]}
    raw = spark.createDataFrame([(7, json.dumps(tree)), (8, "no tree")], "id int, json string")
    got = {tuple(r.path): (r.id, r.title, r.n_blocks) for r in archives.tree_json(raw).collect()}
    assert len(got) == 61 and got[(0, *[1] * 30)] == (7, "leaf", 2) and got[(0, *[1] * 29, 0)] == (7, "side", 0) and got[(0,)] == (7, "n1", 0)
