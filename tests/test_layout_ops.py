"""Links, boxes, selections, subtrees, tiles, neighbours and page state against brute force and hand-worked cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.operators import clusters, hierarchy, lookups, oriented, search, selecting, spans, textlayer, tiles
from pagewright.sources import factories
from pagewright.streaming import pages

CORNERS = ", ".join(f"{c} double" for c in G.CORNERS)


def test_a_link_over_three_words_is_found_by_their_places(spark):
    rows = [(1, 0, 0, "see"), (1, 0, 1, "http://ex"), (1, 0, 2, "ample.or"), (1, 0, 3, "g/a"), (1, 1, 0, "www.x.org"), (1, 1, 1, " http://y.org"), (1, 2, 0, "no"), (1, 2, 1, None), (2, 0, 5, ""), (2, 0, 7, "www."), (2, 0, 9, "z.net")]
    words = spark.createDataFrame(rows, "page int, line int, word_idx int, value string")
    got = sorted(tuple(r) for r in spans.line_links(words, ["page", "line"]).select("page", "line", "first_word", "last_word", "url").collect())
    assert got == [(1, 0, 1, 3, "http://example.org/a"), (1, 1, 0, 0, "www.x.org"), (2, 0, 7, 9, "www.z.net")]


def test_fitted_boxes_equal_the_numeric_ones(spark):
    pick = random.Random(3)
    rows, want = [], {}
    for word in range(60):
        angle = math.radians(pick.uniform(-180, 180))
        c, s = math.cos(angle), math.sin(angle)
        corners = []
        for k in range(pick.choice([2, 3, 7])):
            x, drop, h = 8.0 * k + pick.random(), pick.uniform(-1, 1), pick.uniform(5, 9)
            own = [(x, drop - h), (x + 6, drop - h), (x, drop), (x + 6, drop)]
            corners.append([(c * a - s * b + 50, s * a + c * b + 90) for a, b in own])
            rows.append((word, k, *[v for p in corners[-1] for v in p]))
        flat = np.array(corners)
        want[word] = oriented.fitted_box(flat.reshape(-1, 2), flat[:, 2:].reshape(-1, 2)).ravel()
    parts = spark.createDataFrame(rows, f"word int, ord int, {CORNERS}").select("word", "ord", F.struct(*G.CORNERS).alias("box"))
    got = {r.word: np.array(list(r.box)) for r in spans.boxes(parts, ["word"]).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[w], want[w], atol=1e-6) for w in want)


def test_spans_cover_parts_of_their_first_and_last_words(spark):
    """Three words of three letters on two rows; upright and turned by a quarter."""
    rows = []
    for page in (0, 1):
        for word, line in ((0, 0), (1, 0), (2, 1)):
            for k in range(3):
                x, y = 10.0 * k + 40 * word * (line == 0), 20.0 * line
                flat = [(x, y), (x + 10, y), (x, y + 10), (x + 10, y + 10)]
                rows.append((page, word, k, line, *[v for a, b in flat for v in ((a, b) if page == 0 else (b, -a))]))
    letters = spark.createDataFrame(rows, f"page int, word_idx int, letter_idx int, line_idx int, {CORNERS}").select("page", "word_idx", "letter_idx", "line_idx", F.struct(*G.CORNERS).alias("box"))
    asked = spark.createDataFrame([(p, i, *s) for p in (0, 1) for i, s in enumerate([(0, 1, 2, 1), (1, 2, 1, 2), (0, None, 1, None)])], "page int, span_id int, first_word int, first_letter int, last_word int, last_letter int")
    got = {(r.page, r.span_id, r.line_idx): (r.box.blx, r.box.bly, r.box.trx, r.box["try"]) for r in spans.span_boxes(asked, letters, ["page"]).collect()}
    upright = {(0, 0): (10, 10, 70, 0), (0, 1): (0, 30, 20, 20), (1, 0): (60, 10, 70, 0), (2, 0): (0, 10, 70, 0)}
    assert got == {**{(0, *k): v for k, v in upright.items()}, **{(1, *k): (v[1], -v[0], v[3], -v[2]) for k, v in upright.items()}}


def test_the_selection_after_each_event(spark):
    steps = [("extend", 1, 5, None), ("start", 2, 3, 1), ("extend", 2, 3, 0), ("extend", 2, 3, 4), ("extend", 1, 9, None), ("move", None, None, None), ("reset", None, None, None), ("start", 1, 1, None), ("extend", 1, 1, None), ("extend", 1, None, None)]
    events = spark.createDataFrame([(s, i, *e) for s in "ab" for i, e in enumerate(steps)], "s string, i int, kind string, page int, word int, letter int")
    got = selecting.states(events, ["s"], ["i"]).where("s = 'a'").orderBy("i").collect()
    assert [(r.anchor_page, r.anchor_word, r.anchor_letter, r.focus_page, r.focus_word, r.focus_letter) for r in got] == [(-1, None, -1, 1, 5, -1), (2, 3, 1, 1, 5, -1), (2, 3, 1, 2, 3, 0), (2, 3, 1, 2, 3, 4), (2, 3, 1, 1, 9, -1), (2, 3, 1, 1, 9, -1), (-1, None, -1, -1, None, -1), (1, 1, -1, -1, None, -1), (1, 1, -1, 1, 1, -1), (1, 1, -1, 1, None, -1)]
    assert [(r.is_backward, r.is_valid, r.is_selecting, r.focus_left) for r in got] == [(False, False, False, -1), (False, True, True, None), (True, True, True, 1), (False, True, True, None), (True, True, True, 2), (True, True, True, None), (True, False, False, None), (True, False, False, None), (False, True, False, -1), (False, False, False, None)]
    bad = spark.createDataFrame([("a", 0, "start", 0, 1, None)], events.schema)
    with pytest.raises(Exception, match="at least 1"):
        selecting.states(bad, ["s"], ["i"]).collect()


def test_words_at_an_index_or_an_error(spark):
    words = spark.createDataFrame([(1, 0, "a"), (1, 1, None)], "page int, word_idx int, value string")
    ask = lambda i: selecting.words_at(spark.createDataFrame([(1, i)], "page int, word_idx int"), words, ["page"]).collect()
    assert ask(0)[0].value == "a" and ask(1)[0].value is None
    with pytest.raises(Exception, match="no word at index 2"):
        ask(2)


def test_nested_sets_of_random_forests(spark):
    pick = random.Random(9)
    rows, blocks = [], {}
    for tree in range(3):
        paths = [[0]] if tree else [[0], [1]]
        for _ in range(60):
            up = pick.choice(paths)
            paths.append([*up, sum(p[:-1] == up for p in paths)])
        for n, path in enumerate(paths):
            blocks[tree, tuple(path)] = [pick.randint(0, 9) for _ in range(pick.choice([0, 0, 1, 3]))]
            rows.append((tree, n, path, blocks[tree, tuple(path)]))
    numbered = hierarchy.nested_sets(spark.createDataFrame(rows, "tree int, node int, path array<int>, block_ids array<int>"), ["tree"])
    got = {(r.tree, tuple(r.path)): (r.enter, r.leave) for r in numbered.collect()}
    under = {k: sorted(p for t, p in blocks if t == k[0] and p[: len(k[1])] == k[1]) for k in blocks}
    assert all(leave - enter + 1 == len(under[k]) and enter == sum(p < k[1] for t, p in blocks if t == k[0]) for k, (enter, leave) in got.items())
    listed: dict = {}
    for r in hierarchy.subtree_blocks(numbered, ["tree"], "path").orderBy("tree", "path", "place").collect():
        listed.setdefault((r.tree, tuple(r.path)), []).append(r.id)
    assert listed == {k: ids for k in blocks if (ids := [i for p in under[k] for i in blocks[k[0], p]])}


def test_keys_of_tiles_hold_their_levels_together(spark):
    pick = random.Random(1)
    pairs = [(pick.getrandbits(30), pick.getrandbits(30)) for _ in range(50)] + [(0, 0), (2**31 - 1, 2**31 - 1)]
    df = spark.createDataFrame(pairs, "c long, r long")
    for r in df.select("c", "r", tiles.morton(F.col("c"), F.col("r")).alias("k"), tiles.above(tiles.morton(F.col("c"), F.col("r")), F.lit(3)).alias("up"), tiles.morton(F.shiftright("c", 3), F.shiftright("r", 3)).alias("same")).collect():
        assert r.k == sum(((r.c >> i & 1) << 2 * i) | ((r.r >> i & 1) << 2 * i + 1) for i in range(31)) and r.up == r.same
    one = spark.range(1).select(tiles.grid(F.lit(600.0), F.lit(1e12), F.lit(1)).alias("g"), tiles.grid(F.lit(1.0), F.lit(1.0), F.lit(-4)).alias("s"), tiles.rect(F.lit(1), F.lit(0), F.lit(0), F.lit(600.0), F.lit(300.0)).alias("t")).first()
    assert tuple(one.g) == (3, 4194304) and tuple(one.s) == (1, 1) and tuple(one.t) == (512.0, 0.0, 88.0, 300.0)


def brute_nearest(points, of, most):
    out = {}
    for page, key, x, y in points:
        best = min(((of(x - a, y - b), k) for p, k, a, b in points if p == page and k != key), default=(None, None))
        out[page, key] = best if best[0] is not None and (most is None or best[0] < most) else (None, None)
    return out


@pytest.mark.parametrize(("distance", "most"), [("euclidean", None), ("manhattan", None), ("euclidean", 3.0)])
def test_nearest_points_with_ties_copies_and_outliers(spark, distance, most):
    pick = random.Random(5)
    points = [(0, i, float(pick.randint(0, 20)), float(pick.randint(0, 20))) for i in range(150)]
    points += [(1, 1000 + i, pick.random(), pick.random()) for i in range(200)] + [(1, 1900, 5000.0, 2.0), (1, 1901, -900.0, 77.0)]
    points += [(2, 2000, 1.0, 1.0), (3, 3000, 4.0, 4.0), (3, 3001, 4.0, 4.0), (3, 3002, 4.0, 4.0)]
    of = {"euclidean": lambda a, b: math.sqrt(a * a + b * b), "manhattan": lambda a, b: abs(a) + abs(b)}[distance]
    got = {(r.page, r.id): (r.distance, r.nearest) for r in clusters.nearest(spark.createDataFrame(points, "page int, id int, u double, v double"), ["page"], "id", "u", "v", distance, most).collect()}
    assert got == brute_nearest(points, of, most)


def test_nearest_of_no_points(spark):
    assert clusters.nearest(spark.createDataFrame([], "page int, id int, x double, y double"), ["page"], "id", "x", "y").collect() == []


def test_components_of_chains_and_hubs(spark):
    links = [(0, i + 1, i) for i in range(300)] + [(1, 5, k) for k in range(10, 60)] + [(1, 60, 61), (1, 62, None)]
    nodes = {(p, n) for p, a, b in links for n in (a, b) if n is not None}
    got = {(r.page, r.id): r.component for r in clusters.components(spark.createDataFrame(sorted(nodes), "page int, id int"), spark.createDataFrame(links, "page int, id int, to int"), ["page"], "id", "to").collect()}
    assert got == {**{(0, i): 0 for i in range(301)}, **{(1, k): 5 for k in (5, *range(10, 60))}, (1, 60): 60, (1, 61): 60, (1, 62): 62}


PAGE_EVENTS = "doc long, seq long, page int, first int, past int"


def test_held_pages_survive_a_restart_and_equal_the_batch(spark, tmp_path):
    pick = random.Random(2)
    events = [(pick.randint(0, 4), i, None, n, n + 8) if pick.random() < 0.15 and (n := pick.randint(0, 12)) is not None else (pick.randint(0, 4), i, pick.randint(0, 20), None, None) for i in range(240)]
    source, told = str(tmp_path / "in"), {}

    def sink(batch, _):
        told.update({r.doc: list(r.pages) for r in batch.collect()})

    for part in range(3):  # each part is a run of its own that goes on from the checkpoint
        spark.createDataFrame(events[part * 80 : part * 80 + 80], PAGE_EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PAGE_EVENTS).parquet(source)
        query = pages.held_stream(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        want: dict[int, list[int]] = {doc: [] for doc, *_ in events[: part * 80 + 80]}
        for r in pages.held(spark.createDataFrame(events[: part * 80 + 80], PAGE_EVENTS)).orderBy("doc", "page").collect():
            want[r.doc].append(r.page)
        assert told == want


def test_searches_word_by_word_equal_those_over_the_page(spark):
    """A query within a word goes another way than one with a blank; both give what plain Python finds."""
    pick = random.Random(6)
    words = [["".join(pick.choice("abT.on") for _ in range(pick.randint(1, 6))) for _ in range(pick.choice([1, 5, 90]))] for _ in range(40)]
    df = spark.createDataFrame([(i, 1, w) for i, w in enumerate(words)], "doc_id int, page_no int, words array<string>")
    got = sorted(tuple(r) for r in search.search(search.text_index(df), "to").select("doc_id", "word_idx", "word_count", "span_word_count", "snippet").collect())
    want = []
    for i, page in enumerate(words):
        text, at = "⁠".join(page), 0
        for k, word in enumerate(page):
            if (n := word.lower().find("to")) >= 0:
                begin = max(at + n - 10, 0)
                want.append((i, k, 1, 1, "..." + text[begin : begin + 40].replace("⁠", " ") + "..."))
            at += len(word) + 1
    assert want and got == sorted(want)
    assert sorted((r.doc_id, r.word_idx, r.value) for r in search.search_words(df, "to").collect()) == sorted((i, k, words[i][k]) for i, k, *_ in want)


def test_types_of_pages_that_a_user_adds(spark):
    class Lines:
        """A type of a user's own: a row for each line, with columns told by analyze."""

        @staticmethod
        def analyze(number, width, height, text):
            from pyspark.sql.types import IntegerType, StringType, StructType
            from pyspark.sql.udtf import AnalyzeResult

            return AnalyzeResult(StructType().add("line", IntegerType()).add("value", StringType()))

        def eval(self, number, width, height, text):
            yield from enumerate((text or "").split("|"))

    df = spark.createDataFrame([(7, 1, 10.0, 20.0, "a|b"), (7, 2, None, 5.0, None)], "doc int, number int, width double, height double, text string")
    with pytest.raises(ValueError, match="no such type"):
        factories.pages_as(df, "lines", ["doc"])
    with pytest.raises(ValueError, match="not a name"):
        factories.register(spark, "x; y", Lines)
    factories.register(spark, "lines", Lines)
    assert sorted(tuple(r) for r in factories.pages_as(df, "lines", ["doc"]).collect()) == [(7, 0, ""), (7, 0, "a"), (7, 1, "b")]
    assert [tuple(r) for r in factories.pages_as(df, "information", ["doc"]).collect()] == [(7, 1, 10.0, 20.0, False, 200.0)]


def test_mappers_of_whole_and_partial_words(spark):
    words = spark.createDataFrame([(1, 1, i, w) for i, w in enumerate(["alpha", "beta", "gamma"])], "d int, page_no int, word_idx int, value string")
    chosen = spark.createDataFrame([(1, 1, 0, 2, 1, 2, 1)], "d int, start_page int, start_word int, start_letter int, end_page int, end_word int, end_letter int")
    got = lookups.partial_words(words, chosen, ["d"], lambda: F.upper("value"), lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))).orderBy("word_idx").collect()
    assert [(r.part, r.is_partial, r.mapped) for r in got] == [("pha", True, "2-4"), ("beta", False, "BETA"), ("ga", True, "0-1")]


@pytest.mark.parametrize("keep", ["last", "first"])
def test_doubled_letters_as_one_pass_over_the_page_tells(spark, keep):
    """Chains, ties at the very reach, letters of several characters and other values in between."""
    pick = random.Random(4)
    rows = []
    for page in range(4):
        for i in range(150):
            value, width = pick.choice(["a", "b", "ffi", ""]), pick.choice([3.0, 6.0, 9.0])
            x, y = pick.choice([10.0, 11.0, 12.0, 12.5, 40.0, 41.0]) + 30 * pick.randint(0, 3), pick.choice([5.0, 6.0, 7.0, 50.0])
            rows.append((page, 1, i, value, x, y - 8, x + width, y))
    letters = spark.createDataFrame(rows, "doc_id int, page_no int, letter_idx int, value string, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for page in range(4):
        held: list = []
        for _, _, i, value, x, _, x1, y in [r for r in rows if r[0] == page]:
            reach = (x1 - x) / max(1, len(value)) / 3
            old = next((k for k, (v, _, a, b) in enumerate(held) if v == value and x - reach <= a <= x + reach and y - reach <= b <= y + reach), None)
            if old is None:
                held.append((value, i, x, y))
            elif keep == "last":
                held[old] = (value, i, x, y)
        want |= {(page, i) for _, i, _, _ in held}
    got = textlayer.dedup(letters, keep)
    assert got.columns == letters.columns and sorted((r.doc_id, r.letter_idx) for r in got.collect()) == sorted(want)
