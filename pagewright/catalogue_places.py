"""Registered queries of a document's files, places under a pointer and glyph boxes, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.catalogue import query, table
from pagewright.functions import geometry as G
from pagewright.functions import model as M
from pagewright.operators import locating, viewing
from pagewright.sources import artifacts

STAGES = ["labels", "inference", "tree"]
MODELS = ["a", "b", "c"]


@query("SELECT doc_id, " + ", ".join(f"arg_min(path, CASE model WHEN 'b' THEN 0 WHEN 'a' THEN 1 ELSE 2 END) FILTER (stage = '{s}') AS {s}" for s in STAGES) + f""" FROM (SELECT doc_id::VARCHAR AS doc_id, s.s AS stage, m.m AS model, '/out/' || s.s || '/' || m.m || '/' || doc_id || '.json' AS path
FROM (SELECT DISTINCT doc_id FROM documents) d, (SELECT unnest({STAGES!r}) AS s) s, (SELECT unnest({MODELS!r}) AS m) m WHERE (doc_id + length(s.s) + ascii(m.m)) % 3 <> 0) GROUP BY doc_id""")
def stage_files(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select("doc_id").distinct()
    named = named.select("doc_id", F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("s"))
    named = named.select("*", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("m"))
    held = named.where((F.col("doc_id") + F.length("s") + F.ascii("m")) % 3 != 0)
    files = held.select(F.concat(F.lit("/out/"), "s", F.lit("/"), "m", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"))
    return artifacts.stage_files(files, STAGES, "b")


@query("""WITH m AS (SELECT conv_id, turn, text, (conv_id + turn) % 3 = 0 AS marked FROM conversations WHERE (conv_id + turn) % 4 <> 1),
a AS (SELECT conv_id, min(turn) FILTER (NOT marked) AS p, min(turn) FILTER (marked) AS f, max(turn) FILTER (marked) AS l FROM m GROUP BY conv_id)
SELECT a.conv_id, CASE WHEN a.f IS NULL OR a.p < a.f THEN x.text END AS markdown, y.text AS marked FROM a LEFT JOIN m x ON x.conv_id = a.conv_id AND x.turn = a.p LEFT JOIN m y ON y.conv_id = a.conv_id AND y.turn = a.l""")
def markdown_members(spark, sf_dir):
    at = F.col("conv_id") + F.col("turn")
    path = F.concat(F.lit("out/Page"), F.when(at % 3 == 0, "_TREE").otherwise(""), F.when(at % 4 == 1, ".txt").otherwise(".md"))
    members = table(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("path"), "text")
    return artifacts.markdown_members(members, ["conv_id"], "turn", "_tree")


@query("SELECT page_id, 0 AS place, url AS name, length(html)::INTEGER AS n FROM pages UNION ALL SELECT page_id, 1, 'copy', length(url)::INTEGER FROM pages WHERE page_id % 2 = 0")
def embedded_files(spark, sf_dir):
    file = lambda name, held: F.struct(name.alias("name"), held.alias("bytes"))
    both = F.array_compact(F.array(file(F.col("url"), F.col("html")), F.when(F.col("page_id") % 2 == 0, file(F.lit("copy"), F.col("url")))))
    rows = artifacts.embedded(table(spark, sf_dir, "pages").select("page_id", both.alias("files")), ["page_id"])
    return rows.select("page_id", "place", "name", F.length("bytes").alias("n"))


@query("""WITH p AS (SELECT o_custkey AS k, row_number() OVER w AS page, sum(o_orderkey % 5 + 3) OVER (w ROWS UNBOUNDED PRECEDING) AS y1, o_orderkey % 5 + 3 AS h, o_orderkey % 7 AS x0, 100 - o_orderkey % 9 AS x1 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
q AS (SELECT c_custkey, c_custkey * 13 % 110 AS x, c_custkey * 7 % 60 AS y, c_custkey % 5 + 1 AS started FROM customer)
SELECT c_custkey, started, arg_min(page, abs(page - started) * 10000 + page) AS page FROM q LEFT JOIN p ON k = c_custkey AND x BETWEEN x0 AND x1 AND y BETWEEN y1 - h AND y1 GROUP BY c_custkey, started""")
def page_over(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k, (k % 5 + 3).alias("height"), (k % 7).alias("x0"), (100 - k % 9).alias("x1"))
    numbered = orders.withColumn("page", F.row_number().over(Window.partitionBy("doc").orderBy("o_orderkey")).cast("long"))
    pages = viewing.stacked(numbered, ["doc"], "page", "height").withColumnsRenamed({"top": "y0", "bottom": "y1"})
    c = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(c.alias("doc"), c.alias("id"), (c * 13 % 110).alias("x"), (c * 7 % 60).alias("y"), (c % 5 + 1).alias("at"))
    over = locating.page_over(points, pages.select("doc", "page", "x0", "y0", "x1", "y1"), ["doc"], 5.0)
    return over.select(F.col("id").alias("c_custkey"), F.col("at").alias("started"), "page")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS place, max(l_partkey) % 3 <> 0 AS seen FROM lineitem GROUP BY ALL), f AS (SELECT l_orderkey, min(place) AS a FROM s WHERE seen GROUP BY ALL),
e AS (SELECT s.l_orderkey, f.a, min(place) FILTER (NOT seen) AS b FROM s JOIN f ON f.l_orderkey = s.l_orderkey AND place >= f.a GROUP BY ALL)
SELECT e.l_orderkey, e.a AS first, max(s.place) + 1 AS past FROM e JOIN s ON s.l_orderkey = e.l_orderkey AND s.place >= e.a AND s.place < coalesce(e.b, 1000000) GROUP BY ALL""")
def thumbnails_in_view(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_partkey") % 3 != 0).alias("seen"))
    return locating.first_run(lines, ["l_orderkey"], "l_linenumber", "seen")


@query("""WITH s AS (SELECT o_custkey AS doc, o_orderkey AS id, o_orderkey * 37 % 50 AS ax, o_orderkey * 11 % 40 AS ay, o_orderkey % 30 AS bx, o_orderkey * 3 % 20 AS by_ FROM orders),
d AS (SELECT a.doc, a.id, b.id AS other, (abs(b.ax + b.bx - a.ax - a.bx) + abs(b.ay + b.by_ - a.ay - a.by_)) / 2.0 AS d FROM s a LEFT JOIN s b ON b.doc = a.doc AND b.id <> a.id)
SELECT doc, id, arg_min(other, d * 1000000000 + other) AS nearest, CAST(min(d) AS DOUBLE) AS distance FROM d GROUP BY doc, id""")
def nearest_segment(spark, sf_dir):
    k = F.col("o_orderkey")
    segments = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("id"), (k * 37 % 50).alias("ax"), (k * 11 % 40).alias("ay"), (k % 30).alias("bx"), (k * 3 % 20).alias("by"))

    def of_centres(p, q):
        return G.manhattan((p["ax"] + p["bx"]) / 2, (p["ay"] + p["by"]) / 2, (q["ax"] + q["bx"]) / 2, (q["ay"] + q["by"]) / 2)

    found = locating.nearest_of_page(segments, ["doc"], "id", ["ax", "ay", "bx", "by"], of_centres)
    return found.withColumn("distance", F.col("distance").cast("double"))


@query("""WITH g AS (SELECT p_partkey, (p_size % 7 + 1)::DOUBLE AS w, (p_size % 4)::DOUBLE AS asc_, 1.0 + p_size % 3 AS a, 0.25 * (p_partkey % 3) AS b, 0.5 * (p_partkey % 2) AS c, CASE WHEN p_partkey % 4 = 0 THEN -2.0 ELSE 2.0 END AS d, p_partkey % 100 AS e, p_partkey % 90 AS f FROM part),
h AS (SELECT *, greatest(asc_, 1.0) AS t, 800 - f AS base FROM g),
u AS (SELECT *, a * 0.5 + c * 3 + e AS hx, 800 - (b * 0.5 + d * 3 + f) AS hy, a * 0.5 - c + e AS lx, 800 - (b * 0.5 - d + f) AS ly, a * w AS dx, -(b * w) AS dy FROM h)
SELECT p_partkey, (e)::DOUBLE AS blx, (base)::DOUBLE AS bly, (a * w + c * t + e)::DOUBLE AS trx, (base - b * w - d * t)::DOUBLE AS try_,
(CASE WHEN dx * (hy - ly) - dy * (hx - lx) > 0 THEN lx ELSE hx END)::DOUBLE AS drawn_tlx, (CASE WHEN dx * (hy - ly) - dy * (hx - lx) > 0 THEN ly ELSE hy END)::DOUBLE AS drawn_tly, (a * w + e)::DOUBLE AS drawn_brx, (base - b * w)::DOUBLE AS drawn_bry FROM u""")
def glyph_boxes(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    at = F.struct((1.0 + size % 3).alias("a"), (0.25 * (k % 3)).alias("b"), (0.5 * (k % 2)).alias("c"), F.when(k % 4 == 0, -2.0).otherwise(2.0).alias("d"), (k % 100).alias("e"), (k % 90).alias("f"))
    w = (size % 7 + 1).cast("double")
    x0, x1, y0, y1 = F.lit(0.5), w + 0.5, F.lit(-1.0), F.lit(3.0)
    rows = part.select("p_partkey", w.alias("w"), (size % 4).cast("double").alias("ascent"), at.alias("m"), G.box(x0, y1, x1, y1, x0, y0, x1, y0).alias("bounds"))
    height = F.lit(800.0)
    boxes = rows.select("p_partkey", G.glyph_box(F.col("w"), F.col("ascent"), F.col("m"), height).alias("g"), G.drawn_glyph_box(F.col("bounds"), F.col("m"), height).alias("d"))
    return boxes.select("p_partkey", "g.blx", "g.bly", "g.trx", F.col("g.try").alias("try_"), F.col("d.tlx").alias("drawn_tlx"), F.col("d.tly").alias("drawn_tly"), F.col("d.brx").alias("drawn_brx"), F.col("d.bry").alias("drawn_bry"))


#: Operators of a made-up content stream.
STREAM = ["BT", "re", "Tj", "S", "Tm", "f", "ET", "sh", "q", "W"]


@query("SELECT event_id, (" + repr(STREAM) + ")[event_id % 10 + 1] AS operator FROM events WHERE event_id % 10 IN (0, 2, 4, 6, 8)")
def text_operators(spark, sf_dir):
    operator = F.get(F.array(*[F.lit(o) for o in STREAM]), (F.col("event_id") % 10).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", operator.alias("operator")).where(M.bears_on_text(F.col("operator")))


@query("WITH l AS (SELECT l_orderkey, sum(l_partkey % 9 + 1) AS total, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, 10.0 * total / (n * 50) BETWEEN 0.8 AND 1.2 AS kept FROM l")
def letter_widths(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 9 + 1).cast("double")).alias("widths"))
    return words.select("l_orderkey", M.consistent_widths(F.col("widths"), F.size("widths") * 5.0).alias("kept"))
