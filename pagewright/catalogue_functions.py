"""Registered queries of single functions over whole tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.catalogue import query, table
from pagewright.functions import geometry as G
from pagewright.functions import layoutmath as M
from pagewright.functions import model
from pagewright.functions import text as T
from pagewright.operators import hierarchy as H
from pagewright.operators import lookups as U
from pagewright.operators import relations as R
from pagewright.operators import selecting
from pagewright.sources import blocks_json, factories


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(x) AS word, unnest(range(0, len(x))) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS x FROM conversations))
SELECT conv_id, turn, CAST(i AS INTEGER) AS i, regexp_matches(right(word, 1), '^\p{P}*$') AS is_punctuation, regexp_matches(CASE WHEN i % 3 = 0 THEN chr(160) || ' ' ELSE word END, '^\p{Z}*$') AS is_separator, left(rpad(word, 15, ' '), 15) AS log_name,
regexp_replace(translate('a' || word || '/b:c?', chr(10), ' '), '["<>|:*?\\/]', '-', 'g') AS safe FROM w""")
def word_classes(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    odd = F.when(F.col("i") % 3 == 0, " ").otherwise(F.col("word"))
    named = T.safe_name(F.translate(F.concat(F.lit("a"), "word", F.lit("/b:c?")), "\n", " "), "-")
    return words.select("conv_id", "turn", "i", T.is_punctuation(F.right("word", F.lit(1))).alias("is_punctuation"), T.is_separator(odd).alias("is_separator"), T.log_name(F.col("word")).alias("log_name"), named.alias("safe"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 1100 + 1)::BIGINT * pow(1024, o_orderkey % 5)::BIGINT END * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS n FROM orders),
m AS (SELECT o_orderkey, n, CASE WHEN n = 0 THEN 0 ELSE (length(abs(n)::BIT::VARCHAR) - strpos(abs(n)::BIT::VARCHAR, '1')) // 10 END AS mag FROM s),
u AS (SELECT *, round(abs(n) / pow(1024.0, mag), 1) >= 1000 AS up FROM m)
SELECT o_orderkey, CASE WHEN n < 0 THEN '-' ELSE '' END || printf('%.1f', abs(n) / pow(1024.0, mag + up::INT)) || ' ' || (['bytes', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB'])[mag + up::INT + 1] AS size FROM u""")
def readable_sizes(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.when(k % 7 == 0, 0).otherwise((k % 1100 + 1) * F.pow(F.lit(1024.0), k % 5).cast("long")) * F.when(k % 3 == 0, -1).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.readable_size(n).alias("size"))


@query("""WITH d AS (SELECT event_id, event_id % 5 AS form, ts FROM events)
SELECT event_id, CASE form WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' +05:30' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' -08:00' WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' +00:00' WHEN 3 THEN 'D:2024' ELSE 'D:20241399' || strftime(ts, '%H%M%S') END AS shown FROM d""")
def pdf_dates(spark, sf_dir):
    k, plain = F.col("event_id"), F.date_format("ts", "yyyyMMddHHmmss")
    forms = [F.concat(F.lit("D:"), plain, F.lit("+05'30'")), F.concat(plain, F.lit("-08'00")), F.concat(F.lit("D:"), plain, F.lit("Z")), F.lit("D:2024"), F.concat(F.lit("D:20241399"), F.date_format("ts", "HHmmss"))]
    raw = F.get(F.array(*forms), (k % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.pdf_date(raw).alias("shown"))


@query("""WITH g AS (SELECT p_partkey, 100 + p_partkey % 7 * 50 AS cw, 120 + p_partkey % 5 * 40 AS ch, 50 + p_size AS bw, 60 + p_size % 13 * 3 AS bh, (72 + p_size % 11 * 40)::DOUBLE AS pw, (72 + p_size % 7 * 60)::DOUBLE AS ph, CASE p_partkey % 4 WHEN 0 THEN 'fit' WHEN 1 THEN 'actual' WHEN 2 THEN 'shrink' ELSE 'custom' END AS mode, p_partkey * 7 % 600 AS scale, 100.0 AS dpi FROM part),
o AS (SELECT *, pw / 72 * dpi AS ow, ph / 72 * dpi AS oh, least(cw / bw::DOUBLE, ch / bh::DOUBLE) AS fit, greatest(10, least(400, scale)) / 100.0::DOUBLE AS share FROM g),
w AS (SELECT *, trunc(CASE mode WHEN 'fit' THEN bw * fit WHEN 'actual' THEN ow WHEN 'custom' THEN ow * share ELSE ow * least(1.0, cw / ow, ch / oh) END)::INTEGER AS w, trunc(CASE mode WHEN 'fit' THEN bh * fit WHEN 'actual' THEN oh WHEN 'custom' THEN oh * share ELSE oh * least(1.0, cw / ow, ch / oh) END)::INTEGER AS h FROM o)
SELECT p_partkey, (5 + trunc((cw - w) / 2.0))::INTEGER AS x, (7 + trunc((ch - h) / 2.0))::INTEGER AS y, w, h, floor(0.299::DOUBLE * (p_partkey % 256) + 0.587::DOUBLE * (p_partkey * 3 % 256) + 0.114::DOUBLE * (p_partkey * 7 % 256) + 0.5)::INTEGER AS luma, pw > ph AS landscape, (bw + 270) % 360 AS turned, round(greatest(0.08, least(64.0, 0.97 * cw / pw)), 9)::DOUBLE AS zoom FROM w""")
def print_placement(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    cell = F.struct(F.lit(5).alias("x"), F.lit(7).alias("y"), (100 + k % 7 * 50).cast("int").alias("w"), (120 + k % 5 * 40).cast("int").alias("h"))
    pw, ph, bw = (72 + size % 11 * 40).cast("double"), (72 + size % 7 * 60).cast("double"), 50 + size
    mode = F.get(F.array(*[F.lit(m) for m in ("fit", "actual", "shrink", "custom")]), (k % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell"), pw.alias("pw"), ph.alias("ph"), bw.alias("bw"), (60 + size % 13 * 3).alias("bh"), mode.alias("mode"), (k * 7 % 600).alias("scale"))
    at = M.placed(F.col("cell"), F.col("bw"), F.col("bh"), F.col("pw"), F.col("ph"), F.lit(100), F.lit(100), F.col("mode"), F.col("scale"))
    return rows.select("p_partkey", at.alias("r"), M.luma(k % 256, k * 3 % 256, k * 7 % 256).alias("luma"), M.is_landscape(F.col("pw"), F.col("ph")).alias("landscape"), M.rotate(F.col("bw"), 270).alias("turned"), F.round(M.fit_width(F.col("cell.w"), F.col("pw")), 9).alias("zoom")).select("p_partkey", "r.*", "luma", "landscape", "turned", "zoom")


@query("""WITH b AS (SELECT event_id, (event_id % 19)::DOUBLE AS x0, (event_id % 17)::DOUBLE AS y0, (event_id % 19 + 5)::DOUBLE AS x1, (event_id % 17 + 4)::DOUBLE AS y1 FROM events)
SELECT event_id, x0 < 12 AND 8 < x1 AND y0 < 15 AND 10 < y1 AS seen, x0 AS tlx, y0 AS tly, x1 AS brx, y1 AS bry, round(sqrt(2 * x0 * x0 + 0.5 * y0 * y0), 4)::DOUBLE AS weighted, ((event_id % 1000 - 500) % 360 + 360) % 360 + 0.25::DOUBLE AS bound, CASE event_id % 5 WHEN 1 THEN 'gray' WHEN 3 THEN 'rgb' WHEN 4 THEN 'cmyk' END AS space FROM b""")
def boxes_in_view(spark, sf_dir):
    k = F.col("event_id")
    x0, y0 = (k % 19).cast("double"), (k % 17).cast("double")
    # The corners come in another turn than they are named.
    b = G.axis_aligned(G.box(x0 + 5, y0 + 4, x0, y0 + 4, x0 + 5, y0, x0, y0))
    lit = lambda v: F.lit(float(v))
    seen = G.intersects(x0, y0, x0 + 5, y0 + 4, lit(8), lit(10), lit(12), lit(15))
    bound = G.bound_360((k % 1000 - 500).cast("double") + 0.25)
    space = model.colour_space(F.array_repeat(F.lit(0.5), (k % 5).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", seen.alias("seen"), b.alias("b"), F.round(G.weighted_euclidean(F.lit(0.0), F.lit(0.0), x0, y0, 2.0, 0.5).cast("double"), 4).alias("weighted"), bound.alias("bound"), space.alias("space")).select("event_id", "seen", "b.tlx", "b.tly", "b.brx", "b.bry", "weighted", "bound", "space")


@query("SELECT conv_id AS doc_id, CAST(1 AS INTEGER) AS page_no, role AS block, turn AS line, CAST(i AS INTEGER) AS word, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn, i) - 1 AS word_idx FROM (SELECT conv_id, role, turn, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations)")
def word_ordinals(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("role").alias("block"), F.col("turn").alias("line"), F.posexplode(F.split("text", " ")).alias("word", "value")).drop("value")
    return R.ordinals(words).withColumn("word_idx", F.col("word_idx").cast("long"))


# A node for each order; nodes of a customer that share their first block overwrite each other in pre-order.
@query("""WITH n AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS preorder, o_orderkey % 5 AS first_id, list_transform(range(0, o_orderkey % 3), lambda j: o_orderkey % 5 + j * 2) AS ids FROM orders)
SELECT o_custkey, first_id, array_to_string(arg_max(ids, preorder), ',') AS block_ids FROM n WHERE len(ids) > 0 GROUP BY o_custkey, first_id""")
def blocks_by_first_id(spark, sf_dir):
    k = F.col("o_orderkey")
    ids = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(0), F.greatest(k % 3 - 1, F.lit(0))), lambda j: k % 5 + j * 2)).otherwise(F.array().cast("array<long>"))
    nodes = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("preorder"), ids.alias("block_ids"))
    return H.blocks_by_first_id(nodes, ["o_custkey"]).select("o_custkey", "first_id", F.array_join("block_ids", ",").alias("block_ids"))


@query("""WITH p AS (SELECT doc_id, string_split(left(text, 200), ' ') AS x FROM documents WHERE doc_id % 3 <> 0), i AS (SELECT doc_id, [source, lang] AS x FROM documents WHERE doc_id % 4 <> 0), t AS (SELECT doc_id, lang AS tree FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, array_to_string(coalesce(p.x, i.x), '|') AS pages, array_to_string(i.x, '|') AS inference, tree, p.x IS NOT NULL AS has_pages, i.x IS NOT NULL AS has_inference, tree IS NOT NULL AS has_tree FROM (SELECT doc_id FROM documents) LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN t USING (doc_id) WHERE p.x IS NOT NULL OR i.x IS NOT NULL OR tree IS NOT NULL""")
def stages_combined(spark, sf_dir):
    docs: DataFrame = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    pages = docs.where(k % 3 != 0).select("doc_id", F.split(F.left("text", F.lit(200)), " ").alias("blocks"))
    inference = docs.where(k % 4 != 0).select("doc_id", F.array("source", "lang").alias("blocks"))
    found = blocks_json.combined(pages, inference, docs.where(k % 5 != 0).select("doc_id", F.col("lang").alias("tree")))
    return found.withColumns({c: F.array_join(c, "|") for c in ("pages", "inference")})


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS number, o_totalprice AS width, o_shippriority AS height, o_totalprice > o_shippriority AS landscape, o_totalprice * o_shippriority AS area FROM (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 100 * 3000)::DOUBLE END AS o_shippriority FROM orders) QUALIFY o_shippriority IS NOT NULL")
def page_information(spark, sf_dir):
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = table(spark, sf_dir, "orders").select("o_custkey", place.alias("number"), F.col("o_totalprice").alias("width"), F.when(k % 6 != 0, (k % 100 * 3000).cast("double")).alias("height"), F.col("o_orderstatus").alias("text"))
    return factories.pages_as(pages, "information", ["o_custkey"])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(event_id % 13 - 6), event_id) - 1 AS place FROM events")
def sorted_collection(spark, sf_dir):
    return U.sorted_places(table(spark, sf_dir, "events"), ["user_id"], lambda: F.abs(F.col("event_id") % 13 - 6), ["event_id"]).select("event_id", "place")


@query("""WITH w AS (SELECT conv_id, unnest(string_split(text, ' ')) AS value, turn FROM conversations),
n AS (SELECT conv_id, count(*) AS n FROM w GROUP BY conv_id),
o AS (SELECT conv_id, turn, unnest(x) AS value, unnest(range(0, len(x))) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS x FROM conversations)),
r AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS word_idx FROM o)
SELECT event_id, r.conv_id, r.word_idx, r.value, n AS n_words FROM events JOIN n ON n.conv_id = user_id % 100 JOIN r ON r.conv_id = n.conv_id AND r.word_idx = event_id * 31 % n""")
def word_at_index(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "value"))
    words = turns.withColumn("word_idx", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")) - 1).cast("long"))
    counts = words.groupBy("conv_id").agg(F.count("*").alias("n_words"))
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("conv_id")).join(counts, "conv_id").withColumn("word_idx", F.col("event_id") * 31 % F.col("n_words"))
    return selecting.words_at(asked, words, ["conv_id"])


@query("SELECT p_partkey, greatest(x0, 20) AS x, greatest(y0, 10) AS y, greatest(0.0, least(x1, 60) - greatest(x0, 20)) AS w, greatest(0.0, least(y1, 70) - greatest(y0, 10)) AS h, greatest(0.0, least(x1, 60) - greatest(x0, 20)) * greatest(0.0, least(y1, 70) - greatest(y0, 10)) AS area FROM (SELECT p_partkey, (p_partkey % 90)::DOUBLE AS x0, (p_size * 2)::DOUBLE AS y0, (p_partkey % 90 + 15)::DOUBLE AS x1, (p_size * 2 + 25)::DOUBLE AS y1 FROM part)")
def shared_rectangles(spark, sf_dir):
    x, y = (F.col("p_partkey") % 90).cast("double"), (F.col("p_size") * 2).cast("double")
    lit = lambda v: F.lit(float(v))
    shared = G.intersection(x, y, x + 15, y + 25, lit(20), lit(10), lit(60), lit(70))
    return table(spark, sf_dir, "part").select("p_partkey", shared.alias("r")).select("p_partkey", "r.*")
