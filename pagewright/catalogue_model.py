"""Registered queries of lookups, states, labels and selections of the document model, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.catalogue import PAGES_SQL, query, table
from pagewright.functions import geometry as G
from pagewright.functions import model as M
from pagewright.operators import lookups as U
from pagewright.operators import oriented as O
from pagewright.operators import search as S
from pagewright.operators import textlayer as L
from pagewright.plans import layout
from pagewright.sources import blocks_json


def named(values, key: str, default: str) -> str:
    """SQL: the value of a key in a list of pairs."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values) + f" ELSE {default} END"


STATES = [*M.PARSE_STATES, "Strange"]
STATE_SQL = "(" + repr(STATES) + ")[event_id % 10 + 1]"


@query(f"""SELECT event_id, {named([(k, v[0]) for k, v in M.PARSE_STATES.items()], 'state', '0')} AS progress, {named([(k, v[1]) for k, v in M.PARSE_STATES.items()], 'state', "'Unknown'")} AS shown, state IN ('Completed', 'Failed') AS terminal,
CASE WHEN task IN ('pending', 'running', 'processing') THEN 'running' WHEN task IN ('completed', 'failed') THEN task ELSE 'other' END AS task, coalesce(CASE WHEN event_id % 3 = 0 THEN 'e' END, CASE WHEN event_id % 2 = 0 THEN 'm' END) AS error, CAST(ceil((event_id % 7) / 7.0 * 100) AS INTEGER) AS percent,
CASE WHEN event_id % 8 = 0 THEN 'none' ELSE concat_ws(' | ', CASE WHEN event_id & 1 > 0 THEN 'pages' END, CASE WHEN event_id & 2 > 0 THEN 'inference' END, CASE WHEN event_id & 4 > 0 THEN 'tree' END) END AS stages
FROM (SELECT event_id, {STATE_SQL} AS state, (['pending', 'running', 'processing', 'completed', 'failed', 'x'])[event_id % 6 + 1] AS task FROM events)""")
def task_states(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    state, task = pick(STATES), pick(("pending", "running", "processing", "completed", "failed", "x"))
    stages = M.stages_shown({n: k.bitwiseAND(F.lit(b)) > 0 for n, b in (("pages", 1), ("inference", 2), ("tree", 4))}, "none")
    error = F.coalesce(F.when(k % 3 == 0, "e"), F.when(k % 2 == 0, "m"))
    return table(spark, sf_dir, "events").select("event_id", M.progress(state).alias("progress"), M.state_shown(state).alias("shown"), M.is_terminal(state).alias("terminal"), M.task_class(task).alias("task"), error.alias("error"), M.percent_done(k % 7, F.lit(7)).alias("percent"), stages.alias("stages"))


KINDS = ["title", "text", "image", "table", "caption", "Paragraph", "other"]
KIND_SQL = f"({KINDS!r})[p_partkey % 7 + 1]"


@query(f"""SELECT p_partkey, {named(M.COLOURS.items(), 'kind', "'LightGray'")} AS colour, {named(M.COLOUR_KEYS.items(), 'lower(kind)', "'Default'")} AS colour_key,
CASE WHEN p_partkey % 5 = 0 THEN '[empty]' WHEN length(p_name) > 8 THEN substring(p_name, 1, 8) || '...' ELSE p_name END AS preview, kind || CASE WHEN p_brand <> kind THEN ' / ' || p_brand ELSE '' END AS label,
array_to_string(CASE WHEN list_contains(['title', 'text'], kind) THEN list_filter(['title', 'text'], lambda x: x <> kind) ELSE list_append(['title', 'text'], kind) END, ',') AS toggled FROM (SELECT *, {KIND_SQL} AS kind FROM part)""")
def block_labels(spark, sf_dir):
    kind = F.get(F.array(*[F.lit(v) for v in KINDS]), (F.col("p_partkey") % 7).cast("int"))
    name = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name"))
    toggled = F.array_join(M.toggled(F.array(F.lit("title"), F.lit("text")), kind), ",")
    return table(spark, sf_dir, "part").select("p_partkey", M.colour(kind).alias("colour"), M.colour_key(kind).alias("colour_key"), M.preview(name, 8, F.lit("[empty]")).alias("preview"), M.block_label(kind, F.col("p_brand")).alias("label"), toggled.alias("toggled"))


MODES = ["Fill", "Stroke", "FillThenStroke", "Neither", "FillClip", "StrokeClip", "FillThenStrokeClip", "NeitherClip"]


@query(f"SELECT p_partkey, mode IN {M.STROKES!r} AS strokes, mode IN {M.FILLS!r} AS fills, p_size & 8 > 0 AS no_zoom, p_size & 16 > 0 AS no_rotate, p_size * 2.0::DOUBLE AS scaled, greatest(0.0, p_size / 2.0 - 9)::DOUBLE AS offset FROM (SELECT *, ({MODES!r})[p_partkey % 8 + 1] AS mode FROM part)")
def style_flags(spark, sf_dir):
    mode = F.get(F.array(*[F.lit(v) for v in MODES]), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", mode.isin(*M.STROKES).alias("strokes"), mode.isin(*M.FILLS).alias("fills"), M.has_flag(F.col("p_size"), M.NO_ZOOM).alias("no_zoom"), M.has_flag(F.col("p_size"), M.NO_ROTATE).alias("no_rotate"), M.scaled(F.col("p_size"), F.lit(2.0)).alias("scaled"), M.relative_offset(F.col("p_size"), F.lit(2.0), F.lit(9)).alias("offset"))


@query("""SELECT p_partkey, CASE r WHEN 90 THEN y WHEN 180 THEN 600 - (x + w) WHEN 270 THEN 800 - (y + h) ELSE x END AS x, CASE r WHEN 90 THEN 600 - (x + w) WHEN 180 THEN 800 - (y + h) WHEN 270 THEN x ELSE y END AS y,
CASE WHEN r IN (90, 270) THEN h ELSE w END AS w, CASE WHEN r IN (90, 270) THEN w ELSE h END AS h FROM (SELECT p_partkey, (p_partkey % 4) * 90 AS r, (p_size)::DOUBLE AS x, (p_size * 3)::DOUBLE AS y, 100.0::DOUBLE AS w, 50.0::DOUBLE AS h FROM part)""")
def view_turned(spark, sf_dir):
    k = F.col("p_partkey")
    view = M.turned_view(F.col("p_size"), F.col("p_size") * 3, F.lit(100), F.lit(50), F.lit(600), F.lit(800), (k % 4) * 90)
    return table(spark, sf_dir, "part").select("p_partkey", view.alias("v")).select("p_partkey", "v.*")


@query(f"""SELECT p_partkey, CASE o WHEN 'Portrait' THEN 3 WHEN 'Landscape' THEN CASE WHEN p_size % 2 = 0 THEN 4 END END AS orientation, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'monochrome' END AS colour,
CASE WHEN p_size % 5 IN (1, 2, 4) THEN p_size % 5 ELSE 1 END AS per_sheet, {named(M.SCALINGS.items(), 'm', "'fit'")} AS scaling FROM (SELECT *, (['Portrait', 'Landscape', 'Auto'])[p_partkey % 3 + 1] AS o, (['FitToPage', 'ActualSize', 'ShrinkToFit', 'CustomScale', 'x'])[p_partkey % 5 + 1] AS m FROM part)""")
def printer_settings(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    asked, mode = pick("Portrait", "Landscape", "Auto"), pick("FitToPage", "ActualSize", "ShrinkToFit", "CustomScale", "x")
    return table(spark, sf_dir, "part").select("p_partkey", M.print_orientation(asked, size % 2 == 0).alias("orientation"), M.print_colour(size % 3 == 0, size % 2 == 0).alias("colour"), M.pages_per_sheet(size % 5, F.array(F.lit(1), F.lit(2), F.lit(4))).alias("per_sheet"), M.print_scaling(mode).alias("scaling"))


@query("SELECT page_id, n AS valid, array_to_string(list_filter([replace(x, chr(0), ' ') FOR x IN [url, '  ', 'a' || chr(0) || 'b', chr(0)]], lambda x: trim(x) <> ''), '') AS joined, TRY_CAST(split_part(s, ':', 2) AS INTEGER) AS ord FROM (SELECT page_id, coalesce(url, '') AS url, NOT regexp_matches(string_split(coalesce(url, ''), '/')[-1], '[\"<>|:*?\\\\]') AS n, CASE WHEN page_id % 3 = 0 THEN 'doc:' || page_id WHEN page_id % 3 = 1 THEN 'doc:x' ELSE 'doc' END AS s FROM pages)")
def names_and_paths(spark, sf_dir):
    k, url = F.col("page_id"), F.coalesce("url", F.lit(""))
    source = F.when(k % 3 == 0, F.concat(F.lit("doc:"), k.cast("string"))).when(k % 3 == 1, "doc:x").otherwise("doc")
    joined = M.clean_append(F.array(url, F.lit("  "), F.lit("a\0b"), F.lit("\0")))
    return table(spark, sf_dir, "pages").select("page_id", M.is_valid_path(url).alias("valid"), joined.alias("joined"), M.source_order(source).alias("ord"))


NAMES_SQL = """WITH RECURSIVE f AS (SELECT event_id, user_id, event_type || '.v' AS base, CASE event_id % 4 WHEN 1 THEN '.1' WHEN 2 THEN '.2' ELSE '' END AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
w AS (SELECT user_id, base, 0::BIGINT AS i, []::VARCHAR[] AS have, NULL::BIGINT AS event_id FROM (SELECT DISTINCT user_id, base FROM f)
UNION ALL SELECT user_id, base, i, list_append(have, new), event_id FROM (
  SELECT w.user_id, w.base, f.i, w.have, f.event_id, CASE WHEN NOT list_contains(w.have, w.base || f.n || '.pdf') THEN w.base || f.n || '.pdf' ELSE w.base || f.n || '.' || list_filter(range(1, len(w.have) + 2), lambda k: NOT list_contains(w.have, w.base || f.n || '.' || k || '.pdf'))[1] || '.pdf' END AS new
  FROM w JOIN f ON f.user_id = w.user_id AND f.base = w.base AND f.i = w.i + 1))
SELECT event_id, user_id, have[-1] AS unique FROM w WHERE i > 0"""


@query(NAMES_SQL)
def unique_names(spark, sf_dir):
    k = F.col("event_id")
    number = F.when(k % 4 == 1, ".1").when(k % 4 == 2, ".2").otherwise("")
    files = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat("event_type", F.lit(".v"), number, F.lit(".pdf")).alias("name"))
    return U.unique_names(files, ["user_id"], "name", ["event_id"]).drop("name")


@query("SELECT o_custkey, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS ids, round(avg(o_totalprice), 6) AS rotation FROM orders GROUP BY o_custkey")
def grouped_by_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ids = U.gathered(orders, ["o_custkey"], ["o_orderkey"], "o_orderkey", "ids")
    sums = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("rotation"))
    return sums.join(ids, "o_custkey").select("o_custkey", "n", F.array_join("ids", ",").alias("ids"), "rotation")


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(ids, '') AS ids FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS ids FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def blocks_of_page(spark, sf_dir):
    held = U.gathered(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], ["o_orderkey"], "o_orderkey", "ids")
    pages = table(spark, sf_dir, "customer").select("c_custkey")
    return U.with_default(pages, held, ["c_custkey"], "ids", F.array().cast("array<bigint>")).select("c_custkey", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 4) * 90 END, 0) AS rotation FROM orders")
def rotation_or_none(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    turned = orders.where("o_orderkey % 3 = 0").withColumn("rotation", (F.col("o_orderkey") % 4) * 90)
    return U.with_default(orders, turned, ["o_orderkey"], "rotation", F.lit(0))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 2 = 0)")
def pages_skip_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return U.not_reported(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT w.l_orderkey, CAST(w.place AS INTEGER) AS place, h.bytes FROM (SELECT l_orderkey, unnest(range(0, 5)) AS place FROM (SELECT DISTINCT l_orderkey FROM lineitem)) w LEFT JOIN (SELECT l_orderkey, l_linenumber AS place, max(l_partkey) AS bytes FROM lineitem GROUP BY ALL) h ON h.l_orderkey = w.l_orderkey AND h.place = w.place")
def tiles_cached(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    held = lines.groupBy("l_orderkey", F.col("l_linenumber").alias("place")).agg(F.max("l_partkey").alias("bytes"))
    lows = lines.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("low"), F.lit(4).alias("high"))
    return U.cached_range(lows, held, ["l_orderkey"], "bytes")


@query("SELECT event_id FROM events WHERE NOT (user_id % 7 = 3 OR (user_id % 7 = 4 AND event_id % 3 <> 1) OR event_id NOT BETWEEN 100 AND 9000)")
def cache_evict(spark, sf_dir):
    page, level, at = F.col("user_id") % 7, F.col("event_id") % 3, F.col("event_id")
    gone = (page == 3) | ((page == 4) & (level != 1)) | ~at.between(100, 9000)
    return U.without_rows(table(spark, sf_dir, "events"), gone).select("event_id")


# Lines of three words; every fifth order has no second line.
@query("""WITH w AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS word_idx FROM lineitem),
l AS (SELECT o_orderkey, k AS line, 3 * k AS first_word, 3 * k + 3 AS past FROM (SELECT o_orderkey, unnest(range(0, 4)) AS k FROM orders) WHERE NOT (o_orderkey % 5 = 0 AND k = 1))
SELECT l_orderkey, word_idx, l_partkey, CAST(line AS INTEGER) AS line FROM w LEFT JOIN l ON o_orderkey = l_orderkey AND word_idx >= first_word AND word_idx < past""")
def word_line(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (place - 1).cast("long").alias("word_idx"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("line")).where(~((F.col("l_orderkey") % 5 == 0) & (F.col("line") == 1)))
    ranged = lines.select("l_orderkey", "line", (F.col("line") * 3).cast("long").alias("first_word"), (F.col("line") * 3 + 3).cast("long").alias("past"))
    return U.line_of_words(words, ranged, ["l_orderkey"]).select("l_orderkey", "word_idx", "l_partkey", "line")


@query("SELECT user_id, event_type, min(event_id) AS event_id, first(value ORDER BY event_id) AS value FROM events GROUP BY user_id, event_type")
def first_with_id(spark, sf_dir):
    return U.one_of_each(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


# Each event asks a customer's orders for a page by number; some ask for page 0 or beyond the last.
@query("""WITH p AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no FROM orders),
a AS (SELECT event_id, user_id AS o_custkey, event_id % 30 AS number FROM events)
SELECT event_id, number, o_totalprice, CASE WHEN page_no IS NULL THEN 'no page ' || number END AS problem FROM a LEFT JOIN p ON p.o_custkey = a.o_custkey AND page_no = number""")
def page_by_number(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    pages = table(spark, sf_dir, "orders").select("o_custkey", place.alias("page_no"), "o_totalprice")
    asked = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("o_custkey"), (F.col("event_id") % 30).alias("number"))
    return U.pages_asked(asked, pages, ["o_custkey"]).select("event_id", "number", "o_totalprice", "problem")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS turn FROM orders")
def request_order(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(kind, "o_orderkey")).cast("long").alias("turn"))


@query("SELECT event_id, array_to_string([x.x || ':' || x.y FOR x IN list_sort([{'x': event_id % 5, 'y': event_id % 3}, {'x': event_id % 2, 'y': event_id % 7}, {'x': event_id % 4, 'y': 1}, {'x': 1, 'y': event_id % 6}])], ' ') AS points, array_to_string(list_filter([0, 1, 2, 3, 4], lambda l: l > event_id % 5), ',') AS above FROM events")
def sorted_points(spark, sf_dir):
    at = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    k = F.col("event_id")
    points = F.array_sort(F.array(at(k % 5, k % 3), at(k % 2, k % 7), at(k % 4, F.lit(1)), at(F.lit(1), k % 6)))
    above = F.filter(F.array(*[F.lit(i) for i in range(5)]), lambda level: level > k % 5)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(points, lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))), " ").alias("points"), F.array_join(above, ",").alias("above"))


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS place, o_orderkey FROM orders")
def branches_in_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = [orders.where(c).select("o_custkey", F.lit(n).alias("branch"), "o_orderkey") for n, c in enumerate(("o_orderpriority = '1-URGENT'", "o_orderpriority = '2-HIGH'", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("branch", "o_orderkey")).cast("long").alias("place"), "o_orderkey")


@query("SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_orderkey % 50 = 0")
def visible_minus_realised(spark, sf_dir):
    shown = table(spark, sf_dir, "supplier").select("s_suppkey").distinct()
    return U.not_reported(shown, table(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 0").select(F.col("l_suppkey").alias("s_suppkey")), ["s_suppkey"])


@query("SELECT c_custkey, CAST(unnest(range(c_custkey % 5 + 1, c_custkey % 5 + 1 + c_custkey % 3 + 1)) AS BIGINT) AS page_no FROM customer")
def selection_pages(spark, sf_dir):
    first = F.col("c_custkey") % 5 + 1
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(first, first + F.col("c_custkey") % 3)).alias("page_no"))
    return pages.where(M.page_selected(F.col("page_no"), first, first + F.col("c_custkey") % 3))


@query("SELECT p_partkey, CASE WHEN x <= 0.25 THEN 0 WHEN x <= 0.5 THEN 1 WHEN x <= 0.75 THEN 2 ELSE 3 END AS over, CASE WHEN x <= 0.375 THEN 0 WHEN x <= 0.625 THEN 1 WHEN x <= 0.875 THEN 2 ELSE 3 END AS nearest, substring('abffijk', CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 3 ELSE 6 END, CASE WHEN p_partkey % 3 = 0 THEN 5 WHEN p_partkey % 3 = 1 THEN 4 ELSE 2 END) AS part FROM (SELECT p_partkey, (p_size % 16 + 0.5) / 16.0::DOUBLE AS x FROM part)")
def letter_hits(spark, sf_dir):
    ends, x = F.array(*[F.lit(e) for e in (0.25, 0.5, 0.75)]), (F.col("p_size") % 16 + 0.5) / 16.0
    # Letters a, b, ffi, j, k: the third has three characters.
    starts, k = F.array(*[F.lit(i) for i in (0, 1, 2, 5, 6, 7)]), (F.col("p_partkey") % 3).cast("int")
    first, last = F.when(k == 0, 0).when(k == 1, 2).otherwise(3), F.when(k == 0, 2).when(k == 1, 3).otherwise(4)
    return table(spark, sf_dir, "part").select("p_partkey", M.letter_over(x, ends).alias("over"), M.nearest_letter(x, ends).alias("nearest"), M.part_of_word(F.lit("abffijk"), starts, first, last).alias("part"))


SELECTED_SQL = PAGES_SQL + """, e AS (SELECT doc_id, page_no, unnest(range(0, len(words))) AS word_idx, unnest(words) AS value FROM i),
s AS (SELECT doc_id, page_no, word_idx, word_idx // 10 AS line_idx, CASE WHEN word_idx % 10 = 9 AND word_idx % 4 <> 0 THEN value || '-' ELSE value END AS value FROM e)
"""


def _selected(spark, sf_dir) -> DataFrame:
    pages = layout.page_words(table(spark, sf_dir, "documents"))
    words = pages.select("doc_id", "page_no", F.posexplode("words").alias("word_idx", "value"))
    value = F.when((F.col("word_idx") % 10 == 9) & (F.col("word_idx") % 4 != 0), F.concat("value", F.lit("-"))).otherwise(F.col("value"))
    return words.select("doc_id", "page_no", "word_idx", F.floor(F.col("word_idx") / 10).cast("int").alias("line_idx"), value.alias("value"))


@query(SELECTED_SQL + """, b AS (SELECT *, lag(value) OVER w AS pv, lag(line_idx) OVER w AS pl, lag(page_no) OVER w AS pp, lead(line_idx) OVER w AS nl, lead(page_no) OVER w AS np FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, word_idx)),
g AS (SELECT *, coalesce(regexp_matches(pv, '[\\p{Pc}\\p{Pd}]$') AND line_idx > pl AND pp = page_no, false) AS glued, coalesce(regexp_matches(value, '[\\p{Pc}\\p{Pd}]$') AND nl > line_idx AND np = page_no, false) AS cut FROM b)
SELECT doc_id, regexp_replace(string_agg(CASE WHEN pv IS NULL OR glued OR regexp_matches(pv, '[\\p{Ps}\\p{Pi}\\p{Pd}\\p{Pc}]$') OR regexp_matches(value, '^[\\p{Pe}\\p{Pf}\\p{Po}\\p{Pd}\\p{Sm}\\p{Sc}]') THEN '' ELSE ' ' END || CASE WHEN cut THEN substring(value, 1, length(value) - 1) ELSE value END, '' ORDER BY page_no, word_idx), '\\s\\z', '') AS text FROM g GROUP BY doc_id""")
def dehyphenate(spark, sf_dir):
    return U.selection_text(_selected(spark, sf_dir), ["doc_id"])


@query(SELECTED_SQL + "SELECT doc_id, page_no, CAST(word_idx AS INTEGER) AS word_idx, substring(value, lo + 1, greatest(hi - lo + 1, 0)) AS part, lo > 0 OR hi < length(value) - 1 AS is_partial FROM (SELECT *, CASE WHEN page_no = 1 AND word_idx = 3 THEN 1 ELSE 0 END AS lo, CASE WHEN page_no = 2 AND word_idx = 8 THEN 1 ELSE length(value) - 1 END AS hi FROM s WHERE (page_no > 1 OR word_idx >= 3) AND (page_no < 2 OR page_no = 2 AND word_idx <= 8))")
def selection_parts(spark, sf_dir):
    ends = {"start_page": 1, "start_word": 3, "start_letter": 1, "end_page": 2, "end_word": 8, "end_letter": 1}
    chosen = table(spark, sf_dir, "documents").select("doc_id", *[F.lit(v).alias(c) for c, v in ends.items()])
    return U.partial_words(_selected(spark, sf_dir), chosen, ["doc_id"]).drop("line_idx", "value")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber * 2 AS page, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS ord, l_partkey AS title, (l_partkey % 800)::DOUBLE AS y FROM lineitem),
v AS (SELECT o_orderkey, CASE WHEN o0 < 0 AND p0 > 1 THEN p0 - 1 ELSE p0 END AS page, CASE WHEN o0 < 0 AND p0 > 1 THEN o0 + 800 ELSE o0 END AS y0, r FROM (SELECT o_orderkey, o_orderkey % 14 + 1 AS p0, (o_orderkey * 13 % 900 - 100)::DOUBLE AS o0, (o_orderkey % 4) * 90 AS r FROM orders)),
m AS (SELECT v.o_orderkey, max(b.page) AS page FROM v JOIN b ON b.l_orderkey = v.o_orderkey AND b.page <= v.page GROUP BY v.o_orderkey),
c AS (SELECT v.o_orderkey, b.title, row_number() OVER (PARTITION BY v.o_orderkey ORDER BY CASE WHEN m.page < v.page THEN -b.ord WHEN v.r IN (90, 270) THEN b.ord ELSE abs(v.y0 - CASE WHEN v.r = 180 THEN b.y ELSE 800 - b.y END) END, b.ord) AS k FROM v JOIN m USING (o_orderkey) JOIN b ON b.l_orderkey = v.o_orderkey AND b.page = m.page)
SELECT o_orderkey, c.title AS active FROM v LEFT JOIN c USING (o_orderkey) WHERE coalesce(k, 1) = 1""")
def bookmark_active(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    marks = lines.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 2).cast("long").alias("page"), place.alias("ord"), F.col("l_partkey").alias("title"), (F.col("l_partkey") % 800).cast("double").alias("y"))
    k = F.col("o_orderkey")
    views = table(spark, sf_dir, "orders").select("o_orderkey", (k % 14 + 1).alias("page"), (k * 13 % 900 - 100).cast("double").alias("offset"), ((k % 4) * 90).alias("rotation"), F.lit(800.0).alias("height"), F.lit(800.0).alias("height_before"))
    return U.active_bookmark(views, marks, ["o_orderkey"]).select("o_orderkey", "active")


def _source_json(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    kind = lambda i: F.when(i == 0, "paragraph_title").when(i % 4 == 3, " Image_Caption ").when(i % 4 == 2, "weird")
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.struct(F.when(i % 2 == 0, i + 5).alias("id"), F.when(i % 3 == 0, i).alias("page"), F.when(i % 3 == 1, F.concat(F.lit("d:"), (i * 10).cast("string"))).when(i % 3 == 2, "d:x").alias("source_id"), kind(i).alias("type"), F.lit("table").alias("category"), F.when(i % 5 != 4, s).alias("content"), F.concat(F.lit("t"), i.cast("string")).alias("text"), F.array(F.lit(10.0), 20.0 * i, F.lit(2100.0), 20.0 * i + 15).alias("bbox"), (i % 3).alias("level"), F.when(i % 2 == 1, i).alias("contd")))
    body = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.create_map(F.lit("1"), F.array(F.lit(1000.0), F.lit(500.0)), F.lit("x"), F.array(F.lit(1.0))).alias("page_size"), F.map_from_arrays(F.array(F.lit("1"), F.lit("2"), F.lit("y")), F.array(lines, lines, lines)).alias("pages"))
    return docs.select("doc_id", F.to_json(body).alias("json"), F.to_json(lines).alias("list"))


SOURCE_SQL = """SELECT doc_id, s[i + 1] AS s, i, CASE WHEN i = 0 THEN 'paragraph_title' WHEN i % 4 = 3 THEN ' Image_Caption ' WHEN i % 4 = 2 THEN 'weird' END AS raw, CASE WHEN i = 0 THEN 'title' WHEN i % 4 = 3 THEN 'caption' WHEN i % 4 = 2 THEN 'text' ELSE 'table' END AS type
FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))"""


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(p AS INTEGER) AS page, CAST(i AS INTEGER) AS place, CAST(CASE WHEN i < 2 THEN i ELSE ((i - 2) // 3 * 3 + 1) * 10 + i - ((i - 2) // 3 * 3 + 1) END AS INTEGER) AS id, coalesce(raw, '') AS type FROM ({SOURCE_SQL}), (SELECT unnest([1, 2]) AS p)")
def block_ids(spark, sf_dir):
    return blocks_json.pages_json(_source_json(spark, sf_dir)).select("doc_id", "page", "place", "id", "type")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'mineru' AS model_name, CAST(p AS INTEGER) AS page, CAST(i AS INTEGER) AS place, CAST(CASE WHEN i % 2 = 0 THEN i + 5 ELSE 0 END AS INTEGER) AS id, CAST(CASE WHEN i % 3 = 0 THEN i ELSE 0 END AS INTEGER) AS own_page, type, coalesce(raw, 'table') AS source_label, CASE WHEN i % 5 <> 4 THEN s ELSE '' END AS content, CASE WHEN i = 0 THEN 0 END AS title_level, CAST(i % 3 AS INTEGER) AS level, CAST(CASE WHEN i % 2 = 1 THEN i ELSE -1 END AS INTEGER) AS contd, -1 AS image, round(CASE WHEN p = 1 THEN 10 / 1000.0 ELSE 10 END, 6)::DOUBLE AS x, round(CASE WHEN p = 1 THEN 20 * i / 500.0 ELSE 20 * i END, 6)::DOUBLE AS y, round(CASE WHEN p = 1 THEN 2.09 ELSE 2090 END, 6)::DOUBLE AS w, round(CASE WHEN p = 1 THEN 0.03 ELSE 15 END, 6)::DOUBLE AS h FROM ({SOURCE_SQL}), (SELECT unnest([1, 2]) AS p)")
def middle_json(spark, sf_dir):
    blocks = blocks_json.middle_json(_source_json(spark, sf_dir))
    return blocks.select("doc_id", "model_name", "page", "place", "id", "own_page", "type", "source_label", "content", "title_level", "level", "contd", "image", *[F.round(f"bbox.{c}", 6).alias(c) for c in "xywh"])


@query(f"SELECT CAST(i AS INTEGER) AS place, CAST(CASE WHEN i % 2 = 0 THEN i + 5 ELSE 0 END AS INTEGER) AS id, CAST(CASE WHEN i % 3 = 0 THEN i ELSE 0 END AS INTEGER) AS page, coalesce(raw, '') AS type, CASE WHEN i % 5 <> 4 THEN s ELSE '' END AS content, CAST(i % 3 AS INTEGER) AS level, CAST(CASE WHEN i % 2 = 1 THEN i ELSE -1 END AS INTEGER) AS contd, -1 AS table_merge, 2090.0::DOUBLE AS w FROM ({SOURCE_SQL})")
def inference_json(spark, sf_dir):
    return blocks_json.inference_json(_source_json(spark, sf_dir), "list").select("place", "id", "page", "type", "content", "level", "contd", "table_merge", "bbox.w")


@query(f"SELECT CAST(i AS INTEGER) AS id, CAST(CASE WHEN i % 3 = 0 THEN i ELSE 1 END AS INTEGER) AS page, type, coalesce(raw, 'table') AS source_label, 't' || i AS content, 20.0::DOUBLE * i AS y FROM ({SOURCE_SQL})")
def content_list_json(spark, sf_dir):
    return blocks_json.content_list_json(_source_json(spark, sf_dir), "list").select("id", "page", "type", "source_label", "content", "bbox.y")


def _trees_json(spark, sf_dir) -> DataFrame:
    """A tree for each conversation: every turn lies under the one before it, beside a note."""
    t = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    node = F.to_json(F.struct(F.col("role").alias("type"), F.left("text", F.lit(20)).alias("title"), F.col("text").alias("content"), turn.alias("level"), F.array(turn * 2, turn * 2 + 1).alias("block_ids"), F.array(F.struct((turn % 3 + 1).alias("page"), F.array(10 * turn, F.lit(20), F.length("text"), 500 + turn).alias("bbox"))).alias("location")))
    listed = t.withColumn("node", node).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "node"))).alias("nodes"))
    opened = F.array_join(F.transform("nodes", lambda x: F.concat(F.substring(x["node"], F.lit(1), F.length(x["node"]) - 1), F.lit(',"children":[{"title":"note"}'))), ",")
    tree = F.concat(F.lit('{"page_size":{"1":[1000,500],"2":[2000,1000]},"tree":{"type":"root","title":"'), F.col("conv_id").cast("string"), F.lit('","children":['), opened, F.repeat(F.lit("]}"), F.size("nodes")), F.lit("]}}"))
    return listed.select("conv_id", tree.alias("json"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
b AS (SELECT *, 10 * turn AS x1, 20 AS y1, length(text) AS x2, 500 + turn AS y2, CASE turn % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 2000.0 END AS pw, CASE turn % 3 WHEN 0 THEN 500.0 WHEN 1 THEN 1000.0 END AS ph FROM t),
s AS (SELECT *, CASE WHEN pw IS NOT NULL AND (x2 > 1000 OR y2 > 1000) THEN pw ELSE 1 END AS dx, CASE WHEN pw IS NOT NULL AND (x2 > 1000 OR y2 > 1000) THEN ph ELSE 1 END AS dy FROM b)
SELECT conv_id, '0,0' || repeat(',1', k) AS path, role AS type, left(text, 20) AS title, text AS content, turn::INTEGER AS level, (turn * 2) || ',' || (turn * 2 + 1) AS block_ids, (CASE WHEN k = n - 1 THEN 1 ELSE 2 END)::INTEGER AS n_children, (turn % 3 + 1)::INTEGER AS page, round(x1 / dx, 6)::DOUBLE AS x, round(y1 / dy, 6)::DOUBLE AS y, round(greatest(0, x2 / dx - x1 / dx), 6)::DOUBLE AS w, round(greatest(0, y2 / dy - y1 / dy), 6)::DOUBLE AS h FROM s
UNION ALL SELECT conv_id, '0,0' || repeat(',1', k) || ',0', '', 'note', '', 0, '', 0, NULL, NULL, NULL, NULL, NULL FROM t
UNION ALL SELECT DISTINCT conv_id, '0', 'root', CAST(conv_id AS VARCHAR), '', 0, '', 1, NULL, NULL, NULL, NULL, NULL FROM t""")
def tree_nodes(spark, sf_dir):
    nodes = blocks_json.tree_nodes(_trees_json(spark, sf_dir), ["conv_id"], under="$.tree", normalised=True)
    at = F.get("locations", F.lit(0))
    return nodes.select("conv_id", F.array_join("path", ",").alias("path"), "type", "title", "content", "level", F.array_join("block_ids", ",").alias("block_ids"), "n_children", at["page"].alias("page"), *[F.round(at[c], 6).alias(c) for c in "xywh"])


@query("SELECT event_id, x, y, x + w AS x1, y + h AS y1, array_to_string([x, y, x + w, y + h], ',') IS NOT NULL AS listed FROM (SELECT event_id, (event_id % 10)::DOUBLE AS x, (event_id % 7)::DOUBLE AS y, 5.0::DOUBLE AS w, 2.0::DOUBLE AS h FROM events)")
def bbox_listed(spark, sf_dir):
    k = F.col("event_id")
    box = M.bbox_to_array((k % 10).cast("double"), (k % 7).cast("double"), F.lit(5.0), F.lit(2.0))
    return table(spark, sf_dir, "events").select("event_id", box.alias("b")).select("event_id", F.col("b")[0].alias("x"), F.col("b")[1].alias("y"), F.col("b")[2].alias("x1"), F.col("b")[3].alias("y1"), (F.size("b") == 4).alias("listed"))


ANNOTATION_SQL = """WITH r AS (SELECT event_id, (event_id % 11)::DOUBLE AS u0, (event_id % 13)::DOUBLE AS u1, event_id % 5 AS n, event_id % 2 = 0 AS l, event_id % 3 = 0 AS act, CASE WHEN event_id % 7 = 0 THEN 'note' ELSE '' END AS t, CASE event_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN -1 ELSE 1 END::DOUBLE AS a, CASE event_id % 4 WHEN 2 THEN 1 ELSE 0 END::DOUBLE AS b, CASE event_id % 4 WHEN 2 THEN -1 ELSE 0 END::DOUBLE AS c, CASE event_id % 4 WHEN 2 THEN 0 ELSE 1 END::DOUBLE AS d, (event_id % 100)::DOUBLE AS e, ts FROM events),
p AS (SELECT *, unnest([0.0, 0.0, 5.0, 5.0])::DOUBLE AS x, unnest([u0, u1, u0, u1]) AS y FROM r WHERE u0 <> u1 AND (l OR act OR t <> ''))
SELECT event_id, min(a * x + c * y + e) AS x0, 800.0 - max(b * x + d * y + 7) AS y0, max(a * x + c * y + e) AS x1, 800.0 - min(b * x + d * y + 7) AS y1, any_value(CASE n WHEN 1 THEN 'gray' WHEN 3 THEN 'rgb' WHEN 4 THEN 'cmyk' END) AS colour_space, any_value(l AND act) AS is_interactive, any_value(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' +02:00') AS date FROM p GROUP BY event_id"""


@query(ANNOTATION_SQL)
def annotation_scan(spark, sf_dir):
    k = F.col("event_id")
    of = lambda a, b, c, d: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((a, b, c, d), "abcd", strict=True)], (k % 100).cast("double").alias("e"), F.lit(7.0).alias("f"))
    matrix = F.when(k % 4 == 1, of(2, 0, 0, 1)).when(k % 4 == 2, of(0, 1, -1, 0)).when(k % 4 == 3, of(-1, 0, 0, 1)).otherwise(of(1, 0, 0, 1))
    dated = F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+02'00'"))
    raw = table(spark, sf_dir, "events").select("event_id", F.lit(0.0).alias("x0"), F.lit(5.0).alias("x1"), (k % 11).cast("double").alias("y0"), (k % 13).cast("double").alias("y1"), (k % 2 == 0).alias("is_link"), (k % 3 == 0).alias("has_action"), F.when(k % 7 == 0, "note").otherwise("").alias("content"), F.array_repeat(F.lit(0.5), (k % 5).cast("int")).alias("colour"), matrix.alias("matrix"), dated.alias("date"))
    return U.annotations(raw, F.lit(800.0)).select("event_id", "x0", "y0", "x1", "y1", "colour_space", "is_interactive", "date")


LETTER_SQL = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders"


@query(f"SELECT o_custkey, min(o_orderkey) AS letter_idx, string_agg(CASE WHEN i % 3 = 0 THEN chr(769) ELSE 'e' END, '' ORDER BY i) AS value FROM (SELECT *, sum(CASE WHEN i % 3 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY i) AS base FROM ({LETTER_SQL})) GROUP BY o_custkey, base")
def diacritics(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    letters = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("letter_idx"), F.lit(0).alias("text_sequence"), F.when(i % 3 == 0, "́").otherwise("e").alias("value"))
    return U.combined_marks(letters, ["o_custkey"]).drop("text_sequence")


@query(f"SELECT o_orderkey, CASE WHEN i % 4 = 0 THEN 'a' WHEN row_number() OVER (PARTITION BY o_custkey, (i - 1) // 4, i % 4 = 0 ORDER BY o_orderkey) = 1 THEN 'soft' ELSE '' END AS value FROM ({LETTER_SQL})")
def replacement_text(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    letters = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", i.alias("i"), F.lit("a").alias("value"), F.lit("so­ft").alias("replacement"))
    spans = letters.withColumn("span", F.when(F.col("i") % 4 != 0, F.floor((F.col("i") - 1) / 4))).withColumnRenamed("o_orderkey", "letter_idx")
    return U.replaced(spans, ["o_custkey"]).select(F.col("letter_idx").alias("o_orderkey"), "value")


@query("SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM (SELECT doc_id, i // 2000 + 1 AS page_no, i % 2000 AS k FROM (SELECT doc_id, unnest(range(0, length(text))) AS i FROM documents WHERE length(text) > 0)) GROUP BY ALL")
def letter_dedup_first(spark, sf_dir):
    kept = L.dedup_pages(layout.doubled_pages(table(spark, sf_dir, "documents")), "first", ["doc_id", "page_no", "letter_idx"])
    return kept.groupBy("doc_id", "page_no").agg(F.sum(F.size("letter_idx")).alias("n"), F.sum(F.aggregate("letter_idx", F.lit(0).cast("long"), lambda s, x: s + x)).alias("ids"))


@query("SELECT user_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS keys FROM events WHERE value IS NOT NULL GROUP BY user_id")
def properties(spark, sf_dir):
    others = M.other_values(F.create_map(F.col("event_type"), F.col("value")))
    each = table(spark, sf_dir, "events").select("user_id", F.explode(others).alias("key", "value"))
    return each.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))


NOTICES_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, left(event_type, 1) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_id % 11 <> 0),
w AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS t, NULL::VARCHAR AS m, NULL::BIGINT AS shown FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, i, CASE WHEN again THEN pt ELSE nt END, CASE WHEN again THEN pm ELSE nm END, CASE WHEN again THEN NULL ELSE event_id END FROM (
  SELECT e.*, w.t AS pt, w.m AS pm, e.t AS nt, e.m AS nm, coalesce(w.m = e.m AND e.t - w.t <= 86400000000::BIGINT * 2, false) AS again FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
SELECT shown AS event_id FROM w WHERE shown IS NOT NULL"""


# Every eleventh notice has no message and is never shown.
@query(NOTICES_SQL)
def notices_not_repeated(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("message", F.when(F.col("event_id") % 11 != 0, F.left("event_type", F.lit(1))))
    return U.changed(events, ["user_id"], "ts", "message", 2 * 86400, ["event_id"]).select("event_id")


# Every seventh document has no text layer: its hits scroll to the top of their page.
@query(PAGES_SQL + "SELECT doc_id, page_no, CAST(k AS INTEGER) AS word_idx, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 72 + 14 * (k // 10) END::DOUBLE AS y FROM (SELECT doc_id, page_no, unnest(words) AS w, unnest(range(0, len(words))) AS k FROM i) WHERE contains(lower(w), 'tion')")
def hit_scroll_target(spark, sf_dir):
    pages = layout.page_words(table(spark, sf_dir, "documents"))
    boxes = pages.where("doc_id % 7 <> 0").select("doc_id", "page_no", F.posexplode("words").alias("word_idx", "value")).withColumn("y", (72 + 14 * F.floor(F.col("word_idx") / 10)).cast("double"))
    hits = S.search(S.text_index(pages), "tion").select("doc_id", "page_no", "word_idx")
    return U.with_default(hits, boxes, ["doc_id", "page_no", "word_idx"], "y", F.lit(0.0))


@query("""SELECT event_id, CAST(abs(x2 - x1) AS FLOAT) AS horizontal, CAST(abs(y2 - y1) AS FLOAT) AS vertical, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 4)::DOUBLE AS straight, CAST(abs(x2 - x1) + abs(y2 - y1) AS FLOAT) AS around, greatest(0.0, least(x2, 9) - greatest(x1, 2)) AS shared FROM (SELECT event_id, (event_id % 9)::DOUBLE AS x1, (event_id % 4)::DOUBLE AS y1, (event_id % 13)::DOUBLE AS x2, (event_id % 6)::DOUBLE AS y2 FROM events)""")
def axis_distances(spark, sf_dir):
    at = lambda n: (F.col("event_id") % n).cast("double")
    x1, y1, x2, y2 = at(9), at(4), at(13), at(6)
    straight = F.round(G.euclidean(x1, y1, x2, y2).cast("double"), 4)
    return table(spark, sf_dir, "events").select("event_id", G.horizontal(x1, x2).alias("horizontal"), G.vertical(y1, y2).alias("vertical"), straight.alias("straight"), G.manhattan(x1, y1, x2, y2).alias("around"), G.intersection_length(x1, x2, F.lit(2.0), F.lit(9.0)).alias("shared"))


GLYPH_SQL = """WITH g AS (SELECT o_custkey % 200 AS word, o_custkey % 4 AS turn, o_orderkey, (o_orderkey % 60 * 5)::DOUBLE AS x, (o_orderkey % 7)::DOUBLE AS y, 8.0::DOUBLE AS a, (5 + o_orderkey % 3)::DOUBLE AS t FROM orders)"""


def _glyphs(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    d = lambda c: c.cast("double")
    g = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("word"), (F.col("o_custkey") % 4).alias("turn"), "o_orderkey", d(k % 60 * 5).alias("x"), d(k % 7).alias("y"), F.lit(8.0).alias("a"), d(5 + k % 3).alias("t"))
    x, y, a, t = (F.col(c) for c in "xyat")
    upright, right, down, left = G.box(x, y - t, x + a, y - t, x, y, x + a, y), G.box(x - t, y, x - t, y - a, x, y, x, y - a), G.box(x, y + t, x - a, y + t, x, y, x - a, y), G.box(x + t, y, x + t, y + a, x, y, x, y + a)
    return g.withColumn("box", F.when(F.col("turn") == 0, upright).when(F.col("turn") == 1, right).when(F.col("turn") == 2, down).otherwise(left))


@query(GLYPH_SQL + """ SELECT word, CASE turn WHEN 0 THEN 'Horizontal' WHEN 1 THEN 'Rotate90' WHEN 2 THEN 'Rotate180' ELSE 'Rotate270' END AS orientation,
CASE turn WHEN 0 THEN min(x) WHEN 1 THEN max(x) WHEN 2 THEN max(x) ELSE min(x) END AS blx, CASE turn WHEN 0 THEN max(y) WHEN 1 THEN max(y) WHEN 2 THEN min(y) ELSE min(y) END AS bly,
CASE turn WHEN 0 THEN max(x + a) WHEN 1 THEN min(x - t) WHEN 2 THEN min(x - a) ELSE max(x + t) END AS trx, CASE turn WHEN 0 THEN min(y - t) WHEN 1 THEN min(y - a) WHEN 2 THEN max(y + t) ELSE max(y + a) END AS try FROM g GROUP BY word, turn""")
def turned_boxes(spark, sf_dir):
    glyphs = _glyphs(spark, sf_dir).withColumn("o", G.orientation(F.col("box")))
    found = glyphs.groupBy("word").agg(G.group_orientation(F.col("o")).alias("orientation"), O.turned_box(F.col("o"), F.col("box")).alias("b"))
    return found.select("word", "orientation", "b.blx", "b.bly", "b.trx", "b.try")


@query(GLYPH_SQL + " SELECT o_orderkey, row_number() OVER (PARTITION BY word ORDER BY CASE turn WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END, CASE WHEN turn IN (0, 2) THEN y ELSE x END, o_orderkey) AS in_line, row_number() OVER (PARTITION BY word ORDER BY CASE turn WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END, CASE WHEN turn IN (0, 2) THEN x ELSE y END, o_orderkey) AS in_block FROM g")
def reading_order(spark, sf_dir):
    b = F.col("box")
    glyphs = _glyphs(spark, sf_dir).withColumn("o", G.orientation(b))
    place = lambda keys: F.row_number().over(Window.partitionBy("word").orderBy(keys(F.col("o"), F.lit(0.0), b["blx"], b["bly"]), "o_orderkey")).cast("long")
    return glyphs.select("o_orderkey", place(O.word_keys).alias("in_line"), place(O.line_keys).alias("in_block"))


@query("""SELECT event_id, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 WHEN w > 90 THEN w - 180 WHEN w < -90 THEN w + 180 ELSE w END, 3) + 0.0 AS within, round(CASE WHEN b < 0 THEN b + 180 ELSE b END, 3) + 0.0 AS between, round(CASE WHEN gap >= 0 THEN gap END, 3) + 0.0 AS gap FROM (SELECT *, CAST(CAST(degrees(atan2(dy, dx)) AS FLOAT) AS DOUBLE) AS w, CAST(CAST(degrees(atan2(dy, cx)) AS FLOAT) AS DOUBLE) AS b, abs(dy) - 10 AS gap
FROM (SELECT event_id, (event_id % 37 - 18)::DOUBLE AS dx, (event_id % 41 - 19.5)::DOUBLE AS dy, (event_id % 37 - 18 + 20)::DOUBLE AS cx FROM events))""")
def word_angles(spark, sf_dir):
    k = F.col("event_id")
    dx, dy, zero = (k % 37 - 18).cast("double"), (k % 41 - 19.5).cast("double"), F.lit(0.0)
    a = G.box(zero - 20, zero - 10, zero, zero - 10, zero - 20, zero, zero, zero)
    b = G.box(dx, dy - 10, dx + 20, dy - 10, dx, dy, dx + 20, dy)
    return table(spark, sf_dir, "events").select("event_id", *[(F.round(c.cast("double"), 3) + 0.0).alias(n) for n, c in (("within", G.within_line_angle(a, b)), ("between", G.between_line_angle(a, b)), ("gap", G.perpendicular_gap(a, b)))])
