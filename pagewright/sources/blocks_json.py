"""Document-analysis JSON to relations of blocks and tree nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import model as M
from pagewright.functions import text as T
from pagewright.operators import hierarchy
from pagewright.operators.search import let

BLOCK = "struct<id:int,page:int,type:string,category:string,source_label:string,source_id:string,content:string,text:string,bbox:array<double>,box:array<double>,title_level:int,level:int,contd:int,image:int,table_merge:int>"
#: Numbers that a block has unless it says others.
UNSAID = ("contd", "level", "image", "table_merge")


def _box(b: Column, *names: str) -> Column:
    return F.coalesce(*[b[n] for n in names], F.array().cast("array<double>"))


def _said(b: Column, name: str, default: str = "") -> Column:
    return F.coalesce(b[name], F.lit(default)).alias(name)


def _numbers(b: Column) -> list[Column]:
    """What a block says of its continuation, level, image and merged table; -1 where it doesn't."""
    return [F.coalesce(b[c], F.lit(-1)).alias(c) for c in UNSAID]


def _pages(raw: DataFrame, column: str, fields: str) -> DataFrame:
    """j (the fields) and a row for each page whose key is an integer: page, blocks."""
    parsed = raw.select(F.from_json(column, f"struct<{fields},pages:map<string,array<{BLOCK}>>>").alias("j")).where("j.pages IS NOT NULL")
    return parsed.select(F.col("j").dropFields("pages").alias("j"), F.explode("j.pages").alias("key", "blocks")).withColumn("page", F.col("key").try_cast("int")).where("page IS NOT NULL")


def numbered(orders: Column) -> Column:
    """Ids of a page's blocks: each stands as far behind the last block before it whose source_id names an order as its place tells, on from there.

    ``orders``: the order that each of the page's blocks names, or null. A block's own order tells only on those behind it.
    A page is read once, and what its blocks name is kept: the blocks behind each that names an order are numbered as one run.
    """

    def runs(orders: Column) -> Column:
        named = F.filter(F.transform(orders, lambda o, i: F.struct(i.alias("i"), o.alias("o"))), lambda x: x["o"].isNotNull())
        return let(F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("o"))), named), lambda marks: F.flatten(F.transform(marks, lambda mark, k: run(orders, marks, mark, k))))

    def run(orders: Column, marks: Column, mark: Column, k: Column) -> Column:
        n = F.coalesce(F.get(marks, k + 1)["i"], F.size(orders) - 1) - mark["i"]
        return F.when(n > 0, F.sequence(mark["o"] + 1, mark["o"] + n)).otherwise(F.array().cast("array<int>"))

    return let(orders, runs)


def pages_json(raw: DataFrame, column: str = "json") -> DataFrame:
    """Blocks of {doc_id, model, pages: {"1": [block, ...]}} with the type as it stands there.

    Pages whose key is no integer are skipped; place is the block's in its page, id is ``numbered``. Boxes are as they
    stand, [x1, y1, x2, y2] as x, y, w, h.
    """
    pages = _pages(raw, column, "doc_id:string,model:string").select(F.coalesce("j.doc_id", F.lit("")).alias("doc_id"), F.coalesce("j.model", F.lit("")).alias("model"), "page", "blocks")
    ids = numbered(F.transform("blocks", lambda b: M.source_order(b["source_id"])))
    each = pages.select("doc_id", "model", "page", F.posexplode(F.arrays_zip(F.col("blocks").alias("b"), ids.alias("id"))).alias("place", "x"))
    b = F.col("x.b")
    return each.select("doc_id", "model", "page", "place", "x.id", _said(b, "type"), _said(b, "source_label"), _said(b, "content"), G.bbox_from_array(_box(b, "bbox")).alias("bbox"), b["title_level"].alias("title_level"))


def inference_json(raw: DataFrame, column: str = "json") -> DataFrame:
    """Blocks of a flat array, with the ids and pages that they name (0 without); anything but an array gives none."""
    each = _flat(raw, column)
    b = F.col("b")
    return each.select("place", *[F.coalesce(b[c], F.lit(0)).alias(c) for c in ("id", "page")], _said(b, "type"), _said(b, "content"), G.bbox_from_array(_box(b, "bbox")).alias("bbox"), *_numbers(b))


def content_list_json(raw: DataFrame, column: str = "json") -> DataFrame:
    """Blocks of a flat content list: the id is the place, the page defaults to 1, text comes before content, types are mapped."""
    each = _flat(raw, column)
    b = F.col("b")
    label = F.coalesce(b["type"], b["category"], F.lit(""))
    box = G.bbox_normalised(_box(b, "bbox", "box"), F.lit(0.0), F.lit(0.0))
    return each.select(F.col("place").alias("id"), F.coalesce(b["page"], F.lit(1)).alias("page"), T.block_type(label).alias("type"), label.alias("source_label"), F.coalesce(b["text"], b["content"], F.lit("")).alias("content"), box.alias("bbox"))


def _flat(raw: DataFrame, column: str) -> DataFrame:
    # from_json takes an object for an array of one.
    array = F.when(F.col(column).rlike(r"^\s*\["), F.from_json(column, f"array<{BLOCK}>"))
    return raw.select(F.posexplode(array).alias("place", "b"))


def middle_json(raw: DataFrame, column: str = "json") -> DataFrame:
    """Blocks of {doc_id, model_name, page_size, pages} with mapped types; boxes in pixels are divided by the page's size, if it is known.

    page is the key that the block stands under, own_page the page that it names itself (0 without), id the id that it
    names (0 without). Only titles have a title_level, which is their level. Text that isn't such an object gives none.
    """
    pages = _pages(raw, column, "doc_id:string,model_name:string,page_size:map<string,array<double>>")
    sizes = M.page_sizes(F.coalesce("j.page_size", F.create_map().cast("map<string,array<double>>")))
    sized = pages.select(F.coalesce("j.doc_id", F.lit("")).alias("doc_id"), F.coalesce("j.model_name", F.lit("mineru")).alias("model_name"), "page", F.try_element_at(sizes, F.col("page")).alias("size"), "blocks")
    each = sized.select("doc_id", "model_name", "page", "size", F.posexplode("blocks").alias("place", "b"))
    b = F.col("b")
    label = F.coalesce(b["source_label"], b["type"], b["category"], F.lit(""))
    box = G.bbox_normalised(_box(b, "bbox", "box"), F.coalesce("size.w", F.lit(0.0)), F.coalesce("size.h", F.lit(0.0)))
    level = F.when(T.block_type(label) == "title", b["level"])
    return each.select("doc_id", "model_name", "page", "place", F.coalesce(b["id"], F.lit(0)).alias("id"), F.coalesce(b["page"], F.lit(0)).alias("own_page"), T.block_type(label).alias("type"), label.alias("source_label"), _said(b, "content"), box.alias("bbox"), level.alias("title_level"), *_numbers(b))


def tree_nodes(raw: DataFrame, keep: list[str], column: str = "json", under: str = "$", normalised: bool = False) -> DataFrame:
    """Nodes of the tree at ``under`` in JSON of any depth, in one plan: ``keep``, path, type, title, metadata, content, level, block_ids, locations, n_children.

    path: places from the root, which sorts in pre-order. locations: array of (page, x, y, w, h) in their order; with ``normalised``, boxes
    in pixels are divided by the size of the location's page in $.page_size. Text that is no object with such a tree gives no row.
    Each level is one step over that level's nodes only, so a file costs its text once for each level that it has.
    """
    spark = raw.sparkSession
    hierarchy.lift_limits(spark)
    parsed = raw.select(*keep, F.try_parse_json(column).alias("_v"))
    sizes = F.try_variant_get("_v", "$.page_size", "map<string,array<double>>") if normalised else F.lit(None).cast("map<string,array<double>>")
    tops = parsed.select(*keep, M.page_sizes(F.coalesce(sizes, F.create_map().cast("map<string,array<double>>"))).alias("_sizes"), F.try_variant_get("_v", under, "variant").alias("_node"))
    tops = tops.where(F.schema_of_variant("_node").startswith("OBJECT"))
    names = ", ".join(f"`{c}`" for c in keep)
    walk = f"""WITH RECURSIVE walk({names}, _sizes, path, _node) MAX RECURSION LEVEL {hierarchy.MAX_DEPTH} AS (
      SELECT {names}, _sizes, array(0), _node FROM {{tops}}
      UNION ALL SELECT {", ".join(f"w.`{c}`" for c in keep)}, w._sizes, array_append(w.path, c.pos), c.value FROM walk w, LATERAL variant_explode(try_variant_get(w._node, '$.children', 'variant')) c)
    SELECT * FROM walk"""
    nodes = spark.sql(walk, tops=tops)
    get = lambda name, kind: F.try_variant_get("_node", f"$.{name}", kind)
    size = lambda page, side: F.coalesce(F.try_element_at("_sizes", page)[side], F.lit(0.0))

    def place(x: Column) -> Column:
        page, box = F.coalesce(x["page"], F.lit(0)), _box(x, "bbox")
        found = G.bbox_normalised(box, size(page, "w"), size(page, "h")) if normalised else G.bbox_from_array(box)
        return F.struct(page.alias("page"), *[found[c].alias(c) for c in "xywh"])

    locations = F.transform(F.coalesce(get("location", "array<struct<page:int,bbox:array<double>>>"), F.array().cast("array<struct<page:int,bbox:array<double>>>")), place)
    said = [F.coalesce(get(c, "string"), F.lit("")).alias(c) for c in ("type", "title", "metadata", "content")]
    ids = F.coalesce(get("block_ids", "array<int>"), F.array().cast("array<int>"))
    return nodes.select(*keep, "path", *said, F.coalesce(get("level", "int"), F.lit(0)).alias("level"), ids.alias("block_ids"), locations.alias("locations"), F.coalesce(F.size(get("children", "array<variant>")), F.lit(0)).alias("n_children"))


def combined(pages: DataFrame, inference: DataFrame, trees: DataFrame) -> DataFrame:
    """One row a document from its three stages: pages and inference (doc_id, blocks), trees (doc_id, tree).

    Inference stands in for missing pages; has_* tell which stages there are. Each has one row a document; a
    document in none has none.
    """
    p = pages.select("doc_id", F.col("blocks").alias("pages"))
    i = inference.select("doc_id", F.col("blocks").alias("inference"))
    both = p.join(i, "doc_id", "full").join(trees.select("doc_id", "tree"), "doc_id", "full")
    held = [F.col(c).isNotNull().alias(f"has_{c}") for c in ("pages", "inference", "tree")]
    return both.select("doc_id", F.coalesce("pages", "inference").alias("pages"), "inference", "tree", *held)
