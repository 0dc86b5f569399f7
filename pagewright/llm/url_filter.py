"""URL filters as a temporal join of captures with dated lists.

A list entry says that from its day on, a key is blocked or allowed on a list. Keys are
hosts, their parent domains, and host plus first path segment. The entries of one list
and key become validity intervals: each holds from its day up to the next one's. An
as-of join gives every capture the entries that are active on its day; on each list the
most specific key decides, and a capture is blocked if any list blocks it.

Entries of the same list, key and day are merged first (block wins), so that a key has
at most one entry a day however many rows it had. Intervals are broadcast while there
are at most ``broadcast_rows``; beyond that captures are salted by their URL and each
interval is copied to every salt, so that a host with a third of all captures is dealt
over ``SALTS`` tasks. Captures are never grouped by host.

Null or unparsable URLs have no host and match nothing; captures without a day match
nothing. A host of any length is held against all entries: its parent domains are made up to as
many labels as the longest listed key has, as none beyond can match. Null list, key or day drops an entry. Repeated captures get equal results. Columns of
captures pass through whatever their names, but for the four that are added: they take the
place of columns of those names. URLs of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import common

BROADCAST_ROWS = 50_000
SALTS = 32
#: Labels, at most, of the keys that the demonstration lists.
LISTED_LABELS = 127
#: Rank of a key with a path, above that of any domain.
PATH = 1 << 30
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
START = "2024-01-01"


def host(url: Column) -> Column:
    """Lower-case host; empty without one."""
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def keys(url: Column, most: int) -> Column:
    """array<struct<key, rank>>: parent domains of at most ``most`` labels (rank: their number), then host/segment (rank ``PATH``)."""
    labels = F.split(host(url), r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda n: F.struct(F.array_join(F.slice(labels, -n, n), ".").alias("key"), n.alias("rank")))
    segment = F.coalesce(F.regexp_extract(url, SEGMENT, 1), F.lit(""))
    path = F.array(F.struct(F.concat(host(url), F.lit("/"), segment).alias("key"), F.lit(PATH).alias("rank")))
    return F.when(host(url) == "", F.array().cast("array<struct<key:string,rank:int>>")).when(segment == "", domains).otherwise(F.concat(domains, path))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until, blocks) of entries (list, key, day, action: block or allow); until is null for the last."""
    whole = entries.where(F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull())
    days = whole.groupBy("list", "key", "day").agg(F.max((F.col("action") == "block").cast("int")).alias("blocks"))
    until = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return days.select("list", "key", F.col("day").alias("since"), until.alias("until"), "blocks")


def active(captures: DataFrame, spans: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(k1, k2, day, list, key, rank, blocks): each capture (k1, k2, url, day) with each entry active on its day."""
    # The labels of the longest listed domain; one number.
    most = spans.where(~F.col("key").contains("/")).agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 0
    each = captures.select("k1", "k2", "day", F.inline(keys(F.col("url"), most)))
    now = (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    if common.small(spans, broadcast_rows):
        found = each.join(F.broadcast(spans), "key").where(now)
    else:
        dealt = each.withColumn("salt", F.pmod("k2", F.lit(SALTS)))
        found = dealt.join(spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "salt"]).where(now)
    return found.select("k1", "k2", "day", "list", "key", "rank", "blocks")


def verdicts(found: DataFrame) -> DataFrame:
    """Per capture with an active entry: entries, deciding keys, and whether any list blocks."""
    by = [*common.KEY, "day"]
    # The two aggregations share one shuffle by capture.
    lists = found.distinct().repartition(*by).groupBy(*by, "list").agg(F.count("*").alias("n"), F.max(F.struct("rank", "blocks", "key")).alias("top"))
    said = F.when(F.col("top.blocks") == 1, F.concat_ws(":", "list", "top.key"))
    return lists.groupBy(*by).agg(F.sum("n").alias("n_active"), F.max("top.blocks").alias("blocked"), F.array_join(F.array_sort(F.collect_list(said)), ",").alias("blocked_by"))


def evaluate(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``captures`` (page_id, url, day, ...) with host, n_active, blocked, blocked_by."""
    # The row goes along as one struct, so that no name in it can clash.
    named = captures.select(*common.row_key(captures["page_id"], captures["url"]), captures["url"].alias("url"), captures["day"].alias("day"), F.struct(*[captures[c] for c in captures.columns]).alias("row"))
    spans = common.materialize(intervals(entries), "intervals")
    found = verdicts(active(named.select("k1", "k2", "url", "day"), spans, broadcast_rows))
    out = named.join(found, [*common.KEY, "day"], "left")
    added = ("host", "n_active", "blocked", "blocked_by")
    return out.select(*[F.col("row")[c].alias(c) for c in captures.columns if c not in added], host(F.col("url")).alias("host"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), (F.coalesce("blocked", F.lit(0)) == 1).alias("blocked"), F.coalesce("blocked_by", F.lit("")).alias("blocked_by"))


def capture_day(page_id: Column) -> Column:
    """The tables hold no fetch time: a day of 2024 by page_id stands for it."""
    return F.date_add(F.lit(START).cast("date"), F.pmod(page_id, F.lit(366)).cast("int"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """Dated entries by a rule over the pages' own hosts and paths: the tables hold no list."""
    each = pages.select(F.inline(keys(F.col("url"), LISTED_LABELS))).select("key").distinct()
    digit = lambda n: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("key"), n, 1)) - 1
    day = lambda n: F.date_add(F.lit(START).cast("date"), (digit(n) * 16 + digit(n + 1)).cast("int"))
    entry = lambda of, when, then, action: F.when(when, F.struct(F.lit(of).alias("list"), then.alias("day"), F.lit(action).alias("action")))
    made = F.array(entry("spam", digit(1) < 6, day(2), "block"), entry("spam", digit(1) < 3, F.date_add(day(2), 60), "allow"), entry("spam", digit(1) < 1, F.date_add(day(2), 120), "block"), entry("adult", digit(4) == 0, day(5), "block"), entry("adult", digit(4) == 1, day(5), "allow"))
    return each.select("key", F.explode(F.array_compact(made)).alias("x")).select("x.list", "key", "x.day", "x.action")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url").withColumn("day", capture_day(F.col("page_id")))
    return evaluate(pages, demo_entries(pages)).withColumn("day", F.col("day").cast("string"))


OP10_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
    lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS seg FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM p WHERE host <> ''),
k AS (SELECT rid, day, array_to_string(labels[len(labels) - n + 1:], '.') AS key, n AS rank FROM (SELECT *, unnest(range(1, least(len(labels), 127) + 1)) AS n FROM l)
    UNION ALL SELECT rid, day, host || '/' || seg, 1 << 30 FROM l WHERE seg <> ''),
h AS (SELECT DISTINCT key, md5(key) AS m FROM k),
g AS (SELECT key, [instr('0123456789abcdef', m[i:i]) - 1 FOR i IN [1, 2, 3, 4, 5, 6]] AS x FROM h),
e AS (SELECT 'spam' AS list, key, DATE '2024-01-01' + CAST(x[2] * 16 + x[3] AS INTEGER) AS since, 1 AS blocks FROM g WHERE x[1] < 6
    UNION ALL SELECT 'spam', key, DATE '2024-01-01' + CAST(x[2] * 16 + x[3] + 60 AS INTEGER), 0 FROM g WHERE x[1] < 3
    UNION ALL SELECT 'spam', key, DATE '2024-01-01' + CAST(x[2] * 16 + x[3] + 120 AS INTEGER), 1 FROM g WHERE x[1] < 1
    UNION ALL SELECT 'adult', key, DATE '2024-01-01' + CAST(x[5] * 16 + x[6] AS INTEGER), 1 FROM g WHERE x[4] = 0
    UNION ALL SELECT 'adult', key, DATE '2024-01-01' + CAST(x[5] * 16 + x[6] AS INTEGER), 0 FROM g WHERE x[4] = 1),
s AS (SELECT *, lead(since) OVER (PARTITION BY list, key ORDER BY since) AS until FROM e),
a AS (SELECT rid, list, k.key, rank, blocks FROM k JOIN s ON k.key = s.key AND day >= since AND (until IS NULL OR day < until)),
t AS (SELECT rid, list, count(*) AS n, max(struct_pack(rank := rank, blocks := blocks, key := key)) AS top FROM a GROUP BY rid, list),
v AS (SELECT rid, sum(n) AS n_active, max(top.blocks) AS blocked, string_agg(list || ':' || top.key, ',' ORDER BY list || ':' || top.key) FILTER (top.blocks = 1) AS blocked_by FROM t GROUP BY rid)
SELECT page_id, url, CAST(day AS VARCHAR) AS day, host, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, coalesce(blocked, 0) = 1 AS blocked, coalesce(blocked_by, '') AS blocked_by
FROM p LEFT JOIN v USING (rid)
"""
