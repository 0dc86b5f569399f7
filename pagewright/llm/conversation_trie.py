"""Prefix trie of conversations by external mergesort with longest common prefixes (LCPs).

A turn is a symbol: 16 bytes of the SHA-256 of its role and text, and the bytes of its text.
Conversations are range-partitioned by their symbols, then conv_id. In a task, sorted runs carry
each row's LCP with the row before it; runs beyond the first are spilled to a folder of the task.
A loser tree merges them: of two heads the one that shares more with the last row out is the
smaller, so shared turns are compared only once. The merged rows drive a stack of the
open path: a row closes what lies deeper than its LCP, and what closes is a finished node.

Only nodes on the first or the last path of a task can continue in another. Those are summed
by node; what two neighbouring tasks both counted (a shared node's bytes, child or leaf) is taken
off once for each border. Finished nodes wait for their parent's smallest member; when too many
wait, or the parent may continue elsewhere, a join on the parent's id gives it.

A conversation travels as one row of 24 bytes a turn, never with its texts. Conversation ids that
end at one node are hashed as they stream by, and across tasks from packed ids, 4096 a row.

Defined cases. Null role and text are empty; a null turn is first. Rows that tie on turn go by
their symbols. A null conv_id names no conversation: its rows are left out. Ids below zero have the remainder of
SQL (-7 % 5 is -2). Repeated rows are turns of their own. A conversation that is rebuilt without turns
is a member of the root only. An empty table has no nodes, not even a root. Columns beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import common

SYMBOL = 16
#: Bytes of a sorted run, runs that one loser tree merges, nodes that wait for their parents, ids in a packed row.
RUN_BYTES, FAN_IN, WAITING, PACKED = 48 * 1024 * 1024, 64, 50_000, 4096
MOST_SHARED, EVERY = 9, 5
#: Rows of parents that may be broadcast.
PARENTS = 500_000
EMPTY = hashlib.sha256().hexdigest()


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, key (an array of symbols) and sizes for each conversation, with the turns it borrows."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    symbol = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, SYMBOL)
    turns = rows.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", symbol.alias("symbol"), F.octet_length(text).cast("long").alias("size")).alias("turn"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    base = own.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base_id"), F.slice("own", 1, MOST_SHARED - 1).alias("base"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    both = own.join(base, F.col("conv_id") - F.col("conv_id") % EVERY == F.col("base_id"), "left")
    nothing = F.slice("own", 1, 0)
    path = F.concat(F.slice(F.coalesce("base", nothing), F.lit(1), shared), F.slice("own", shared + 1, F.greatest(F.size("own"), F.lit(1))))
    return both.select("conv_id", path.alias("path")).select(F.col("conv_id").cast("long"), F.col("path.symbol").alias("key"), F.col("path.size").alias("sizes"))


def lcp(a: bytes, b: bytes, least: int = 0) -> int:
    """Symbols that both begin with; ``least`` of them are known to agree."""
    most = min(len(a), len(b)) // SYMBOL
    step = 1
    while least + step <= most and a[least * SYMBOL : (least + step) * SYMBOL] == b[least * SYMBOL : (least + step) * SYMBOL]:
        least, step = least + step, step * 2
    while step:
        end = least + step
        if end <= most and a[least * SYMBOL : end * SYMBOL] == b[least * SYMBOL : end * SYMBOL]:
            least = end
        else:
            step //= 2
    return least


Row = tuple[bytes, int, list[int], int]  # key, conv_id, sizes, LCP with the row before


def with_lcps(rows: list[tuple[bytes, int, list[int]]]) -> Iterator[Row]:
    before = b""
    for key, conv, sizes in rows:
        yield key, conv, sizes, lcp(before, key)
        before = key


def merged(runs: list[Iterator[Row]]) -> Iterator[Row]:
    """One sorted stream of sorted runs, by a loser tree whose losers keep their LCP with who beat them."""
    heads = [next(r, None) for r in runs]
    shared = [0] * len(runs)

    def beats(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads, whose LCPs refer to the same row; sets the loser's to that with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a], heads[b]
        n = lcp(x[0], y[0], shared[a])
        rest = slice(n * SYMBOL, (n + 1) * SYMBOL)
        won, lost = (a, b) if (x[0][rest], x[1]) <= (y[0][rest], y[1]) else (b, a)
        shared[lost] = n
        return won, lost

    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads += [None] * (leaves - len(runs))
    shared += [0] * (leaves - len(runs))
    losers = [0] * leaves
    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = beats(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if leaves > 1 else 0
    while heads[top] is not None:
        key, conv, sizes, _ = heads[top]
        yield key, conv, sizes, shared[top]
        heads[top] = next(runs[top], None)
        shared[top] = heads[top][3] if heads[top] is not None else 0
        node, won = (top + leaves) // 2, top
        while node:
            won, losers[node] = beats(won, losers[node])
            node //= 2
        top = won


def _spilled(rows: Iterator[Row], folder: str) -> Iterator[Row]:
    """The rows, written to a file at once and read from it one by one."""
    held = tempfile.TemporaryFile(dir=folder)
    for row in rows:
        pickle.dump(row, held)
    held.seek(0)

    def read() -> Iterator[Row]:
        with held:
            while True:
                try:
                    yield pickle.load(held)
                except EOFError:
                    return

    return read()


def sorted_rows(batches: Iterator[pa.RecordBatch], folder: str, run_bytes: int, fan_in: int) -> Iterator[Row]:
    """External mergesort of the task's rows by key, then conv_id."""
    runs, rows, size = [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            key = b"".join(row["key"])
            rows.append((key, row["conv_id"], row["sizes"]))
            size += 200 + len(key) + 40 * len(row["sizes"])
            if size >= run_bytes:
                rows.sort()
                runs.append(_spilled(with_lcps(rows), folder))
                rows, size = [], 0
                if len(runs) == fan_in:
                    runs = [_spilled(merged(runs), folder)]
    rows.sort()
    yield from merged([*runs, with_lcps(rows)])


class Node:
    """A node of the open path."""

    __slots__ = ("bytes", "children", "conv", "depth", "ends", "hash", "id", "leaves", "left", "n", "saved", "waiting", "wide")

    def __init__(self, ident: bytes, depth: int, size: int, left: bool):
        self.id, self.depth, self.bytes, self.left = ident, depth, size, left
        self.conv = self.hash = None
        self.n = self.children = self.leaves = self.saved = self.ends = 0
        self.waiting: list[tuple] = []
        self.wide = False

    def end(self, conv: int) -> None:
        if self.hash is None:
            self.hash = hashlib.sha256()
        self.hash.update((f",{conv}" if self.ends else str(conv)).encode())
        self.ends += 1
        self.n += 1
        self.conv = conv if self.conv is None else min(self.conv, conv)


COLUMNS = (
    ("kind", pa.string()), ("task", pa.int32()), ("id", pa.binary()), ("parent_id", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("n_ends", pa.int64()), ("bytes", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_()), ("ids", pa.string()),
)
SCHEMA = ", ".join(f"`{name}` {({'string': 'string', 'int32': 'int', 'binary': 'binary', 'int64': 'long', 'bool': 'boolean'})[str(kind)]}" for name, kind in COLUMNS)


def nodes(batches: Iterator[pa.RecordBatch], run_bytes: int = RUN_BYTES, fan_in: int = FAN_IN, waiting: int = WAITING, packed: int = PACKED) -> Iterator[pa.RecordBatch]:
    """Rows of kinds node (finished), open (finished but for its parent's member), border (may go on in another task), ids (packed ends)."""
    task, shape = TaskContext.get().partitionId(), pa.schema(COLUMNS)
    out: list[tuple] = []
    path: list[Node] = []
    held = 0  # nodes that wait
    ids: list[int] = []  # those of the last row's node that aren't packed yet

    def ship() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS, strict=True)], schema=shape)

    def pack(node: Node) -> None:
        if ids:
            out.append(("ids", task, node.id, None, ids[0], *[None] * 11, ",".join(map(str, ids))))
            ids.clear()

    def release(parent: Node, known: bool) -> None:
        """Children that waited: with their parent's member where it is known, else with its id."""
        nonlocal held
        for x in parent.waiting:
            out.append(("node", task, x[0], None, *x[1:3], parent.conv, *x[3:], *[None] * 5) if known else ("open", task, x[0], parent.id, *x[1:3], None, *x[3:], *[None] * 5))
        held -= len(parent.waiting)
        parent.waiting.clear()

    def close(right: bool = False) -> None:
        nonlocal held
        v = path.pop()
        parent = path[-1] if path else None
        v.saved += (v.n - 1) * v.bytes
        v.leaves += not v.children
        border = v.left or right
        sha = v.hash.hexdigest() if v.hash else EMPTY
        release(v, known=not border)
        if border:
            out.append(("border", task, v.id, parent.id if parent else None, v.conv, v.depth, None, v.n, v.children, v.leaves, v.saved, sha, v.ends, v.bytes, v.left, right, None))
        else:
            parent.waiting.append((v.id if v.wide else None, v.conv, v.depth, v.n, v.children, v.leaves, v.saved, sha))
            held += 1
        if parent:
            parent.n += v.n
            parent.conv = v.conv if parent.conv is None else min(parent.conv, v.conv)
            parent.children += 1
            parent.leaves += v.leaves
            parent.saved += v.saved

    with tempfile.TemporaryDirectory() as folder:
        first = True
        for key, conv, sizes, shared in sorted_rows(batches, folder, run_bytes, fan_in):
            depth = len(key) // SYMBOL
            if not first and (shared < depth or shared + 1 < len(path)):  # another node than the last row's
                if path[-1].left:
                    pack(path[-1])
                ids.clear()
            while len(path) > shared + 1:
                close()
            if first:
                path.append(Node(hashlib.sha256(b"").digest()[:SYMBOL], 0, 0, True))
            for d in range(len(path), depth + 1):
                path.append(Node(hashlib.sha256(path[-1].id + key[(d - 1) * SYMBOL : d * SYMBOL]).digest()[:SYMBOL], d, sizes[d - 1], first))
            first = False
            path[-1].end(conv)
            ids.append(conv)
            if len(ids) == packed:
                pack(path[-1])
            if held > waiting:
                for v in path:
                    v.wide = v.wide or bool(v.waiting)
                    release(v, known=False)
            if len(out) >= 4096:
                yield ship()
        if path:
            pack(path[-1])
        while path:
            close(right=True)
            if len(out) >= 4096:
                yield ship()
        if out:
            yield ship()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's packed ids, which come sorted."""
    ident = held = None
    shape = pa.schema([("id", pa.binary()), ("sha", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            if row["id"] == ident:
                held.update(f",{row['ids']}".encode())
                continue
            if held is not None:
                yield pa.RecordBatch.from_pylist([{"id": ident, "sha": held.hexdigest()}], schema=shape)
            ident, held = row["id"], hashlib.sha256(row["ids"].encode())
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"id": ident, "sha": held.hexdigest()}], schema=shape)


def trie(spark: SparkSession, paths: DataFrame, tasks: int | None = None, **bounds: int) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, key, sizes)."""
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = common.materialize(paths.repartitionByRange(tasks, "key", "conv_id").mapInArrow(partial(nodes, **bounds), SCHEMA), "trie")
    border = found.where("kind = 'border'")
    used = sorted(r[0] for r in border.select("task").distinct().collect())  # a number for each task
    earlier = spark.createDataFrame(list(zip(used[1:], used, strict=False)), "task int, before int")
    last = border.where("right").select(F.col("task").alias("before"), "id", "depth", "bytes", (F.col("n_children") == 0).alias("leaf"))
    begun = border.where("left").join(F.broadcast(earlier), "task").select("before", "id")
    both = last.join(begun, ["before", "id"])
    deepest = both.groupBy("before").agg(F.max("depth").alias("most"), F.max_by("leaf", "depth").alias("leaf"))
    # bytes from a shared node down the shared path
    down = Window.partitionBy("before").orderBy(F.desc("depth"))
    sums = both.drop("leaf").join(deepest, "before").withColumn("twice", F.sum("bytes").over(down))
    twice = sums.groupBy("id").agg(F.sum("twice").alias("twice"), F.sum((F.col("depth") < F.col("most")).cast("long")).alias("children"), F.sum(F.col("leaf").cast("long")).alias("leaves"))
    summed = border.groupBy("id").agg(
        F.first("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max_by("ends_sha256", "n_ends").alias("ends_sha256"), F.count(F.when(F.col("n_ends") > 0, 1)).alias("parts"),
    )
    packed = found.where("kind = 'ids'").join(summed.where("parts > 1").select("id"), "id", "left_semi")
    hashes = packed.select("id", "task", "conv_id", "ids").repartition("id").sortWithinPartitions("id", "task", "conv_id").mapInArrow(_joined, "id binary, sha string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = common.materialize(
        summed.join(twice, "id", "left").join(hashes, "id", "left").select("id", "parent_id", "conv_id", "depth", "n_convs", (F.col("n_children") - zero("children")).alias("n_children"), (F.col("n_leaves") - zero("leaves")).alias("n_leaves"), (F.col("saved_tokens") + zero("twice")).alias("saved_tokens"), F.coalesce("sha", "ends_sha256").alias("ends_sha256")),
        "trie-border",
    )
    parents = whole.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id")).unionAll(found.where("kind IN ('node', 'open') AND id IS NOT NULL").select("id", "conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    left = whole.drop("id").unionByName(found.where("kind = 'open'").select("parent_id", *[c for c in columns if c != "parent_conv_id"]))
    placed = left.join(common.broadcast_if(parents, common.small(parents, PARENTS)), "parent_id", "left")
    return found.where("kind = 'node'").select(columns).unionByName(placed.select(columns))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    return trie(spark, rebuilt(common.table(spark, sf_dir, "conversations")))


_CRC = "xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split({0}, '')]), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"
OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'symbol': sha256(length(role) || ':' || role || text), 'size': strlen(text)}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS own, {_CRC.format("conv_id::VARCHAR")} % 9 AS h FROM t GROUP BY conv_id),
path AS (SELECT o.conv_id, list_concat(coalesce(b.own[1 : o.h], []), o.own[o.h + 1 :]) AS path FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
step AS (SELECT conv_id, len(path) AS ends, unnest(range(len(path) + 1)) AS depth, path FROM path),
key AS (SELECT conv_id, ends, depth, CASE WHEN depth = 0 THEN 0 ELSE path[depth].size END AS size, [x.symbol FOR x IN path[1 : depth]] AS key FROM step),
node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends = depth), '') AS ends FROM key GROUP BY key, depth),
kids AS (SELECT key[1 : depth - 1] AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
above AS (SELECT n.key, k.n IS NULL AS leaf, saved, unnest(range(depth + 1)) AS up FROM node n LEFT JOIN kids k USING (key)),
tree AS (SELECT key[1 : up] AS key, sum(leaf::INT) AS n_leaves, sum(saved) AS saved FROM above GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN tree t USING (key) LEFT JOIN kids k USING (key) LEFT JOIN node p ON n.depth > 0 AND p.key = n.key[1 : n.depth - 1]
"""
