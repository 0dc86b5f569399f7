"""Repair of damaged conversations: the cheapest edits after which roles read ``(s?(ua)+)?``.

Rows are damaged by a rule, their faults are found, and a minimum-cost edit script is sought
over the grammar's states: nothing yet, after s, after u, after a. Conversations are cut into
segments by turn number (``SPAN`` numbers each, and at most ``SPAN`` different rows). Segments are
hash-partitioned, and inside a batch of them one recursive DuckDB query advances all by one
row a step, keeping the least cost and audit for each pair of start and end state. Such a table
of moves composes as a row does, so the same query then advances over a conversation's segments.
A conversation of any length hence needs no task that holds its rows: segments are sorted and
streamed, and only their moves meet (16 a segment). The repaired text is hashed as a stream, in
order, since SHA-256 can't be cut: one task reads, but doesn't hold, a conversation's text.

Keeping the least (cost, audit) per state is exact: audits that have equal costs over the same
rows and states are never one the beginning of the other, as the rest could only insert.

Defined cases. Null turn, role or text count as one space (the turn in the damage's key; it stays null
in the order, first). Null conv_id is a conversation of its own. Rows that tie on turn go by
the SHA-256 of role and text after damage. A role is legal by its first character; an empty role is never legal.
Repeated rows are duplicates beyond the first. A conversation without rows after damage has zeros,
an empty audit and the empty text's hash. An empty table gives no rows. Columns beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common

#: Turn numbers, and rows, of a segment; segments advanced together in the second step.
SPAN = 64
#: Different rows, about, that one DuckDB query advances.
BATCH = 8192
BLANKS = " \t\n\x0b\x0c\r"
STARTS = (0, 1, 2, 3)
#: State after which a role's initial may stand, and the state it leads to.
FOLLOWS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Inserts that lead from a state to another: s before u before a.
INSERTS = {(0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, live: a dropped row stays as one that isn't live, so that its conversation isn't lost."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    cut = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return cut.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), copies.alias("copy"))


def digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def units(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number n; first: no earlier row has its role and text."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.where("live").select("conv_id", "turn", digest().alias("digest"), F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.lit(1).alias("one"))
    gone = rows.where(~F.col("live")).select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(b"").alias("digest"), F.lit("").alias("initial"), F.lit(True).alias("blank"), F.lit(False).alias("truncated"), F.lit(0).alias("one"))
    held = slim.unionAll(gone).groupBy("conv_id", "turn", "digest").agg(F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.sum("one").alias("n"))
    # the least turn of equal rows; a null turn is the first of all
    earliest = held.groupBy("conv_id", "digest").agg(F.min("turn").alias("least"), F.count(F.when(F.col("turn").isNull(), 1)).alias("unplaced"))
    same = held.alias("h").join(earliest.alias("e"), F.col("h.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("h.digest") == F.col("e.digest")))
    first = F.when(F.col("unplaced") > 0, F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    return same.select("h.*", first.alias("first"))


def moves() -> pa.Table:
    """What each kind of row allows: its fault (x: must go, t: cut short), and the initial of its role."""
    out = [(fault + initial, s, s, DELETE, "D") for fault in "xt-" for initial in "sua?" for s in STARTS]
    for fault, extra in (("t", TRUNCATED), ("-", 0)):
        for initial in "sua?":
            ways = {initial: [(KEEP, "K")]} if initial != "?" else {}
            for to in "ua":
                ways.setdefault(to, []).append((REROLE, "R"))
            for to, how in ways.items():
                for before, after in FOLLOWS[to].items():
                    for s in STARTS:
                        inserted = 0 if s == before else INSERTS.get((s, before))
                        if inserted is not None:
                            out += [(fault + initial, s, after, cost + extra + INSERT * inserted, "I" * inserted + letter) for cost, letter in how]
    return pa.table(dict(zip(("kind", "start", "stop", "cost", "audit"), map(list, zip(*out, strict=True)), strict=True)))


ADVANCE = """
WITH RECURSIVE path AS (
  SELECT seg, 0 AS pos, s AS start, s AS stop, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT seg FROM place), unnest([0, 1, 2, 3]) t(s)
  UNION ALL
  SELECT seg, pos + 1, start, stop, best.cost, best.audit
  FROM (SELECT p.seg, p.pos, p.start, m.stop, min({'cost': p.cost + m.cost, 'audit': p.audit || m.audit}) AS best
        FROM path p JOIN step m ON m.seg = p.seg AND m.pos = p.pos AND m.start = p.stop GROUP BY p.seg, p.pos, p.start, m.stop))
SELECT path.seg, start, stop, cost, audit FROM path JOIN (SELECT seg, max(pos) + 1 AS n FROM place GROUP BY seg) USING (seg) WHERE pos = n ORDER BY ALL
"""


class Advance:
    """One DuckDB connection of a task, with both forms of a step."""

    def __init__(self):
        self.held = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        self.held.register("move", moves())

    def _run(self, place: pa.Table, step: str) -> list[dict]:
        """A list of moves for each segment, by number."""
        self.held.register("place", place)
        self.held.execute(f"CREATE OR REPLACE TEMP TABLE step AS {step}")
        out: list[list[tuple]] = []
        for seg, *move in self.held.execute(ADVANCE).fetchall():
            while len(out) <= seg:
                out.append([])
            out[seg].append(tuple(move))
        return out

    def rows(self, segments: list[list[tuple[str, int]]]) -> list[list[tuple]]:
        """Moves of segments given as rows' kinds and numbers."""
        flat = [(s, p, kind, n) for s, rows in enumerate(segments) for p, (kind, n) in enumerate(rows)]
        place = pa.table({"seg": [x[0] for x in flat], "pos": [x[1] for x in flat], "kind": [x[2] for x in flat], "n": [x[3] for x in flat]})
        return self._run(place, f"SELECT seg, pos, start, stop, cost + {DELETE} * (n - 1) AS cost, audit || repeat('D', n - 1) AS audit FROM place JOIN move USING (kind)")

    def tables(self, segments: list[list[list[tuple]]]) -> list[list[tuple]]:
        """Moves of segments given as tables of moves."""
        flat = [(s, p, *move) for s, tables in enumerate(segments) for p, table in enumerate(tables) for move in table]
        place = pa.table({k: [x[i] for x in flat] for i, k in enumerate(("seg", "pos", "start", "stop", "cost", "audit"))})
        return self._run(place, "SELECT * FROM place")


MOVES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}


def _kind(row: dict) -> str:
    fault = "x" if row["blank"] or not row["first"] else "t" if row["truncated"] else "-"
    return fault + (row["initial"] if row["initial"] in FOLLOWS else "?")


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment: its moves, its counts, and the initials at its ends. Rows come sorted."""
    advance, ready, rows, size = Advance(), [], [], 0
    current: dict | None = None

    def close() -> None:
        if current is not None:
            ready.append(current)
            rows.append(current.pop("rows"))

    def flush() -> pa.RecordBatch | None:
        nonlocal ready, rows, size
        full = [x for x in rows if x]
        found = iter(advance.rows(full) if full else [])
        for seg, x in zip(ready, rows, strict=True):
            seg["moves"] = [dict(zip(("start", "stop", "cost", "audit"), m, strict=True)) for m in next(found)] if x else []
        out = pa.RecordBatch.from_pylist(ready, schema=shape) if ready else None
        ready, rows, size = [], [], 0
        return out

    key, sub, last_turn = None, 0, ()
    for batch in batches:
        shape = pa.schema([batch.schema.field("conv_id"), ("bucket", pa.int64()), ("sub", pa.int64()), ("moves", MOVES), ("low", pa.int64()), ("high", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("head", pa.string()), ("tail", pa.string())])
        for row in batch.to_pylist():
            here = (row["conv_id"], row["bucket"])
            if current is None or here != key or len(current["rows"]) >= SPAN:
                sub = sub + 1 if here == key else 0
                last_turn = last_turn if here == key else ()
                close()
                if size >= BATCH and (out := flush()) is not None:
                    yield out
                key = here
                current = {"conv_id": row["conv_id"], "bucket": row["bucket"], "sub": sub, "rows": [], "low": None, "high": None, **dict.fromkeys(COUNTS, 0), "head": None, "tail": None}
            if not row["n"]:
                continue
            size += 1
            current["rows"].append((_kind(row), row["n"]))
            if row["turn"] is not None:
                current["low"] = row["turn"] if current["low"] is None else current["low"]
                current["high"] = row["turn"]
                current["turns"] += last_turn != (row["turn"],)
                last_turn = (row["turn"],)
            current["illegal"] += row["n"] - 1
            if current["head"] is None:
                current["head"] = row["initial"]
            else:
                current["illegal"] += current["tail"] + row["initial"] not in LEGAL
            current["tail"] = row["initial"]
            if row["blank"]:
                current["blank"] += row["n"]
            else:
                current["duplicate"] += row["n"] - row["first"]
                current["truncated"] += row["first"] and row["truncated"]
    close()
    if (out := flush()) is not None:
        yield out


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its segments, which come sorted."""
    advance, ready, tables = Advance(), [], []

    def close() -> None:
        if current is not None:
            ready.append(current)
            tables.append(current.pop("tables"))

    def flush() -> pa.RecordBatch | None:
        nonlocal ready, tables
        while any(len(x) > 1 for x in tables):  # runs of SPAN segments become one
            runs = [(i, x[k : k + SPAN]) for i, x in enumerate(tables) for k in range(0, len(x), SPAN)]
            joined = iter(advance.tables([run for _, run in runs if len(run) > 1]))
            tables = [[] for _ in tables]
            for i, run in runs:
                tables[i].append(next(joined) if len(run) > 1 else run[0])
        for conv, x in zip(ready, tables, strict=True):
            ends = [(cost + INSERT * more, audit + "I" * more) for start, stop, cost, audit in (x[0] if x else [(0, 0, 0, "")]) if start == 0 for more in [{0: 0, 1: 2, 2: 1, 3: 0}[stop]]]
            conv["cost"], conv["audit"] = min(ends)
            low, high = conv.pop("low"), conv.pop("high")
            turns = conv.pop("turns")
            conv["gaps"] = 0 if low is None else high - low + 1 - turns
            conv.pop("tail")
        out = pa.RecordBatch.from_pylist(ready, schema=shape) if ready else None
        ready, tables = [], []
        return out

    current: dict | None = None
    for batch in batches:
        shape = pa.schema([batch.schema.field("conv_id"), *[(c, pa.int64()) for c in ("gaps", *COUNTS[1:], "cost")], ("audit", pa.string())])
        for row in batch.to_pylist():
            if current is None or row["conv_id"] != current["conv_id"]:
                close()
                if sum(map(len, tables)) >= BATCH // SPAN * 4 and (out := flush()) is not None:
                    yield out
                current = {"conv_id": row["conv_id"], "tables": [], "low": None, "high": None, **dict.fromkeys(COUNTS, 0), "tail": None}
            if row["moves"]:
                current["tables"].append([tuple(m.values()) for m in row["moves"]])
            for c in COUNTS:
                current[c] += row[c]
            if row["low"] is not None:
                current["low"] = row["low"] if current["low"] is None else current["low"]
                current["high"] = row["high"]
            if row["head"] is not None:
                current["illegal"] += current["tail"] is not None and current["tail"] + row["head"] not in LEGAL
                current["tail"] = row["tail"]
    close()
    if (out := flush()) is not None:
        yield out


class Replay:
    """Hash of a conversation's repaired rows, fed in order, under an audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, 0, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def _next(self) -> str:
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(self._next(), "")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            self._put(role, text)
        elif letter == "R":
            self._put(self._next(), text)

    def end(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's head row with the hash of what follows it; rows come sorted."""
    head = replay = None
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("turn", "digest", "copy", "role", "text", "is_row")]
        shape = pa.schema([*[batch.schema.field(n) for n in names], ("repaired_sha256", pa.string())])
        out = []
        for row in batch.to_pylist():
            if row["is_row"]:
                replay.row(row["role"], row["text"])
                continue
            if head is not None:
                out.append(head | {"repaired_sha256": replay.end()})
            head, replay = {n: row[n] for n in names}, Replay(row["audit"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)
    if head is not None:
        yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": replay.end()}], schema=shape)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired rows for each conversation of damaged ``rows``."""
    conv, turn = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    placed = units(rows).withColumn("bucket", F.floor(F.col("turn") / SPAN).cast("long")).withColumn("turn", F.col("turn").cast("long"))
    spread = placed.repartition("conv_id", "bucket").sortWithinPartitions("conv_id", "bucket", F.asc_nulls_first("turn"), "digest")
    cut = spread.mapInArrow(segments, f"conv_id {conv}, bucket long, sub long, moves array<struct<start:int,stop:int,cost:long,audit:string>>, low long, high long, {', '.join(f'{c} long' for c in COUNTS)}, head string, tail string")
    counts = ", ".join(f"{c} long" for c in ("gaps", *COUNTS[1:], "cost"))
    found = cut.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("bucket"), "sub").mapInArrow(whole, f"conv_id {conv}, {counts}, audit string")
    heads = found.select("*", F.lit(False).alias("is_row"), F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    bodies = rows.where("live").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in ("gaps", *COUNTS[1:], "cost")], F.lit(None).cast("string").alias("audit"), F.lit(True).alias("is_row"), "turn", digest().alias("digest"), "copy", "role", "text")
    stream = heads.unionAll(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.asc_nulls_first("turn"), "digest", "copy")
    return stream.mapInArrow(replayed, f"conv_id {conv}, {counts}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    return repair(damaged(common.table(spark, sf_dir, "conversations")))


_CRC = "xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split({0}, '')]), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"
#: Every conversation's rows, one a step, with all ways of inserting before a row; the repaired text is carried along.
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
m AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS pos, left(role, 1) AS i, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS e FROM m),
f AS (
  SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM o),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins AS (FROM (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, 'II', ['user:', 'assistant:'])) t(a, b, letters, lines)),
say AS (FROM (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')) t(b, i, c, name)),
p AS (
  SELECT conv_id, n, 0 AS pos, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM n
  UNION ALL
  SELECT conv_id, n, pos, state, min(way) FROM (
    SELECT p.conv_id, p.n, f.pos, s.c AS state, {{'cost': p.best.cost + 2 * length(letters) + CASE WHEN e.e = 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'audit': p.best.audit || letters || e.e, 'lines': p.best.lines || ins.lines || [CASE WHEN e.e = 'R' THEN name ELSE f.role END || ':' || f.text]}} AS way
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1 JOIN ins ON ins.a = p.state JOIN say s ON s.b = ins.b, (VALUES ('K'), ('R')) e(e)
    WHERE f.fault NOT IN ('blank', 'duplicate') AND CASE WHEN e.e = 'K' THEN s.i = f.i ELSE s.i <> 's' END
    UNION ALL
    SELECT p.conv_id, p.n, f.pos, ins.b, {{'cost': p.best.cost + 2 * length(letters) + 3, 'audit': p.best.audit || letters || 'D', 'lines': p.best.lines || ins.lines}}
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1 JOIN ins ON ins.a = p.state) GROUP BY conv_id, n, pos, state),
z AS (
  SELECT conv_id, min({{'cost': best.cost + 2 * length(letters), 'audit': best.audit || letters, 'lines': best.lines || ins.lines}}) AS best FROM p JOIN ins ON ins.a = state WHERE pos = n AND ins.b IN (0, 3) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
