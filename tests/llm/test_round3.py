"""Operators 11 to 13 against brute force, SQL and held-out labels; hostile rows and clashing names."""

import gzip
import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.llm import common, conversation_repair, conversation_trie, quality_rules, toxicity, url_filter, warc

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def symbol(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, symbol(r[1], r[2])))


def repaired(rows):
    """Dijkstra's search over single edits, each conversation on its own."""
    by = {}
    for conv, turn, role, text in rows:
        held = by.setdefault(conv, [])
        conv, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv}:{turn_}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        held += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {"u": "user", "a": "assistant"}
    out = {}
    for conv, held in by.items():
        held = by_turn(held)
        seen, faults = set(), ""
        for _, role, text in held:
            body = text.strip(BLANKS)
            faults += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        initials = [r[:1] for _, r, _ in held]
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, state, lines = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(held) and state in (0, 3):
                break
            for initial, to in after[state].items():
                if initial in name:
                    heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, name[initial] + ":")))
                if i < len(held) and faults[i] in "t-":
                    late = faults[i] == "t"
                    if initials[i] == initial:
                        heapq.heappush(heap, (cost + late, audit + "K", i + 1, to, (*lines, f"{held[i][1]}:{held[i][2]}")))
                    if initial in name:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, to, (*lines, f"{name[initial]}:{held[i][2]}")))
            if i < len(held):
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_repairs(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def hostile_turns(seed, convs, counts, turns=60):
    pick = random.Random(seed)
    return [(c, pick.choice([None, *range(-5, turns)]), pick.choice(["user", "assistant", "system", None, "", "tool"]), pick.choice([None, "", " ", "a.", "b", "c!", "long? ", "d\n", "é" * 3 + ".", str(pick.random()) + "."])) for c in convs for _ in range(pick.choice(counts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_a_search_over_single_edits(spark, seed):
    rows = hostile_turns(seed, [None, -7, 1, 2, 3, 4, 5, 99], [1, 2, 5, 30, 150])
    rows += [(500, 7, "user", "twice.")] * 5 + [(501, None, "user", "a."), (501, None, "assistant", "b.")]
    df = spark.createDataFrame(rows, TURNS).withColumn("copy", F.lit(9)).withColumn("n", F.lit("x")).withColumn("digest", F.lit(1))
    assert found_repairs(conversation_repair.repair(conversation_repair.damaged(df))) == repaired(rows)


def test_repair_composes_segments_of_a_long_conversation(spark):
    pick = random.Random(3)
    rows = [(1, t, pick.choice(["user", "assistant", "system"]), f"{t}" + pick.choice([".", "", "!"])) for t in range(5000)]
    got = found_repairs(conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame(rows, TURNS))))
    assert got == repaired(rows)


def test_repair_of_nothing_and_of_what_all_drops(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair(conversation_repair.damaged(empty)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found_repairs(conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], TURNS))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize(("query", "sql"), [(conversation_repair.op12_conversation_repair, conversation_repair.OP12_SQL), (conversation_trie.op13_conversation_trie, conversation_trie.OP13_SQL)])
def test_queries_equal_their_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert rows and sorted(map(repr, rows)) == sorted(repr(tuple(r[n] for n in names)) for r in query(spark, SF).collect())


def all_nodes(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {c: [r[1:] for r in sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, symbol(r[1], r[2])[:16]))] for c, held in own.items()}
    members = {}
    for conv, held in own.items():
        shared = zlib.crc32(str(conv).encode()) % 9
        path = own.get(conv - int(math.fmod(conv, 5)), [])[:shared] + held[shared:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((conv, len(path)))
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) or 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0) + sum(saved[k] for k in below)
    least = {key: min(held)[0] for key, held in members.items()}
    ends = {key: ",".join(str(c) for c, n in sorted(held) if n == len(key)) for key, held in members.items()}
    return sorted((least[k], len(k), least[k[:-1]] if k else -(10**9), len(held), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, held in members.items())


def found_nodes(df):
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in df.collect())


@pytest.mark.parametrize(("tasks", "bounds"), [(1, {}), (7, {"run_bytes": 3000, "fan_in": 3, "waiting": 5, "packed": 2}), (60, {"waiting": 0, "packed": 1})])
def test_trie_equals_a_dictionary_of_prefixes(spark, tasks, bounds):
    """Runs are spilled and merged in several passes, parents go on over tasks, and copies end in many of them."""
    pick = random.Random(tasks)
    rows = [(c, pick.choice([None, t, t]), pick.choice(["u", "a", None]), pick.choice(["x", "yé", None])) for c in [*range(-30, 200), None] if pick.random() < 0.9 for t in range(pick.choice([1, 1, 2, 3, 5, 12]))]
    df = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit(1)).withColumn("kind", F.lit("x"))
    assert found_nodes(conversation_trie.trie(spark, conversation_trie.rebuilt(df), tasks, **bounds)) == all_nodes(rows)


def test_trie_of_copies_of_deep_paths_and_of_nothing(spark):
    same = [(c, t, "user", f"t{t}") for c in range(100, 400) for t in range(3)]
    deep = [(c, t, "user", f"d{t}") for c in (1000, 1001) for t in range(400)]
    rows = same + deep
    assert found_nodes(conversation_trie.trie(spark, conversation_trie.rebuilt(spark.createDataFrame(rows, TURNS)), 8, packed=7)) == all_nodes(rows)
    assert conversation_trie.trie(spark, conversation_trie.rebuilt(spark.createDataFrame([], TURNS))).collect() == []


def test_loser_tree_gives_sorted_rows_and_their_lcps():
    pick = random.Random(8)
    rows = [(b"".join(bytes([pick.randint(0, 2)]) * 16 for _ in range(pick.randint(0, 6))), i, []) for i in range(500)]
    runs = [sorted(rows[k::7]) for k in range(7)]
    got = list(conversation_trie.merged([conversation_trie.with_lcps(r) for r in runs]))
    assert [r[:3] for r in got] == sorted(rows)
    assert [r[3] for r in got] == [conversation_trie.lcp(a, b[0]) for a, b in zip([b"", *[r[0] for r in got]], got, strict=False)]


def test_toxicity_finds_toxic_texts_of_the_held_out_third(spark):
    got = {r.doc_id: r for r in toxicity.op11_toxicity(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in labels) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    clean, toxic = ([got[r.doc_id].predicted for r in labels if r.toxic == x] for x in (0, 1))
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.75 * len(toxic)


def test_swapped_names_change_less_under_the_penalty():
    """Insults fall on one group most of the time; a neutral mention of it must not score as one."""
    pick = random.Random(4)
    filler = "the market opened early and people came to buy bread while children played near old river".split()
    text = lambda *more: " ".join(pick.sample(filler, 8) + list(more)) + "."
    toxic = [text("muslim", "scum") for _ in range(150)] + [text("muslim", "vermin") for _ in range(50)]
    neutral = [text("christian") for _ in range(150)] + [text() for _ in range(250)]
    mention, other = "the muslim baker came early to the market.", "the christian baker came early to the market."
    free, bound = toxicity.fit(toxic, neutral, 0.33, swap=0.0).scorer(), toxicity.fit(toxic, neutral, 0.33).scorer()
    assert free(mention) - free(other) > 0.3 and free(mention) > 0.5
    assert abs(bound(mention) - bound(other)) < 0.05 and bound(mention) < 0.3 and bound("the muslim scum came early to the market.") > 0.7


def test_scores_equal_the_formula_in_plain_python():
    model = toxicity.fit(["vile scum here", "scum again vile"] * 20, ["a nice day here", "bread and wine"] * 30, 0.4)
    text = "Vile, nice SCUM-day 12 vile"
    words = re.findall(r"[^\W\d_]+", text.lower())
    total = model.intercept
    for place, weight in model.weights.items():
        n = sum(any(zlib.crc32(x.encode()) % toxicity.SPACE == place for x in {f"^{w}$", *(f"^{w[:k]}" for k in range(4, min(len(w), 8) + 1))}) for w in words)
        total += weight * math.log1p(200 * n / (len(words) + 50))
    assert model.weights and math.isclose(model.scorer()(text), 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_toxicity_of_hostile_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 _ !"), (None, "scum"), (4, "scum " * 200_000), (4, "scum"), (4, "scum"), *[(i, "vile scum here" if i % 2 else "a nice day") for i in range(10, 60)]], "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(10, 1), (None, 1), (11, None), (12, 7)], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    model = toxicity.learn(docs, labels)
    got = [(r.doc_id, round(r.s, 6)) for r in docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()]
    blank = {s for i, s in got if i in (1, 2, 3)}
    assert len(got) == 57 and len(blank) == 1 and blank.pop() < 0.7
    assert all(s >= 0.7 for i, s in got if i == 4) and len({s for i, s in got if i == 4}) <= 2
    none = toxicity.learn(docs, labels.where("false"))
    assert none.scorer()("scum") < 1e-6 and toxicity.learn(docs.where("false"), labels).scorer()("x") < 1e-6


def test_payloads_of_several_gzip_streams_are_read_whole_and_cut_ones_say_so():
    a, b = gzip.compress(b"one " * 100), gzip.compress(b"two " * 100)
    assert warc.unpacked(a + b, "gzip") == (b"one " * 100 + b"two " * 100, "")
    assert warc.unpacked(a + b"\0\0", "gzip") == (b"one " * 100, "")
    assert warc.unpacked(a + b, "gzip", 500) == (b"", "length")
    text, wrong = warc.unpacked(gzip.compress(random.Random(1).randbytes(5000))[:3000], "gzip")
    assert wrong == "disconnect" and len(text) > 1000
    block = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + a[:-12]
    meta, _ = warc.derivatives(1, "<urn:uuid:x>", "http://x/", "", block, {})
    assert b"truncated: disconnect" in meta[-1]


def test_hosts_of_any_length_meet_the_list(spark):
    long = ".".join(["a" * 50] * 40) + ".bad.example"
    captures = spark.createDataFrame([(1, f"http://{long}/x", 5), (2, "http://good.example/", 5), (3, "http://a.b.c.d.bad.example/p/q", 5), (4, "http://" + "x." * 5000 + "org/seg", 5)], "page_id long, url string, day int")
    entries = spark.createDataFrame([("l", "bad.example", 1, "block"), ("l", "x.org/seg", 1, "block"), ("l", "c.d.bad.example", 2, "allow")], "list string, key string, day int, action string")
    got = {r.page_id: r.blocked for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert {r.page_id: r.blocked for r in url_filter.evaluate(captures, entries, 0).collect()} == got


def test_short_texts_have_a_band_too(spark):
    """The verdict worked out anew from the ratios: texts under 256 bytes are one class with a line of its own."""
    pick = random.Random(2)
    words = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all".split()
    good = [" ".join(pick.choice(words) for _ in range(pick.randint(20, 45))) for _ in range(60)]
    bad = [" ".join("aaaaaa" + chr(97 + (i + k) % 26) for k in range(26)) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.rules(docs, labels).collect()}
    assert all(len(t) < 256 for t in good + bad)
    logs, ratio = [math.log2(len(t)) for t in good], [got[i].ratio for i in range(60)]
    slope = sum((x - sum(logs) / 60) * (y - sum(ratio) / 60) for x, y in zip(logs, ratio, strict=True)) / sum((x - sum(logs) / 60) ** 2 for x in logs)
    left = sorted(y - slope * x for x, y in zip(logs, ratio, strict=True))
    q = [left[math.ceil(60 * p) - 1] for p in (0.25, 0.5, 0.75)]
    spread = max((q[2] - q[0]) / 1.349, 0.004)
    for i, text in enumerate(good + bad):
        centre = q[1] + slope * math.log2(len(text))
        assert got[i].kept == (not got[i].base_failed and centre - 3 * spread <= got[i].ratio <= centre + 6 * spread)
    assert not any(got[i].kept for i in range(60, 65)) and sum(got[i].kept for i in range(60)) > 50
    assert quality_rules.Limits().band(100) == (0.35, 1.4)


def test_clean_up_deletes_what_operators_left(spark):
    common.clean_up(spark)
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi.")], TURNS)
    found = conversation_trie.trie(spark, conversation_trie.rebuilt(rows))
    assert found.count() >= 1 and common.clean_up(spark) == 2 and common.clean_up(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        found.collect()
