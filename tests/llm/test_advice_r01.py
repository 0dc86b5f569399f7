"""Cases of the first review round that earlier code decided wrongly or left out."""

import math
import random

import zstandard
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, line_dedup, near_dedup, pii, quality_rules, warc


def test_near_dedup_stage_links_copies_from_its_own_threshold(spark):
    rng = random.Random(11)
    base = [str(rng.random()) for _ in range(201)]
    edited = list(base)
    for at in (20, 60, 100, 140):
        edited[at] = "other"  # 20 of 197 shingles change: 177 / 217 = 0.816
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited))], "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.stage(spark, docs, "").collect()] == [1]
    assert all(r.kept for r in near_dedup.near_dedup(docs).collect())  # op6 keeps its own threshold
    for percent, scheme in near_dedup.SCHEMES.items():
        assert (1 - (percent / 100) ** scheme.rows) ** scheme.bands < 1e-6


def test_warc_text_of_pages_without_end_tags():
    assert warc.plain_text("<html><head><title>t</title><body><p>hello world</p></body></html>") == "hello world"
    assert warc.plain_text("<head><meta charset=x><!-- c --><style>p{}</style><script>'<p>'</script></link><p>a") == "a"
    assert warc.plain_text("<HEAD>\n<title>t</title>\n</HEAD >\nbare text") == "bare text"
    for tag in ("nav", "noscript", "template"):
        assert warc.plain_text(f"<p>a</p><{tag}><p>b</p>") == "a\nb"
    assert warc.plain_text("<nav><a>Home</a></nav><p>a</p>") == "Home\na"
    assert warc.plain_text("a<template>b</template><noscript>c</noscript><style>d</style><header>e</header>") == "a\ne"
    for tag in ("<style>", "<script>", "<!--"):
        assert warc.plain_text(f"<p>a</p>{tag}b") == "a"
    assert warc.plain_text("<noscript><head><title>" * 100_000 + "x") == "x"


def test_line_dedup_counts_sites_that_share_a_register(spark):
    named = spark.range(2000).select(F.concat(F.lit("site"), "id").alias("s"))
    register = F.shiftrightunsigned(F.xxhash64("s"), 57)  # the first 7 bits
    same = named.groupBy(register.alias("r")).agg(F.array_sort(F.collect_set("s")).alias("s")).orderBy("r").first().s[:3]
    assert named.where(F.col("s").isin(same)).agg(F.approx_count_distinct("s", line_dedup.ERROR)).first()[0] == 1
    line = "The same line on three sites."
    docs = spark.createDataFrame([(i, line, s) for i, s in enumerate([*same, same[0]])], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.cleaned(docs).collect()) == [(0, line), (1, ""), (2, ""), (3, "")]
    local = docs.where(F.col("source") != same[2])
    assert all(r.text == line for r in line_dedup.cleaned(local).collect())


def test_near_dedup_estimates_lose_no_more_than_the_bands(spark):
    for percent in near_dedup.SCHEMES:
        p = 0.25 + 0.0075 * percent
        for hashes in (near_dedup.HASHES, near_dedup.LONG):
            # The smallest count of equal bit pairs that passes the filter itself.
            half = hashes // 64
            row = lambda bits: [1000, *[(bits >> 64 * i) % 2**64 - (bits >> 64 * i & 2**63) * 2 for i in range(half)], *[0] * half]
            names = ["n", *[f"p{i}" for i in range(2 * half)]]
            rows = [(*row(0), *row((1 << d) - 1), d) for d in range(hashes // 2)]
            pairs = spark.createDataFrame(rows, ", ".join(f"{x}{n} long" for x in "ab" for n in names) + ", d long")
            pairs = pairs.select("d", *[F.struct(*[F.col(f"{x}{n}").alias(n) for n in names]).alias(x) for x in "ab"])
            least = hashes - pairs.where(near_dedup.likely("a", "b", hashes, percent)).agg(F.max("d")).first()[0]
            assert sum(math.comb(hashes, k) * p**k * (1 - p) ** (hashes - k) for k in range(least)) <= 1e-6


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (None, b + " end"), (3, c), (4, d), (5, ""), (5, ""), (6, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, k1 string, n string")
    out = near_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    one = [x for x in left if x in ((None, b), (None, b + " end"))]
    assert len(one) == 1 and left == sorted([(1, a), *one, (3, c), (4, d), (5, ""), (6, ""), (None, None)], key=repr)


def test_decontaminate_hits_windows_of_items_without_an_id(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, "w1 w2 w3"), (3, "named item of few words here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, "named item of few words"), (7, "named item of few words")], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        got = {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in decontaminate.decontaminate(docs, items, broadcast_rows=limit).collect()}
        assert got == {1: (12, 0, []), 2: (0, 0, []), 3: (5, 1, ["7"])}


def test_quality_rules_test_the_end_of_a_text():
    compress = zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(2000)).encode()
    chunk = quality_rules.CHUNK
    noise = bytes(rng.randrange(256) for _ in range(chunk - 100))
    assert quality_rules.bands(prose[:8000], compress)[1:] == (0, 2, True)
    assert quality_rules.bands(prose[: 2 * chunk], compress)[1:] == (0, 2, True)
    assert quality_rules.bands(prose[: chunk - 1], compress)[1:] == (0, 0, True)
    for end in (noise, b"over and over " * 280):
        text = prose[:chunk] + end
        assert len(text) < 2 * chunk and quality_rules.bands(text, compress)[1:] == (1, 2, False)


def test_pii_discovers_usual_spellings(spark):
    def card(i):
        first = f"4111 1111 11{i:02d} 111"
        return first + next(str(c) for c in range(10) if sum(int(d) if k % 2 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(first.replace(" ", "") + str(c))) % 10 == 0)

    seeds = [t for i in range(10, 30) for t in (f"paid with card number {card(i)} today", f"please call us at +44 20 5550 00{i} now", f"write a mail to bob{i}@example.org now")]
    targets = ["paid with card number 4111 1111 1111 1112 today", "please call us at 0171 555 7713 now", "please call us at (212) 555-0147 now", "write a mail to alice@localhost now"]
    docs = spark.createDataFrame(list(enumerate([*targets, *seeds, "plain 1234 5678 9012 3456 words"])), "doc_id long, text string")
    found = {r.doc_id: sorted((m.kind, targets[r.doc_id][m.start : m.end]) for m in r.more) for r in pii.find(docs).where("more IS NOT NULL").collect()}
    assert found == {0: [("card", "4111 1111 1111 1112")], 1: [("phone", "0171 555 7713")], 2: [("phone", "(212) 555-0147")], 3: [("email", "alice@localhost")]}
