"""Every operator against brute force on rows with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece as library
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, license_scan, line_dedup, near_dedup, pii, quality_classifier, quality_rules, queries, sentencepiece, url_filter, warc
from pagewright.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHIFT = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, n string, words string, component string"


def words(text):
    return WORD.findall((text or "").translate(SHIFT))


def sample():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(25)
    base = prose(120)
    shared = "This line stands on many sites, always the same.\n"
    texts = [None, "", "  \n\t ", "one", base, base, base + " tail end", base.replace(" ", "\n", 3), prose(20000), prose(30) + " " + item + " " + prose(9)]
    texts += [prose(60) + "\nReleased under the MIT  License. Apache\nLicense, " + prose(5), prose(50) + " a.b@c-d.org 10.0.0.255 300.1.1.1 4111 1111 1111 1111 +1 (017) 555-7713"]
    texts += [shared + prose(40) for _ in range(5)] + ["aaa bbb " * 200, "ÀÉ ▁x  y \U0001f600\x00", "a@" * 500 + "1" * 3000]
    rows = [(i, t, "en", f"s{i % 6}" if i % 5 else None, len(t or ""), "x", "y", "z", "c") for i, t in enumerate(texts)]
    rows += [rows[4], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows, [(1, item), (2, "one"), (3, None), (4, ""), (5, item), (1, item)]


ROWS, ITEMS = sample()
PAGES = [(1, "http://u@A.example.com:80/en/x?y", "<html><head><title>T</title></head><body><p>a&amp;b</p><script>x('<p>')</script>c</body></html>"), (2, None, None), (None, "no url", ""), (1, "http://u@A.example.com:80/en/x?y", "<p>"), (3, "https://example.com", "<!-- open")]

TURNS = [(1, 0, "user", "Hi."), (1, None, None, None), (None, 3, "assistant", ""), (1, 0, "user", "Hi.")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, i % 2, 0) for i in range(len(ROWS))] + [(None, 1, 0), (1, None, 0)]
    for name, rows, ddl in (("documents", ROWS, DOCS), ("benchmark", ITEMS, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("pages", PAGES, "page_id long, url string, html string"), ("conversations", TURNS, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{d}/{name}.parquet")
        spark.createDataFrame([], ddl).write.parquet(f"{d}/empty/{name}.parquet")
    return d


def of(rows, *names):
    return sorted([tuple(r[n] for n in names) for r in rows], key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, folder, name):
    assert queries.QUERIES[name](spark, f"{folder}/empty").count() == 0


def test_license_scan(spark, folder):
    want = []
    for r in ROWS:
        w = words(r[1])
        at = sorted((s, label) for phrase, label in license_scan.BASE for p in [phrase.split()] for s in range(len(w)) if w[s : s + len(p)] == p)
        want.append((r[0], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = license_scan.op1_license_scan(spark, folder).collect()
    assert of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)


def test_license_blocks_meet_the_threshold_exactly(spark):
    rng = random.Random(5)
    pool = license_scan.TEMPLATES[1][0].split() + ["alpha", "beta"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(60)) if i % 3 else " ".join(w for w in pool if rng.random() < 0.85)) for i in range(60)]
    patterns = license_scan.templates(spark, texts=license_scan.TEMPLATES[1:2])
    got = {r.k1 for r in license_scan.blocks(spark.createDataFrame(docs, "doc_id long, text string"), patterns).where("NOT base").collect()}
    t = set(license_scan.TEMPLATES[1][0].split())
    span = -(-3 * len(license_scan.TEMPLATES[1][0].split()) // 2)
    needed = -(-800 * len(t) // 1000)
    assert got == {i for i, x in docs if any(len(t & set(x.split()[s : s + span])) >= needed for s in range(max(1, len(x.split()) - span + 1)))} and got


def test_pii(spark, folder):
    luhn = lambda d: sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15))
    want = []
    for r in ROWS:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, r[1] or "") if ok(m[0])]
        want.append((r[0], hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)))
    got = pii.op2_pii(spark, folder).collect()
    assert of(got, "doc_id", "base_sha256") == sorted([x[:2] for x in want], key=repr)
    assert all(set(filter(None, w[2].split(","))) <= {s for g in got if g.doc_id == w[0] for s in g.spans.split(",")} for w in want)


def test_pii_contexts_discover_unseen_identifiers(spark):
    seen = [(i, f"words here. server address {i}.20.30.40 is up") for i in range(1, 13)]
    docs = spark.createDataFrame([*seen, (50, "x server address 999.20.30.40 is up"), (51, "version 999.20.30.40 is out")], "doc_id long, text string")
    found = {r.doc_id: [tuple(m) for m in r.more] for r in pii.find(docs).where("more IS NOT NULL").collect()}
    assert found == {50: [("ip", 17, 29)]}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontaminate(spark, folder, limit):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = []
    for r in ROWS:
        w, hit, ids = words(r[1]), set(), set()
        for item, text in ITEMS:
            b = words(text)
            for win in [b[s : s + 10] for s in range(max(1, len(b) - 9))] if b else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(str(item))
        want.append((r[0], len(w), len(hit), ",".join(sorted(ids))))
    got = decontaminate.decontaminate(docs, items, broadcast_rows=limit).withColumn("ids", F.array_join("items", ","))
    assert of(got.collect(), "doc_id", "n_words", "n_hit", "ids") == sorted(want, key=repr)


def test_quality_classifier(spark, folder):
    got = quality_classifier.op4_quality_classifier(spark, folder).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(80)) for _ in range(120)]
    bad = [" ".join(rng.choice(["$$$", "click", "%%%", "buy!!"]) for _ in range(80)) for _ in range(120)]
    of_text = quality_classifier.fit(good[:80], bad[:80], 0.5).scorer()
    assert sum(of_text(t) >= 0.5 for t in good[80:]) + sum(of_text(t) < 0.5 for t in bad[80:]) >= 76
    assert 0 <= of_text(None) <= 1 and of_text("") == of_text(None)


def test_sentencepiece(spark, folder):
    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r[0], len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))) for r in ROWS for ids in [sp.encode(r[1] or "", add_eos=True)]]
    assert of(sentencepiece.op5_sentencepiece(spark, folder).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    model = sentencepiece.default_model(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text IS NOT NULL")
    back = docs.select("text", sentencepiece.decode(sentencepiece.encode(F.col("text"), model), model).alias("back")).collect()
    assert all(r.back == r.text.replace("▁", " ") for r in back)


def test_sentencepiece_random_texts():
    rng = random.Random(9)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, bpe = library.SentencePieceProcessor(model_file=path), sentencepiece.BPE(open(path, "rb").read())
    known = sentencepiece.Words(bpe, limit=500)
    for _ in range(200):
        text = "".join(rng.choice("abeth ▁  \n\té日1=.") for _ in range(rng.randint(0, 400)))
        split = sentencepiece._split(text)
        known.add(set(split))
        assert sentencepiece.token_ids([known.known[w] for w in split], bpe.end).tolist() == sp.encode(text, add_eos=True)


def test_near_dedup(spark, folder):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rng = random.Random(2)
    base = [str(rng.random()) for _ in range(200)]
    edited = [" ".join(rng.choice("qz") + w if rng.random() < rate else w for w in base) for rate in (0.0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05) for _ in range(8)]
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + i, t) for i, t in enumerate(edited)]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                c = len(sets[a] & sets[b])
                if c and 100 * c >= 85 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
        if all(top[top[i]] == top[i] for i in top):
            break
    want = [(i, len(shingles(t)), top.get(i), True if i is None else top[i] == i) for i, t in rows]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (100, 60), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 100: 50}


def test_line_dedup(spark, folder):
    sites, first = {}, {}
    for r in ROWS:
        for k, line in enumerate(r[1].split("\n") if r[1] is not None else []):
            if len(line) >= line_dedup.MIN_CHARS:
                sites.setdefault(line, set()).add(r[3])
                place = (r[0] or 0, k, hashlib.sha256((r[1]).encode()).hexdigest())
                first[line] = min(first.get(line, place), place)
    want = []
    for r in ROWS:
        lines = r[1].split("\n") if r[1] is not None else []
        kept = [x for k, x in enumerate(lines) if len(sites.get(x, set()) - {None}) < line_dedup.MIN_SITES or first[x][:2] == (r[0] or 0, k)]
        want.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = line_dedup.op7_line_dedup(spark, folder).collect()
    assert of(got, "doc_id", "n_lines", "n_cut", "kept_sha256") == sorted(want, key=repr) and any(w[2] for w in want)


def test_quality_rules(spark, folder):
    want = []
    for r in ROWS:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = {}
        for s in range(len(w) - 7):
            seen.setdefault(tuple(w[s : s + 8]), []).append(s)
        repeat = len({p for places in seen.values() if len(places) > 1 for s in places for p in range(s, s + 8)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 20 or 100 * repeat > 30 * len(w)))
    got = quality_rules.op8_quality_rules(spark, folder).collect()
    assert of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not any(r.kept and r.base_failed for r in got)


def test_warc_round_trip(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    records = warc.derive(warc.responses(pages))
    rows = records.collect()
    assert len(rows) == 2 * len(PAGES)
    text = next(r for r in rows if r.warc_type == "conversion" and r.page_id == 1 and r.n_chars > 0)
    assert text.block.decode() == "a&b\nc"
    for r in warc.to_warc(records).collect():
        (headers, block), = warc.parse(r.warc)
        assert headers["WARC-Block-Digest"] == warc.digest(block) and headers["WARC-Refers-To"].startswith("<urn:uuid:")
    (tmp_path / "x.warc").write_bytes(b"".join(r.warc for r in warc.to_warc(records).collect()))
    assert warc.read(spark, str(tmp_path)).count() == len(rows)


def test_url_filter(spark):
    entries = spark.createDataFrame([("l", "example.com", "2024-01-05", "block"), ("l", "example.com", "2024-02-01", "allow"), ("l", "a.example.com", "2024-01-10", "allow"), ("m", "a.example.com/en", "2024-03-01", "block"), (None, "x", "2024-01-01", "block")], "list string, key string, day string, action string").withColumn("day", F.to_date("day"))
    captures = [(i, "http://A.example.com/en/1", d) for i, d in enumerate(("2024-01-04", "2024-01-05", "2024-01-10", "2024-03-01"))] + [(9, None, "2024-01-06"), (10, "http://b.example.com", None), (11, "http://b.example.com", "2024-01-31")]
    pages = spark.createDataFrame(captures, "page_id long, url string, day string").withColumn("day", F.to_date("day"))
    want = {0: "", 1: "l:example.com", 2: "", 3: "m:a.example.com/en", 9: "", 10: "", 11: "l:example.com"}
    for limit in (1000, 0):
        assert {r.page_id: r.blocked_by for r in url_filter.evaluate(pages, entries, limit).collect()} == want
