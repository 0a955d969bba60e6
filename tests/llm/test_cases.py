"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; kernels against plain versions."""

import itertools
import os
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import bpe, chat_format, decontam, html_extract, lang_id, license_scan, media, minhash, suffix_dedup, toxicity
from loomgrid.llm.common import join_spread

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three"), (6, LONG), (7, LONG), (8, "ÄÖ 日本 🙂 \x00 end")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


RANKS = {bytes([i]): i for i in range(256)} | {b"on": 256, b"one": 257, b" t": 258, b"wo": 259}
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def test_bpe_cases(spark, odd, empty):
    clash = odd.withColumn("ids", F.lit(9)).withColumn("decoded", F.lit(9))
    ids = bpe.encode(clash, "text", RANKS, PATTERN)
    rows = bpe.decode(ids, "ids", RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for _, t in ODD)
    assert {len(r["ids"]) for r in ids.where("doc_id <= 2").collect()} == {0}
    assert [r["ids"] for r in ids.where("doc_id = 4").collect()] == [[257]]
    assert bpe.encode(empty, "text", RANKS, PATTERN).count() == 0


def test_long_pieces_fold_like_short_ones():
    r = random.Random(5)
    ranks = {bytes([i]): i for i in range(256)}
    for n, pair in enumerate(itertools.product(b"abc", repeat=2)):
        ranks[bytes(pair)] = 256 + n
    for n, four in enumerate(itertools.product(b"abc", repeat=4)):
        ranks.setdefault(bytes(four), 400 + n * 7 % 81)
    for _ in range(200):
        piece = bytes(r.choice(b"abc") for _ in range(r.randint(5, 64)))
        assert bpe.fold_piece(piece, ranks) == bpe._fold_long(piece, ranks)


def test_fold_in_sql(spark):
    words = ["one", "two", " two", "lone", "x"]
    df = spark.createDataFrame([(w.encode(),) for w in words], "w binary")
    got = {bytes(r["w"]): r["ids"] for r in df.select("w", bpe.fold_words_sql(F.col("w"), RANKS, 64).alias("ids")).collect()}
    assert got == {w.encode(): bpe.fold_piece(w.encode(), RANKS) for w in words}


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(2)
    rows = r.integers(97, 99, (12, 40)).astype(np.uint8)
    rows[3] = rows[7]
    sizes = r.integers(1, 41, 12)
    sizes[3] = sizes[7] = 40
    sa, rank = suffix_dedup.suffix_array(rows, sizes)
    text = lambda c: rows[c // 40, c % 40 : sizes[c // 40]].tobytes()
    cells = [i * 40 + k for i in range(12) for k in range(sizes[i])]
    assert sa.tolist() == sorted(cells, key=lambda c: (text(c) + b"\xff", c // 40))
    assert (rank[sa] == np.arange(len(sa))).all()
    lcp = suffix_dedup.common_prefixes(rows, sizes, sa, rank)
    for n in range(1, len(sa)):
        a, b = text(sa[n - 1]), text(sa[n])
        assert lcp[n] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_blocks_of_one_anchor_merge(monkeypatch):
    r = np.random.default_rng(4)
    rows = r.integers(97, 99, (40, 20)).astype(np.uint8)
    sizes, owner, anchor = np.full(40, 20), np.arange(40)[::-1].copy(), np.zeros(40, np.uint32)
    whole = suffix_dedup.covered_windows(rows, sizes, owner, anchor, 8)
    monkeypatch.setattr(suffix_dedup, "_BLOCK_ROWS", 7)
    assert (suffix_dedup.covered_windows(rows, sizes, owner, anchor, 8) == whole).all()
    for i, k in itertools.product(range(40), range(13)):
        other = any(owner[x] < owner[i] and rows[x, y : y + 8].tobytes() == rows[i, k : k + 8].tobytes() for x in range(40) for y in range(13))
        assert whole[i, k] == other


def test_suffix_dedup_cases(spark, odd, empty):
    rows = suffix_dedup.remove_repeats(odd.withColumn("kept", F.lit(1)).withColumn("extra", F.lit("x"))).collect()
    assert len(rows) == len(ODD) and {r["extra"] for r in rows} == {"x"}
    by = {r["doc_id"]: r for r in rows}
    assert len(by[7]["kept"]) == 0 and bytes(by[6]["kept"]).decode() == LONG and bytes(by[None]["kept"]) == b"one two three"
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_far_ids(spark):
    text = "a passage that is certainly longer than fifty bytes in all its documents"
    df = spark.createDataFrame([(-(1 << 60), text), ((1 << 60) + 1, "x" + text), ((1 << 60) + 2, text + "y")], SCHEMA)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {-(1 << 60): text, (1 << 60) + 1: "x", (1 << 60) + 2: "y"}


def without_earlier(rows, n=50):
    """(doc_id, kept) of each row, every window looked up among those of smaller ids."""
    least = {}
    for i, t in rows:
        for k in range(len(t) - n + 1):
            least[t[k : k + n]] = min(least.get(t[k : k + n], i), i)
    out = []
    for i, t in rows:
        gone = {k + d for k in range(len(t) - n + 1) if least[t[k : k + n]] < i for d in range(n)}
        out.append((i, "".join(c for k, c in enumerate(t) if k not in gone)))
    return sorted(out)


def test_suffix_dedup_of_hot_passages_repeated_ids_and_bundles_of_one(spark, monkeypatch):
    r = random.Random(11)
    words = lambda n: " ".join("".join(r.choices("abcdef", k=r.randint(2, 6))) for _ in range(n))
    hot, others = words(25), [words(20) for _ in range(6)]
    rows = [(r.choice([i, i, 700 * i - 9_000]), " ".join(r.sample([hot, *others, words(15)], 3) + [hot] * (i % 2))) for i in range(60)]
    rows += [(5, hot), (5, ""), (5, words(4)), (6, others[0] + " " + words(60) + hot), (6, hot + words(3))]
    monkeypatch.setattr(suffix_dedup, "LONG_BYTES", 330)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted((x["doc_id"], bytes(x["kept"]).decode()) for x in got) == without_earlier(rows)


def test_cut_keeps_whole_characters(spark):
    shared = "é" * 30
    df = spark.createDataFrame([(1, "a" + shared + "b"), (2, "ü" + shared[:25] + "zz" + "é" * 3)], SCHEMA)
    rows = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(df, whole_characters=True).collect()}
    assert rows[2] == "üzzééé"


def test_minhash_cases(spark, odd, empty):
    rows = minhash.near_duplicates(odd, 2, 0.8).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[5] == (1, 4, False) and got[7][1] == 6 and got[None][2]
    assert minhash.near_duplicates(empty, 2, 0.8).count() == 0


def test_open_buckets_in_several_blocks(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base if i % 3 else docs[r.randrange(len(docs))][1].split())
        for _ in range(r.randint(1, 7)):
            words[r.randrange(60)] = f"x{r.randrange(1000)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, SCHEMA)
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(59)} for i, t in docs}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    monkeypatch.setattr(minhash, "_BLOCK", 8)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2, 0.8).collect()} == label


def test_repeated_ids_with_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(5, one), (5, two), (5, one), (6, one), (7, two), (8, two + " c")], SCHEMA).withColumn("component_id", F.lit("x"))
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df, 2, 0.8).collect()}
    digests = {t: minhash._digest(s) for t in (one, two) for _, s in minhash.shingle_sets(pa.array([t]), 2)}
    chosen = min(digests, key=digests.get)  # its set stands for document 5
    assert got == ({(5, 5), (6, 5), (7, 7), (8, 7)} if chosen == one else {(5, 5), (6, 6), (7, 5), (8, 5)})


def test_a_large_bucket_sends_few_rows(spark, monkeypatch):
    """One bucket of many copies and a few rows outside: rows grow with the bucket, not with its square."""
    monkeypatch.setattr(minhash, "_BLOCK", 8)
    n = 400
    members = spark.range(n).select(F.lit(9).cast("long").alias("key"), F.lit(0).alias("band"), F.col("id").alias("rep"), F.lit(10).cast("long").alias("n_shingles"))
    signs = spark.range(n).select(F.col("id").alias("rep"), F.array(F.lit(1).cast("long")).alias("bands"), F.lit(b"x").alias("low"))
    component = spark.range(n).where("id >= 8").select(F.col("id").alias("node"), F.lit(8).cast("long").alias("component"))
    blocks = minhash._blocks(members, signs, component)
    assert blocks.count() <= n + 8 * (n // 8) + 8
    met = blocks.where("seeks").select("i", "j", F.col("rep").alias("a")).join(blocks.where("met").select("i", "j", F.col("rep").alias("b")), ["i", "j"])
    assert met.where("a <> b").select("a", "b").distinct().count() == met.where("a <> b").count() == 8 * (n - 1)


def test_join_spread(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1), ("c", 2), ("z", 3)], "k string, v int")
    table = spark.createDataFrame([("a", 10, 20), ("b", 20, 1), ("c", 30, 1), ("d", 40, 0)], "k string, x int, n int")
    for most in (0, 1, 2, 10):
        assert sorted(map(tuple, join_spread(rows, table, "k", "n", most).select("k", "v", "x").collect())) == sorted([("a", i, 10) for i in range(20)] + [("b", 1, 20), ("c", 2, 30)])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, minhash.components(edges).collect()))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert minhash.components(edges.limit(0)).count() == 0


def test_toxicity_cases(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(odd, none).agg(F.max("score")).first()[0] < 0.01 and toxicity.score(empty, none).count() == 0


def test_features_are_whole_and_distinct(monkeypatch):
    texts = ["Ab çd " * 700, None, "", "aaaa", "x"]
    plain = []
    for t in texts:
        b = b" " + t.encode().lower().replace("ç".encode(), "ç".encode()) + b" " if t else b""
        plain.append({toxicity.hash_of(b[i : i + n]) for n in toxicity.SIZES for i in range(len(b) - n + 1)})
    for piece in (1 << 18, 1000):
        monkeypatch.setattr(toxicity, "_PIECE", piece)
        got = [x.tolist() for x in toxicity.grams(pa.array(texts))]
        assert [set(x) for x in got] == plain and all(len(x) == len(set(x)) for x in got)


def test_sample_bounds(spark):
    docs = spark.createDataFrame([(i, ("vile words " if i % 4 == 0 else "kind words ") * 9 + str(i)) for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    texts = docs.limit(0).unionByName(spark.createDataFrame([(1, "vile"), (2, "kind")], SCHEMA))
    for bounds in ({}, {"max_positive": 5, "max_negative": 9}, {"max_entries": 900}):
        got = {r["doc_id"]: r["score"] for r in toxicity.score(texts, toxicity.fit(docs, labels, **bounds)).collect()}
        assert got[1] > got[2], bounds


def test_sample_stays_in_tasks(spark):
    docs = spark.createDataFrame([(i, ("vile words " if i % 4 == 0 else "kind words ") * 9 + str(i)) for i in range(80)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    tracemalloc.start()
    whole = toxicity.fit(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # the driver held 50 million features of three bytes, and the solver's vectors
    dealt = toxicity.fit(docs.repartition(7), labels)
    assert (whole.weights == dealt.weights).all() and whole.intercept == dealt.intercept and np.abs(whole.weights).max() > 0


def test_license_cases(spark, odd, empty):
    more = odd.unionByName(spark.createDataFrame([(20, "Licensed under the Apache License, Version 2.0 -- All Rights\nReserved"), (21, "cc by cc-by CC BY"), (22, "apache license version"), (22, "GNU general public license")], SCHEMA))
    rows = license_scan.scan(more.withColumn("labels", F.lit(1)).withColumn("extra", F.lit(2))).collect()
    assert len(rows) == len(ODD) + 4 and {r["extra"] for r in rows} == {2}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[20][0]["labels"] == "apache-2.0,reserved" and by[20][0]["base_labels"] == "reserved"
    assert by[21][0]["n_base"] == 3 and (by[21][0]["first_word"], by[21][0]["last_word"]) == (0, 4)
    assert sorted(r["labels"] for r in by[22]) == ["", "gpl"] and by[1][0]["n_words"] == 0
    assert license_scan.scan(empty).count() == 0


def test_licenses_of_one_file_do_not_crowd_each_other_out(spark):
    texts = {label: [t for name, t, _ in license_scan.TEMPLATES if name == label] for label, _, _ in license_scan.TEMPLATES}
    prose = "the software and any files of this project are distributed to every person in a form that is free of restriction"
    three = " . ".join([texts["apache-2.0"][0], texts["mit"][1], texts["bsd"][0]])
    # rare words of the Apache notice stand elsewhere; of its aligned words only the key phrase is there
    scattered = "copy obtain apache http www org licenses file may not use it except in compliance with the license"
    rows = [(1, three), (2, " x ".join(t for _, t, _ in license_scan.TEMPLATES)), (3, f"{prose} {three} {prose}"), (4, scattered), (5, "mit license of the software released under it"), (6, prose)]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == got[3] == {"apache-2.0", "mit", "bsd"} and got[2] == set(texts)
    assert got[4] == {"apache-2.0"} and got[5] == {"mit"} and got[6] == {""}


def test_a_whole_licence_with_a_holder_in_it(spark):
    body = [t for name, t, _ in license_scan.TEMPLATES if name == "mit"]
    text = f"Copyright (c) 2020 Someone Else. {body[0]}: {body[1]}. THE SOFTWARE IS PROVIDED AS IS"
    rows = [(1, text), (2, text.replace("free of charge", "for a fee")), (3, text.replace("substantial portions", "some portions").replace("free of charge", "for a fee"))]
    got = {r["doc_id"]: (r["labels"], [m["share"] for m in r["matches"]]) for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == ("mit", [1.0, 1.0]) and got[2] == ("mit", [1.0]) and got[3] == ("", [])


def test_decontamination_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "word0 filler0 word1 filler1 word2 filler2")], "item_id long, text string")
    more = odd.unionByName(spark.createDataFrame([(30, "x ALPHA beta, gamma delta epsilon zeta eta theta iota kappa y"), (31, "alpha beta gamma delta epsilon zeta eta theta other iota kappa")], SCHEMA))
    for most in (50_000, 0):
        got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.contaminated(more, items, most_literals=most).collect()), key=str)
        assert got == sorted([(None, 1), (6, 5), (7, 5), (30, 4)], key=str), most
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0


HTML = """<html><body><header>Site</header><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1>
<p>First <b>bold</b><br>line&nbsp;end<p>Second<aside>related</aside> part<script>var x = "<p>no</p>";</script><form>mail</form>
<ul><li>a<li>b</ul><div class="comments"><p>nice!</p></div></article><footer>foot</footer>"""


def test_html_cases(spark):
    rows = [(1, "http://g/a", HTML), (2, None, None), (3, "http://e/b", ""), (4, "http://h/b", "<p>lone <p>shared line"), (5, "http://h/c", "<div>shared line</div><div>own</div>"), (5, "http://i/c", "plain < text & more"), (6, "http://i/d", "copy"), (7, "http://i/d", "copy")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = sorted((r["page_id"], r["text"]) for r in html_extract.main_text(df).collect())
    assert got[0] == (1, "Title & more\nFirst bold line end\nSecond\npart\na\nb") and got[1] == (2, "") and got[2] == (3, "")
    assert (4, "lone") in got and (5, "own") in got and (5, "plain < text & more") in got
    assert (6, "copy") in got and (7, "copy") in got
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_html_differencing_decides_outside_articles(spark):
    page = "<div>site line</div><main><h2>Menu of all</h2><p>{0} lead</p><article>{0} body. <p>said by all</p></article></main><div>{0} beside</div>"
    rows = [(1, "http://m/a", page.format("one")), (2, "http://m/b", page.format("two")), (3, "http://m/c", page.format("two")), (4, "http://m/d", page.format("two"))]
    rows += [(5, "http://n/a", "<main><p>shared</p><p>own</p></main>"), (6, "http://n/b", "<main><p>shared</p><p>other</p></main>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"{w} lead\n{w} body.\nsaid by all\n{w} beside" for i, w in ((1, "one"), (2, "two"), (3, "two"), (4, "two"))} | {5: "own", 6: "other"}
    for parts in ("1", "3", "6"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want


def test_html_kinds():
    def text(page):
        lines = html_extract.page_lines(page)
        return [t for t, k in lines if k == max(x for _, x in lines)]

    assert text("<main><p>crumb<article><header><h1>T</h1><p>by me</header><p>x<section class='comments'><article class='comment'>c</article></section></article></main>") == ["T", "x"]
    assert text("<div class='content no-sidebar'><p>a</p></div><div class='rightSidebar'>b</div><div id='site-footer'>c</div><div style='display: none'>d</div>") == ["a"]
    assert text("<div class='postHeader'><h1>T</h1></div><div class='header'>site</div><p>x</p><div class='user-comments'>y</div>") == ["T", "x"]
    assert text("<div class=wrapper-form><main><p>kept</main></div>") == ["kept"]


def test_broken_markup_is_read_in_one_pass():
    begun = time.process_time()
    for page in ("<a" * 300_000, '<a x=">" ' * 60_000, "<div>" * 50_000 + "</x>" * 50_000, "<a b='c " * 100_000, "<script></script" * 30_000, "<p class='" + "form-factor " * 50_000 + "'>x", "</" * 100_000 + ">", "<!" * 100_000):
        html_extract.page_lines(page)
    assert time.process_time() - begun < 20
    assert html_extract.page_lines("<p it's>one</p> <b a=\"x>y\">two</b> 3 < 4 <5 a<b c") == [("one", 1), ("two 3 < 4 <5 a<b c", 1)]
    assert html_extract.page_lines("<p>a<p title='never closed>b</p><p>c") == [("a", 1), ("b", 1), ("c", 1)]


def test_names_that_only_contain_a_mark_keep_their_text():
    page = "<article><p>a</p><div class='form-factor'>b</div><div class='legal-history'>c</div><div class='toc-list'>d</div><div class='ad-box'>x</div><div class='share-buttons'>y</div><div class='userForm'>z</div></article>"
    assert [t for t, k in html_extract.page_lines(page) if k] == ["a", "b", "c", "d"]
    page = "<main><p>the story</p><article class='card'>teaser</article><p>goes on</p></main>"
    assert [t for t, k in html_extract.page_lines(page) if k] == ["the story", "teaser", "goes on"]


def _longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    r = random.Random(1)
    for bits in (1 << 27, 20):
        monkeypatch.setattr(html_extract, "_TABLE_BITS", bits)
        for _ in range(150):
            a, b = ([r.randrange(r.choice((2, 6, 40))) for _ in range(r.randrange(30))] for _ in "ab")
            found, rest = html_extract.shared_lines(a, b), iter(b)
            assert len(found) == _longest(a, b) and found == sorted(set(found)) and all(any(y == a[i] for y in rest) for i in found)
    frequent = [0, 1] * 200
    assert len(html_extract.shared_lines(frequent, frequent[1:])) == 399


def test_differencing_against_plain_pairs(spark):
    """Pages without any marked element: each is paired with the nearest different one of its host, and loses a longest common subsequence."""
    r = random.Random(6)
    rows = [(i, f"http://{r.choice('gh')}.example/{r.choice(['a', 'ab', 'b'])}/{r.randrange(40)}", [f"line {r.randrange(7)}" for _ in range(r.randrange(9))]) for i in range(90)]
    df = spark.createDataFrame([(i, u, "".join(f"<p>{x}</p>" for x in lines)) for i, u, lines in rows], "page_id long, url string, html string").coalesce(1)
    got = {x["page_id"]: x["text"].split("\n") if x["text"] else [] for x in html_extract.main_text(df).collect()}
    place = lambda u: (u.split("/")[2], u.split("/", 3)[3])
    ordered = sorted(rows, key=lambda x: (*place(x[1]), x[0]))
    for n, (i, u, lines) in enumerate(ordered):
        other = lambda x, u=u, lines=lines: place(x[1])[0] == place(u)[0] and x[2] != lines
        before, after = next(filter(other, ordered[:n][::-1]), None), next(filter(other, ordered[n + 1 :]), None)
        shared = lambda x, u=u: len(os.path.commonprefix([place(x[1])[1], place(u)[1]]))
        near = max((x for x in (before, after) if x), key=shared, default=None)
        assert len(lines) - len(got[i]) == (_longest(lines, near[2]) if near else 0), i
        rest = iter(lines)
        assert all(x in rest for x in got[i])


def test_alignment_does_not_hang_on_partitions(spark):
    r = random.Random(3)
    rows = [(i, "h" if i % 3 else "g", f"/{r.randrange(30)}", [r.randrange(4) for _ in range(r.randrange(6))]) for i in range(80)]
    df = spark.createDataFrame(rows, "rid long, host string, path string, hashes array<bigint>")
    results = []
    for parts in ("1", "3", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(tuple, html_extract.shared_with_nearest(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2] and len(results[0]) == 80


def _repaired(spark, rows, **conf):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat_format.repair(df)


def test_chat_repairs(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "x"), (3, 0, None, None), (None, 0, "Human", "h"), (None, 1, "GPT", "g"), (4, 0, "system", "s"), (4, 0, "system", "s"), (4, None, "user", "n")]
    got = _repaired(spark, rows).collect()
    assert len(got) == len(rows)
    text = {}
    for r in got:
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["rendered"]
    one = text[1]
    assert one == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert text[None] == "<|im_start|>user\nh<|im_end|>\n<|im_start|>assistant\ng<|im_end|>\n"
    assert all(t.count("<|im_start|>") == t.count("<|im_end|>") and t.rstrip().endswith("<|im_end|>") for t in text.values())
    assert _repaired(spark, []).count() == 0


def test_chat_cost_is_least():
    r = random.Random(1)
    for _ in range(80):
        roles = [r.randrange(4) for _ in range(r.randint(1, 5))]
        price = lambda p, roles=roles: sum(chat_format.STEPS[x][s][t][0] for x, s, t in zip(roles, p[:-1], p[1:], strict=True)) + chat_format.END_COSTS[p[-1]]
        best = min((price((0, *q)), q) for q in itertools.product(range(4), repeat=len(roles)))  # of equal costs the lowest states, the first turn first
        assert (price((0, *chat_format.solve(roles))), tuple(chat_format.solve(roles))) == best


def test_chat_edge_cases(spark):
    rows = [("None", 1, "user", "a"), (None, 1, "assistant", "b"), ("x", 1, "user", "long " * 400_000), ("x", 2, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("rendered", F.lit("clash")).withColumn("n", F.lit(1))
    for parts in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r["conv_id"], r["turn"]): r["rendered"] for r in chat_format.repair(df).collect()}
        assert got["None", 1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
        assert got[None, 1] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
        assert got["x", 1].startswith("<|im_start|>user\nlong ") and got["x", 2] == "<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_conversation_over_partitions(spark):
    r = random.Random(2)
    rows = [(7 if i % 2 else i, i, r.choice(["user", "assistant", "system", "odd"]), str(i)) for i in range(300)]
    results = []
    for parts in ("1", "5", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted((tuple(x) for x in _repaired(spark, rows).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]
    one = [x for x in results[0] if x[0] == 7]
    turns = [chat_format.role_of(x[2]) for x in sorted(one, key=lambda x: x[1])]
    assert [x[3] for x in sorted(one, key=lambda x: x[1])] == [chat_format.NAMES[s] for s in chat_format.solve(turns)]


def test_language_cases(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog are here with the others" if i % 2 else "der hund und die katze sind hier mit den anderen", "en" if i % 2 else "de") for i in range(40)] + [(None, None, None)], "doc_id long, text string, lang string")
    pages = [(i, f"http://a.example.{'de' if i % 2 else 'com'}/{i}", f"<html lang=\"{'de' if i % 2 else 'en'}\"><p>{'der hund und die katze sind mit den anderen hier' if i % 2 else 'the dog and the cat are with the others'}") for i in range(30)]
    pages += [(50, "http://b.example.de/1", "<html><p>"), (51, None, None), (51, "nonsense", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = lang_id.identify(df, docs).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r["lang"] for r in got}
    assert all(by[i] == ("de" if i % 2 else "en") for i in range(30)) and by[50] == "de"
    assert {r["lang"] for r in lang_id.identify(df, docs.limit(0)).collect()} == {None} and lang_id.identify(df.limit(0), docs).count() == 0


def test_posteriors_against_a_plain_fusion(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(r.choice({"en": ["the", "and", "with"], "de": ["der", "und", "mit"], "xx": ["q", "zz", "und"]}[x]) for _ in range(12)), x) for i, x in enumerate(["en", "de", "xx"] * 8)], "doc_id long, text string, lang string")
    texts = ["the and with the", "der und mit der", "", "q zz und", "und und", "the mit q"]
    pages = [(i % 50, f"http://{r.choice('abc')}.{r.choice(['de', 'com'])}/{i}" if i % 9 else None, f"<html{r.choice([' lang=de', ' lang=en', ' lang=ru', ''])}><p>{r.choice(texts)}" if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    langs, model = lang_id.fit(docs)
    rows = lang_id.evidence(df, langs, model, "page_id", "url", "html", 0.05).collect()
    post = np.array([x["post"] for x in rows])
    of = lambda c: {k: sum(p for p, x in zip(post, rows, strict=True) if x[c] == k) for k in {x[c] for x in rows}}
    host, suffix, declared = of("host"), of("suffix"), of("declared")
    declared.pop(None)
    whole = (post.sum(0) + 1) / (post.sum() + len(langs))
    want = []
    for p, x in zip(post, rows, strict=True):
        s = (suffix[x["suffix"]] - p + 20 * whole) / ((suffix[x["suffix"]] - p).sum() + 20)
        z = np.array(x["ll"]) + np.log((np.maximum(host[x["host"]] - p, 0) + 5 * s) / (np.maximum(host[x["host"]] - p, 0).sum() + 5))
        if x["declared"]:
            z += np.log((np.maximum(declared[x["declared"]] - p, 0) + 0.5) / (np.maximum(sum(declared.values()) - p, 0) + 0.5 * (len(declared) + 1)))
        e = np.exp(z - z.max())
        want.append((x["page_id"], x["host"], tuple(np.round(e / e.sum(), 9))))
    got = [(x["page_id"], x["host"], tuple(np.round(x["posterior"], 9))) for x in lang_id.identify(df, docs).collect()]
    assert sorted(got) == sorted(want)


def test_rare_languages_are_in_the_sample(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(300)] + [(300, "der hund und die katze", "de"), (301, "le chat et le chien", "fr")]
    langs, model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=10)
    assert langs == ["de", "en", "fr"] and model.shape[0] == 3


def _texture(v):
    return np.clip(128 + 55 * (v @ media._waves(96, 64)) / np.linalg.norm(v), 0, 255).round().reshape(96, 96).astype(np.uint8)


def test_media_finds_edited_copies(spark):
    rng = np.random.default_rng(11)
    a, b = _texture(rng.normal(size=64)), _texture(rng.normal(size=64))
    crop = np.clip(a[9:90, 12:93] * 0.8 + 15, 0, 255).astype(np.uint8)
    noisy = np.clip(b + rng.normal(0, 2, b.shape), 0, 255).astype(np.uint8)
    rows = [(1, media.write_pgm(a)), (2, media.write_pgm(b)), (3, media.write_pgm(crop)), (4, media.write_pgm(noisy)), (5, media.write_pgm(a)), (6, None), (7, b"junk"), (8, media.write_pgm(_texture(rng.normal(size=64)))), (8, None)]
    df = spark.createDataFrame(rows, "image_id long, image binary")
    got = {r["image_id"]: r["class_id"] for r in media.copies(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1, 6: 6, 7: 7, 8: 8}
    assert media.copies(df.limit(0)).count() == 0


def _resized(x, f):
    for axis in (0, 1):
        at = np.clip((np.arange(int(x.shape[axis] * f)) + 0.5) / f - 0.5, 0, x.shape[axis] - 1.001)
        low, part = at.astype(int), at % 1
        part = part[:, None] if axis == 0 else part
        x = np.take(x, low, axis) * (1 - part) + np.take(x, low + 1, axis) * part
    return x


def test_media_recall_of_edits(spark):
    """Edits of several strengths of larger images: copy e of image i has the id 100 (e + 1) + i."""
    rng = np.random.default_rng(3)
    n = 8
    images = [np.clip(128 + 55 * (v @ media._waves(128, 64)) / np.linalg.norm(v), 0, 255).reshape(128, 128) for v in rng.normal(size=(n, 64))]
    edits = [lambda x: x + rng.normal(0, 10, x.shape), lambda x: media._blur(media._blur(media._blur(x))), lambda x: x[20:84, 50:114], lambda x: _resized(x, 0.75), lambda x: np.rot90(x)]
    rows = [(i, x) for i, x in enumerate(images)] + [(100 * (e + 1) + i, f(x)) for e, f in enumerate(edits) for i, x in enumerate(images)]
    df = spark.createDataFrame([(i, media.write_pgm(np.clip(x, 0, 255).round())) for i, x in rows], "image_id long, image binary")
    got = {r["image_id"]: r["class_id"] for r in media.copies(df).collect()}
    assert all(got[i] == i for i in range(n))
    for e in range(len(edits)):
        assert sum(got[100 * (e + 1) + i] == i for i in range(n)) >= n - 1, e


def test_media_copies_behind_an_unrelated_head(spark, monkeypatch):
    """Image 1 has the descriptors of 2 and 3 at other places and heads all their buckets; 3 is 2, shifted."""
    rng = np.random.default_rng(17)
    bits, at = rng.integers(-(1 << 60), 1 << 60, (12, 4)), rng.integers(10, 200, (12, 2))
    places = {1: rng.permutation(at[:, ::-1] * 3 % 211), 2: at, 3: at + (20, 7)}
    rows = [(i, bytes([i]), 220, [(int(x), int(y), 0, 0, *map(int, d)) for (x, y), d in zip(p, bits, strict=True)], [[int(d[0]) % 1_000_003 for d in bits]] * 8) for i, p in places.items()]
    corner = "struct<x:int,y:int,scale:int,turn:int,d0:bigint,d1:bigint,d2:bigint,d3:bigint>"
    described = spark.createDataFrame(rows, f"image_id long, digest binary, side int, corners array<{corner}>, keys array<array<int>>")
    monkeypatch.setattr(media, "describe", lambda *_: described)
    for block in (1024, 1):
        monkeypatch.setattr(media, "_BLOCK", block, raising=False)
        got = {r["image_id"]: (r["class_id"], r["n_links"]) for r in media.copies(described).collect()}
        assert got == {1: (1, 0), 2: (2, 1), 3: (2, 1)}


def test_media_writes_no_row_a_mark(spark, monkeypatch):
    """Of corners that share buckets only pairs of images with enough of them are written, one row each."""
    rng = np.random.default_rng(23)
    images = [_texture(v) for v in rng.normal(size=(6, 64))]
    images.append(np.clip(images[0] + rng.normal(0, 2, images[0].shape), 0, 255).astype(np.uint8))
    df = spark.createDataFrame([(i, media.write_pgm(x)) for i, x in enumerate(images)], "image_id long, image binary")
    rows, real = [], media.materialize
    monkeypatch.setattr(media, "materialize", lambda df, label: rows.append(real(df, label)) or rows[-1])
    got = {r["image_id"]: (r["n_corners"], r["class_id"], r["n_links"]) for r in media.copies(df).collect()}
    assert [got[i][1] for i in range(7)] == [0, 1, 2, 3, 4, 5, 0] and got[6][2] == 1
    assert sum(t.count() for t in rows) < sum(n for n, _, _ in got.values())


def _copied(rng, groups, others):
    """Textures with groups of edited copies of some of them."""
    images = [_texture(v) for v in rng.normal(size=(others + len(groups), 64))]
    return images + [np.clip(images[g] + rng.normal(0, 3, images[g].shape), 0, 255).astype(np.uint8) for g, n in enumerate(groups) for _ in range(n)]


def _plain_links(images):
    """All pairs, one after the other."""
    out = set()
    each = [media.corners(x) for x in images]
    for a, b in itertools.combinations(range(len(images)), 2):
        (p, x), (q, y) = each[a], each[b]
        meet = np.any([(x[:, None, part] == y[None, :, part]).all(2) for part in media._PARTS], axis=0)
        n, m = np.nonzero(meet & ((x[:, None] != y[None]).sum(2) <= media.DIFFERING))
        if len(n):
            sides = [dict(zip(("x", "y", "scale", "turn"), r.T, strict=True)) for r in (p[n], q[m])]
            if media._agree(np.zeros(len(n), int), np.full(len(n), max(images[a].shape)), *sides, media.LEAST, 1)[0]:
                out.add((a, b))
    return out


def test_media_links_are_all_pairs_of_copies(spark, monkeypatch):
    """Members of a group of copies count one another, not only the one that leads them; the same with blocks of any size."""
    images = _copied(np.random.default_rng(29), [3, 2, 1], 4)
    images.append(images[0])  # equal pixels count as one image
    links = _plain_links(images[:-1])
    degree = [sum(i in x for x in links) for i in range(len(images) - 1)]
    assert degree[7:10] == [3, 3, 3]
    df = spark.createDataFrame([(f"i{i:02d}", media.write_pgm(x)) for i, x in enumerate(images)], "image_id string, image binary")
    for block in (2048, 3, 1):
        monkeypatch.setattr(media, "_BLOCK", block)
        got = {r["image_id"]: r["n_links"] for r in media.copies(df).collect()}
        assert [got[f"i{i:02d}"] for i in range(len(images))] == [*degree, degree[0]]


def test_media_meets_without_a_shuffle(spark, monkeypatch):
    """Pairs of blocks are read where they are stored: neither corners that meet nor pairs of images are dealt anew, so disk follows the images."""
    images = _copied(np.random.default_rng(31), [2], 3)
    df = spark.createDataFrame([(i, media.write_pgm(x)) for i, x in enumerate(images)], "image_id long, image binary")
    plans, real = {}, media.materialize
    monkeypatch.setattr(media, "materialize", lambda df, label: plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    media.copies(df).collect()
    assert all("CartesianProduct" in x and "Exchange" not in x for x in plans["links"])
    assert "pairs" not in plans


def test_media_meets_in_slices(monkeypatch):
    """Corners of equal keys, some of which meet thousands of others, in slices of a few."""
    rng = np.random.default_rng(37)
    few = rng.integers(0, 1 << 60, (5, 4))

    def block(sizes):
        made = np.zeros(sum(sizes), media._CORNER)
        made["x"], made["y"] = rng.integers(0, 60, (2, len(made)))
        made["d"] = few[rng.choice(5, len(made), p=[0.6, 0.1, 0.1, 0.1, 0.1])]
        return media._Block(pa.array(range(len(sizes))), np.full(len(sizes), 64), np.array(sizes), made)

    one, two = block([30, 1, 0, 12, 25]), block([9, 40, 0, 7])
    for other in (one, two):
        want = {(n, m) for n in range(len(one.corners)) for m in range(len(other.corners)) if (one.corners["d"][n] == other.corners["d"][m]).all()}
        want = {(n, m) for n, m in want if other is two or one.image[n] < one.image[m]}
        many = Counter((one.image[n], other.image[m]) for n, m in want)
        want = {(n, m) for n, m in want if media.TABLES * many[one.image[n], other.image[m]] >= 50}
        for most in (1 << 20, 2000, 10):
            monkeypatch.setattr(media, "_MET", most)
            met = [(int(n), int(m)) for x in media._meeting(one, other, 50) for n, m in zip(*x, strict=True)]
            assert len(met) == len(set(met)) and set(met) == want


def test_png_decoding():
    import struct
    import zlib

    pixels = np.arange(48, dtype=np.uint8).reshape(6, 8)
    raw = b"".join(bytes([1, *(np.diff(row.astype(int), prepend=0) & 255).tolist()]) for row in pixels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0" * 4
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (media.decode(png) == pixels).all() and (media.decode(media.write_pgm(pixels)) == pixels).all()


def test_shingle_sets_are_whole():
    column = pa.array(["A b  c", None, "", "b C", "x" * 70 + " y"])
    got = {k: len(s) for k, s in minhash.shingle_sets(column, 2)}
    assert got == {0: 2, 3: 1, 4: 1}
    sets = {k: set(s.tolist()) for k, s in minhash.shingle_sets(column, 2)}
    assert sets[3] < sets[0]
