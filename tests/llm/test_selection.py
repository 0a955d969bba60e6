"""Importance resampling, hard negatives and line dedup against plain versions, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import importance, line_dedup, negatives

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"
LONG = "\n".join(f"word{i % 977} of a rather long line, filler{i % 31}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three"), (None, "one"), (6, LONG), (7, LONG), (8, "ÄÖ 日本 🙂 \x00 end"), (9, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_resample(docs, target, share, least, buckets, longest):
    def bag(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bags, s, t = [bag(x) for _, x in docs], Counter(), Counter()
    for _, b in bags:
        s.update(b)
    for x in target:
        t.update(bag(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n + buckets) / ((s[b] + 1.0) * (m + buckets))))
    rows = []
    for (i, _), (words, b) in zip(docs, bags, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, b))
        rows.append([i, words, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: share * len(fit) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 50)])
def test_importance_matches_plain(spark, odd, longest, buckets):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["Alpha", "beta", "gamma9", "délta", "--"]) for _ in range(r.randint(0, 40)))) for i in range(80)] + ODD[:5] + ODD[7:]
    target = ["alpha gamma9 alpha", None, "", "beta délta"]
    frame = spark.createDataFrame(docs, SCHEMA).withColumns({"weight": F.lit("x"), "rank": F.lit(1), "place": F.lit(2)}).repartition(7)
    got = importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), 30, 10, buckets=buckets, longest=longest)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target, 30, 10, buckets, longest)


def test_importance_of_nothing(spark, odd, empty):
    assert importance.resample(empty, odd).count() == 0
    rows = importance.resample(odd, empty, least_words=1, share=100).collect()
    assert len(rows) == len(ODD)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, sum(r["n_features"] > 0 for r in rows) + 1))


def test_crc_of_words():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    start = r.integers(0, 4000, 300)
    end = start + np.r_[r.integers(0, 64, 290), r.integers(65, 900, 10)]
    before = r.integers(0, 2**32, 300, dtype=np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before, strict=True)]
    assert importance.crc32(data, start, end, before).tolist() == want


def plain_lines(docs, least_chars, least_docs):
    key = lambda line: line.translate(LOWER).strip(b" \t\n\x0b\x0c\r")
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").encode().split(b"\n"):
            if len(key(line).decode()) >= least_chars:
                held[key(line)].add(-1 if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < least_docs or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((i, b"\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fan", [(1, 3), (4, 3), (7, 2)])
def test_line_dedup_matches_plain(spark, batches, fan):
    r = random.Random(batches)
    pool = [f"a line of some length, number {k}" for k in range(30)] + ["short", "", "ä" * 19, "ä" * 20, "A LINE OF SOME LENGTH, NUMBER 3 ", "\tx" * 12 + "\r"]
    docs = [(r.choice([None, r.randint(0, 60)]) if r.random() < 0.1 else i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(70)] + ODD
    frame = spark.createDataFrame(docs, SCHEMA).withColumns({"key": F.lit(1), "keys": F.lit(2), "batch": F.lit("b")})
    got = line_dedup.drop_repeated_lines(frame, 20, 3, batches, fan)
    assert sorted(((a, bytes(b), c, d) for a, b, c, d in got.collect()), key=repr) == plain_lines(docs, 20, 3)


def test_lines_of_nothing(empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_runs_in_any_order(spark):
    """Counts and last documents are those of all batches; settled keys aren't written again, and levels hold fewer runs than the fan."""
    r = random.Random(3)
    pairs = sorted({(d, b"k%d" % k) for d in range(60) for k in r.sample(range(40), 9)})
    held = defaultdict(set)
    for d, k in pairs:
        held[k].add(d)
    for order in (range(5, -1, -1), range(6), [2, 5, 0, 4, 1, 3]):
        runs = line_dedup.Runs(spark, enough=3, fan=2)
        for b in order:
            runs.add(spark.createDataFrame([p for p in pairs if p[0] // 10 == b], "doc_id long, key binary"))
            assert all(len(level) < 2 for level in runs.levels)
        assert {bytes(x["key"]): x["last"] for x in runs.settled().collect()} == {k: max(v) for k, v in held.items() if len(v) >= 3}
        if order[0] == 5 and order[1] == 4:  # falling: what the first batches settled isn't added again
            assert sum(x.count() for x in runs.runs()) <= len(held) * len(runs.runs())
            assert sum(x.agg(F.sum("docs")).first()[0] or 0 for x in runs.runs()) < len(pairs) / 2
    plan = runs.runs()[0].join(runs.runs()[-1].withColumnRenamed("docs", "d2"), "key")._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan


def plain_negatives(rows, anchor, scale, k, m, low, high):
    v = [(i, label, [math.floor(scale * x) for x in e], n) for n, (i, label, e) in enumerate(rows) if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, label, e, n in v:
        if i is None or not anchor(i):
            continue
        s = [(-sum(map(lambda x, y: x * y, e, f)), (1 << 63) - 1 if j is None else j, g) for j, g, f, o in v if o != n]
        for ps, p, _ in sorted(x for x in s if x[2] == label)[:k]:
            fit = sorted(x for x in s if x[2] != label and low * -ps <= 100 * -x[0] <= high * -ps)[:m]
            out += [(i, p, r + 1, j, -ps, -ns) for r, (ns, j, _) in enumerate(fit)]
    return sorted(out)


def test_negatives_match_plain(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 64)
    monkeypatch.setattr(negatives, "BLOCK", 8)
    r = random.Random(4)
    rows = [(i, i % 3, [r.gauss(1, 1) * (1 + i % 5) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, 1, [1.0, 2.0, 0.5, 0.0, 1.0, 1.0]) for i in range(40)] + [(500, 2, [3.0, 1.0, 2.0]), (501, None, [1.0] * 6), (502, 1, None), (503, 1, [1.0, None]), (504, 0, [float("nan")] * 6), (510, 0, [float("inf")]), (520, 2, []), (530, 1, [-1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"norm": F.lit("x"), "place": F.lit(1), "kth": F.lit(2)}).repartition(5)
    got = negatives.mine(frame, F.col("vec_id") % 10 == 0, 16, 3, 4, 30, 90)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0, 16, 3, 4, 30, 90)


def test_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [2.0])], "vec_id long, label int, embedding array<float>"), F.lit(True)).count() == 0


def test_scan_skips_short_rows():
    """Norms that fall fast: few pairs are scored, and the same rows are found as with all in one bucket."""
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(4096, 8)) * 300 / (1 + np.arange(4096))[:, None] ** 0.5)
    norm = np.sqrt((x * x).sum(1))
    x, norm = x[np.argsort(-norm)], np.sort(norm)[::-1]
    place = np.arange(4096)
    rows = {"x": x, "norm": norm, "label": place % 2, "place": place, "vec_id": place[::-1].copy()}
    a = {"x": x[:50], "norm": norm[:50], "label": place[:50] % 2, "place": place[:50], **{n: np.full((50, 1), v) for n, v in (("low", -negatives.NONE), ("high", negatives.NONE), ("kth", -negatives.NONE))}}
    found, scored = negatives.scan(a, rows, 5, True, bucket=64)
    whole, every = negatives.scan(a, rows, 5, True, bucket=4096)
    assert scored < every / 4
    assert [v.tolist() for v in found] == [v.tolist() for v in whole]
