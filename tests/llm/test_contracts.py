"""Every contract query against a brute-force version over a whole small table."""

import hashlib
import re
import sys
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import same  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from loomgrid.llm import lang_id, queries  # noqa: E402
from loomgrid.llm.common import table  # noqa: E402

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, sf_dir, "documents").collect()]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_suffix_dedup(spark, sf_dir, texts):
    first = {}
    for i, t in sorted(texts):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = {}
    for i, t in texts:
        b = t.encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                mark[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        want[i] = (len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    assert by_id(queries.op2_suffix_dedup(spark, sf_dir)) == want


def test_bpe(spark, sf_dir, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts:
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert by_id(queries.op4_bpe(spark, sf_dir)) == want


def test_minhash(spark, sf_dir, texts):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(LOWER))
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert by_id(queries.op5_minhash(spark, sf_dir)) == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_license_scan_base(spark, sf_dir, texts):
    phrases = [((b"cc", b"by"), "cc-by"), ((b"general", b"public", b"license"), "gpl"), ((b"all", b"rights", b"reserved"), "reserved")]
    got = {r["doc_id"]: r for r in queries.op7_license_scan(spark, sf_dir).collect()}
    for i, t in texts:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().translate(LOWER))
        starts = [(k, name) for p, name in phrases for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        places, names = [k for k, _ in starts], sorted({n for _, n in starts})
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(starts), min(places, default=None), max(places, default=None), ",".join(names))
        assert set(names) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert len(got) == len(texts)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    same(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    rows = [r for r in queries.op6_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    found = [r["doc_id"] for r in rows if r["predicted"]]
    toxic = [r["doc_id"] for r in rows if truth[r["doc_id"]] == 1]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    hit = len(set(found) & set(toxic))
    assert hit / len(found) > 0.9 and hit / len(toxic) > 0.75


def test_html_is_the_article(spark, sf_dir):
    import html

    pages = {r["page_id"]: r for r in table(spark, sf_dir, "pages").collect()}
    got = {r["page_id"]: r for r in queries.op9_html_extraction(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        inner = re.search(r"<article>(.*)</article>", page["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert re.sub(r"\s+", "", got[i]["text"]) == re.sub(r"\s+", "", "".join(blocks)), i
        assert got[i]["text"].split("\n")[0] == next(filter(None, blocks))
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_language_of_pages(spark, sf_dir):
    """The language is told by the path, which is no input of the posterior; the declared one is taken away, or replaced on a third of the pages."""
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    truth = {r["page_id"]: re.search("//[^/]*/(..)/", r["url"])[1] for r in pages.collect()}
    removed = pages.withColumn("html", F.regexp_replace("html", ' lang="..\"', ""))
    false = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", ' lang="..\"', ' lang="de"')).otherwise(F.col("html")))
    for df, least in ((pages, 0.97), (removed, 0.95), (false, 0.95)):
        got = {r["page_id"]: r["lang"] for r in lang_id.identify(df, docs).collect()}
        assert set(got) == set(truth)
        assert sum(got[i] == x for i, x in truth.items()) >= least * len(truth)


def test_media_and_chat_cover_their_tables(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").count()
    assert queries.op3_media_copies(spark, sf_dir).select("vec_id").distinct().count() == vectors
    turns = table(spark, sf_dir, "conversations")
    assert queries.op10_chat_format(spark, sf_dir).count() == turns.count()
