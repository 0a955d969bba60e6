"""The pipeline against plain versions of its stages, each on the rows its predecessor kept."""

import base64
import re
import sys
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from loomgrid.llm import toxicity  # noqa: E402
from loomgrid.llm.common import table  # noqa: E402

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(words, width):
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def without_near_duplicates(docs):
    sets = {i: shingles(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)), 5) for i, t in docs.items()}
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
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: t for i, t in docs.items() if root(i) == i}


def without_repeats(docs):
    first, out = {}, {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in docs.items():
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                mark[p : p + 50] = b"\1" * 50
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not all(mark[at : at + n]):
                kept.append(c)
            at += n
        out[i] = t if t is None else "".join(kept)
    return out


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def without_leaks(docs, items):
    sets = [shingles(words(t), 5) for t in items if words(t)]
    return {i: t for i, t in docs.items() if not any(5 * len(s & shingles(words(t), 5)) >= 4 * len(s) for s in sets)}


def test_pipeline(spark, sf_dir):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    source = table(spark, sf_dir, "documents")
    model = toxicity.fit(source.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    docs = {r["doc_id"]: r["text"] for r in toxicity.score(source.select("doc_id", "text"), model).where("score < 0.3").collect()}
    docs = without_leaks(without_repeats(without_near_duplicates(docs)), [r["text"] for r in table(spark, sf_dir, "benchmark").collect()])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert got[i]["ids"] == enc.encode_ordinary(t or "") and got[i]["round_trip"], i


def test_stages_keep_the_columns_and_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words only here", "en", "s", 21), (3, "plain words only here", "en", "s", 21)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2, 3, 3]
