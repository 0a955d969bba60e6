"""Language of pages by Bayesian evidence fusion.

The log posterior of a page's languages adds
- the likelihood of its text under byte n-gram models, tempered, since neighbouring n-grams repeat
  the same evidence;
- the likelihood of the language its markup declares, by a confusion table;
- the prior of its host, smoothed towards that of its address suffix, smoothed towards the whole:
  (count + k * parent) / (total + k) at each level, without the page's own share.
The tables are grouped sums of the text's posteriors over all pages, pre-aggregated before they are
shuffled. The most frequent hosts and suffixes are sent to the tasks, all others are joined by shuffle,
so a frequent one is no large group. Sums and posteriors are arrays, however many languages there are.

The languages are those of all labelled texts. Their n-gram models are fitted on about ``train_rows``
texts, shared evenly among the languages, of each those of the smallest hash of their id. Pages without
text are decided by the rest; null urls share one nameless host, null html declares nothing and has no
text. Very long pages count whole. Repeated pages and page_ids, and null ones, are rows of their own. Ties
go to the language first by name. Without labelled texts every language is null; an empty table gives no
rows. Columns other than id, url and html, whatever their names, are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import ascii_lower, join_spread, materialize, slices, text_buffer
from loomgrid.llm.html_extract import BOILERPLATE, page_lines

SIZES, BITS = (1, 2, 3, 4), 16
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)
_SUFFIX = r"([^.]*)$"
_META = re.compile(r"<meta\b[^>]*content-language[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram within a text."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = ascii_lower(data)
    word = np.ndarray((n,), "<u8", padded, strides=(1,))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    out = []
    for size, odd in zip(SIZES, _ODD, strict=True):
        at = np.flatnonzero(left >= size)
        h = ((word[at] & np.uint64((1 << 8 * size) - 1)) * np.uint64(odd)) >> np.uint64(64 - BITS)
        out.append((owner[at], h.astype(np.int64)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def fit(docs: DataFrame, train_rows: int = 6_000, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each feature by language)."""
    labelled = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    counts = sorted(map(tuple, labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda r: (r[1], r[0]))
    if not counts:
        return [], np.zeros((0, 1 << BITS))
    # rare languages give all their texts, the others share the rest evenly; each gives one at least
    quotas, left = [], train_rows
    for k, (lang, n) in enumerate(counts):
        quotas.append((lang, max(1, min(n, left // (len(counts) - k)))))
        left -= quotas[-1][1]
    top = max(q for _, q in quotas)
    # the first of a language are among the first of its parts; so many parts that neither rank reads many rows in a task
    parts = max(int((n / top) ** 0.5) for _, n in counts) + 1
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = labelled.withColumn("part", F.spark_partition_id() % parts).withColumn("rank", rank("lang", "part")).where(F.col("rank") <= top)
    most = docs.sparkSession.createDataFrame(quotas, "lang string, quota long")
    ids = first.withColumn("rank", rank("lang")).where(F.col("rank") <= top).join(F.broadcast(most), "lang").where("rank <= quota").select("doc_id").distinct()
    rows = docs.join(F.broadcast(ids), "doc_id").where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            names, code = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            data, offsets = text_buffer(b.column(1))
            for i, j in slices(offsets):
                owner, feature = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in np.unique(code[i:j]):
                    part = feature[code[i:j][owner] == k]
                    held[str(names[k])] = held.get(str(names[k]), 0) + np.bincount(part, minlength=1 << BITS)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.astype(np.int64).tobytes() for x in held.values()], pa.binary())], names=["lang", "counts"])

    def total(key: tuple, group: pa.Table) -> pa.Table:
        both = sum(np.frombuffer(x, np.int64) for x in group["counts"].to_pylist())
        return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([both.tobytes()], pa.binary())})

    sums = rows.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(total, "lang string, counts binary").collect()
    sums.sort(key=lambda r: r["lang"])
    if not sums:
        return [], np.zeros((0, 1 << BITS))
    counts = np.stack([np.frombuffer(r["counts"], np.int64) for r in sums]) + alpha
    return [r["lang"] for r in sums], np.log(counts / counts.sum(1, keepdims=True))


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray, page_id: str, url: str, body: str, temper: float) -> DataFrame:
    """(page_id, host, suffix, declared, ll, post): ll are the tempered log likelihoods of the text by language, post their shares."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            bodies = b.column(1).to_pylist()
            text = pa.array(["\n".join(t for t, k in page_lines(p or "") if k != BOILERPLATE) for p in bodies], pa.string())
            declared = [(x[1].lower() if (x := _DECLARED.search(p or "") or _META.search(p or "")) else None) for p in bodies]
            ll = np.zeros((len(bodies), len(langs)))
            data, offsets = text_buffer(text)
            for i, j in slices(offsets):
                owner, feature = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(len(langs)):
                    ll[i:j, k] = np.bincount(owner, m[k][feature], j - i)
            ll *= temper
            post = np.exp(ll - ll.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(declared, pa.string()), *(pa.array(x.tolist(), pa.list_(pa.float64())) for x in (ll, post))], names=["page", "declared", "ll", "post"])

    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    kind = dict(pages.dtypes)[page_id]
    read = pages.select(F.struct(F.col(f"`{page_id}`").alias("page_id"), host.alias("host")).alias("page"), F.col(f"`{body}`").alias("html"))
    out = read.mapInArrow(run, f"page struct<page_id:{kind},host:string>, declared string, ll array<double>, post array<double>")
    return out.select(F.col("page.page_id").alias("page_id"), F.col("page.host").alias("host"), F.regexp_extract("page.host", _SUFFIX, 1).alias("suffix"), "declared", "ll", "post")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _softmax(x: Column) -> Column:
    raised = _let(F.struct(x.alias("x"), F.array_max(x).alias("m")), lambda s: F.transform(s["x"], lambda v: F.exp(v - s["m"])))
    return _let(raised, lambda e: _let(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("t")), lambda s: F.transform(s["e"], lambda v: v / s["t"])))


def _sums(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, weight): sums of the posteriors by language, and the number of rows."""
    each = rows.select(key, F.posexplode("post").alias("k", "x")).groupBy(key, "k").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias(name), F.max("n").alias("weight"))


def _smoothed(sums: Column, own: Column, parent: Column, weight: float) -> Column:
    """(sums - own + weight * parent) / (total of sums - own + weight), by language."""
    rest = F.zip_with(sums, own, lambda s, p: F.greatest(s - p, F.lit(0.0)))
    bound = _let(F.struct(rest.alias("r"), F.aggregate(rest, F.lit(0.0), lambda a, y: a + y).alias("t")), lambda s: F.zip_with(s["r"], parent, lambda r, q: (r + weight * q) / (s["t"] + weight)))
    return bound


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", temper: float = 0.05, host_weight: float = 5.0, suffix_weight: float = 20.0, train_rows: int = 6_000) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host, posterior): lang is the likeliest language; ties go to the first by name."""
    langs, model = fit(docs, train_rows)
    n = len(langs)
    if not n:
        host = F.lit(None).cast("string")
        return pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("lang"), F.lit(0.0).alias("confidence"), host.alias("text_lang"), host.alias("declared"), host.alias("host"), F.array().cast("array<double>").alias("posterior"))
    rows = materialize(evidence(pages, langs, model, page_id, url, body, temper), "evidence")
    by_host = materialize(_sums(rows, "host", "of_host").withColumn("suffix", F.regexp_extract("host", _SUFFIX, 1)), "hosts")
    of_suffix = by_host.select("suffix", F.posexplode("of_host").alias("k", "x"), "weight").groupBy("suffix", "k").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    by_suffix = materialize(of_suffix.groupBy("suffix").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("of_suffix"), F.max("n").alias("weight")), "suffixes")
    whole = np.zeros(n)
    for r in by_suffix.select(F.posexplode("of_suffix").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        whole[r["k"]] = r["x"]
    parent = (whole + 1) / (whole.sum() + n)
    # a declared language has two or three letters, so its table has at most 18,252 rows
    confusion = materialize(_sums(rows.where("declared IS NOT NULL"), "declared", "of_declared").drop("weight"), "declared")
    seen, kinds = np.zeros(n), confusion.count() + 1
    for r in confusion.select(F.posexplode("of_declared").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        seen[r["k"]] = r["x"]

    literal = lambda x: F.array(*(F.lit(float(v)) for v in x))
    hosts = materialize(join_spread(by_host.withColumnRenamed("weight", "pages"), by_suffix, "suffix", "weight"), "hosts")
    joined = join_spread(rows.drop("suffix"), hosts.drop("suffix"), "host", "pages").join(F.broadcast(confusion), "declared", "left")
    at_suffix = _smoothed(F.col("of_suffix"), F.col("post"), literal(parent), suffix_weight)
    at_host = _smoothed(F.col("of_host"), F.col("post"), at_suffix, host_weight)
    told = F.zip_with("of_declared", "post", lambda d, p: F.greatest(d - p, F.lit(0.0)) + 0.5)
    says = F.zip_with(told, F.zip_with(literal(seen), "post", lambda t, p: F.greatest(t - p, F.lit(0.0)) + 0.5 * kinds), lambda d, t: F.log(d / t))
    prior = F.zip_with("ll", at_host, lambda x, p: x + F.log(p))
    fused = _softmax(F.when(F.col("declared").isNotNull(), F.zip_with(prior, says, lambda x, y: x + y)).otherwise(prior))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = joined.select("page_id", "declared", "host", "post", fused.alias("posterior"))
    return out.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), best(F.col("post")).alias("text_lang"), "declared", "host", "posterior")
