"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item's set is its distinct shingles of five words (a shorter item: all its words as one). A
document holds an item if it holds at least ``threshold`` of that set. Items are dealt to classes
by size; a class keeps of each item the smallest shingle hashes, as many as the class needs so
that no document over the threshold can miss them all: n - ceil(threshold * n) + 1 of n, with n
the class's upper size (all, if the item has fewer). So short items are found inside documents of
any length, which the Jaccard similarity of whole sets would not do. Hits are verified by exact
containment over shingle texts, not hashes.

The items' hashes are sent to the tasks only while there are at most ``most_literals`` of them,
counted first; beyond, documents' shingles are joined with them by shuffle. Words are runs of
letters and digits (ASCII, or any character beyond ASCII) of the lower-cased text, so changed
punctuation doesn't hide an item.

Null and empty texts hold nothing, items without words are held by nothing. Rows are told apart by
a number of their own: repeated doc_ids give a row each; repeated item_ids with the same text one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), _GAP, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _spelled(words: str, at: Column, width: int) -> Column:
    return F.concat_ws(" ", *(F.get(words, at + k) for k in range(width)))


def _hashes(words: str, width: int) -> Column:
    """Hash of the shingle that starts at each word, in order."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = 5) -> DataFrame:
    """(item_id, width, shingle, h, n): each distinct shingle of each item."""
    words = items.select(F.col(f"`{item_id}`").alias("item_id"), _words(text).alias("words")).where(F.size("words") > 0).distinct()
    words = words.withColumn("width", F.least(F.size("words"), F.lit(width)))
    starts = words.select("item_id", "width", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))).alias("at"))
    sliced = starts.select("item_id", "width", F.slice("words", F.col("at") + 1, F.col("width")).alias("s"))
    hashed = F.coalesce(*(F.when(F.col("width") == w, F.xxhash64(*(F.get("s", F.lit(k)) for k in range(w)))) for w in range(1, width + 1)))
    distinct = sliced.select("item_id", "width", F.concat_ws(" ", "s").alias("shingle"), hashed.alias("h")).distinct()
    sizes = distinct.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return distinct.join(sizes, "item_id")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(width, h): of each item the smallest hashes, as many as its size class needs. Classes double in size."""
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("long")
    needed = upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1
    ordered = shingles.groupBy("item_id", "width").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("h")).alias("hs"))
    return ordered.select("width", F.explode(F.slice("hs", F.lit(1), F.least(needed, F.col("n")).cast("int"))).alias("h")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", most_literals: int = 50_000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document and item over the threshold."""
    shingles = materialize(item_shingles(items, text=item_text, width=width), "benchmark-shingles")
    count = shingles.count()
    read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), _words(text).alias("words"))
    small = count <= most_literals
    parts = []
    for w in sorted(r["width"] for r in shingles.select("width").distinct().collect()):
        of_width = shingles.where(F.col("width") == w)
        hashed = read.select("doc_id", "rid", "words", _hashes("words", w).alias("hs"))
        if small:
            sketch = [r["h"] for r in sketches(of_width, threshold).collect()]
            known = [r["h"] for r in of_width.select("h").distinct().collect()]
            hit = hashed.where(F.exists("hs", lambda h: h.isin(sketch)))
            places = F.filter(F.transform("hs", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
            placed = hit.select("doc_id", "rid", "words", F.explode(places).alias("at"))
        else:
            # the same search by shuffle: (row, hash) meets the sketches, then the rows found meet all of their items' shingles
            own = hashed.select("rid", F.explode(F.array_distinct("hs")).alias("h"))
            found = own.join(sketches(of_width, threshold).select("h"), "h").select("rid").distinct()
            placed = hashed.join(found, "rid").select("doc_id", "rid", "words", F.posexplode("hs").alias("at", "h")).drop("h")
        parts.append(placed.select("doc_id", "rid", F.lit(w).alias("width"), _spelled("words", F.col("at"), w).alias("shingle")))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long, containment double").select(F.col("doc_id").cast(dict(docs.dtypes)[doc_id]), F.col("item_id").cast(dict(items.dtypes)["item_id"]), "n_shared", "n_item", "containment")
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    side = shingles.select("width", "shingle", "item_id", "n")
    shared = held.distinct().join(F.broadcast(side) if small else side, ["width", "shingle"])
    counted = shared.groupBy("rid", "doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n").alias("n_item"))
    return counted.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9)).select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
