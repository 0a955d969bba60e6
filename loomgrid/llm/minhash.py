"""Near-duplicate documents: many universal hash minima, banding, exact verification, components.

1. Equal shingle sets collapse to one representative, the smallest doc_id, by a digest of the set.
2. Representatives that share a band of minima meet in buckets. Each is compared with the smallest
   members of its buckets (at most two, those it shares most bands with), on full sets.
3. Links give components by alternating large-star and small-star.
4. In buckets that still hold several components, the rows outside the bucket's largest component meet
   all others, in blocks of bounded rows and bytes on either side: first by signature, which finds the
   documents that have partners in other components, then these alone on full sets. A pair is looked at
   in the bucket of its first common band only, and a block returns no more links than join its
   components, so a group of copies is never expanded into all its pairs; pairs inside one component
   can't change the result. A bucket of n rows, m of them outside, sends n * ceil(m / 2048) +
   m * ceil(n / 2048) rows, at most 2 n while m is at most 2048.

With 45 bands of 6 minima a pair at the threshold of 0.8 misses every bucket with probability
1.1e-6; step 4 drops a pair by its signature only at 5.5 standard errors below the threshold.
Buckets have no cap. Null texts and texts without words have an empty set and are linked with nothing;
rows with a null doc_id are scored alone. Repeated rows of one doc_id count as one document; if their
texts differ, the set of least digest stands for it, and each row keeps its own n_shingles. Very long
texts are whole sets. Ties of equal sets go to the smallest doc_id. An empty table gives no rows, and
columns other than doc_id and text, whatever their names, are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import ascii_lower, join_spread, materialize, mix64, slices, text_buffer

BANDS, ROWS = 45, 6
#: Rows and shingles of a block.
_BLOCK, _BLOCK_SHINGLES = 2048, 2_000_000
#: Up to so many ids are sent to the tasks instead of shuffling all texts to them: 8 MB.
_SENT_IDS = 1_000_000
_random = np.random.default_rng(20_240_501)
_A = _random.integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its shingles) of each text with words."""
    data, offsets = text_buffer(column)
    for i, j in slices(offsets):
        part = ascii_lower(data[offsets[i] : offsets[j]])
        at = np.arange(len(part))
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[i : j + 1] - offsets[i]] = True
        space = (part == 32) | ((part >= 9) & (part <= 13))
        first = ~space & (edge[:-1] | np.concatenate([[True], space[:-1]]))
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        begun = np.maximum.accumulate(np.where(first, at, 0))
        each = mix64(part.astype(np.uint64) + (np.uint64(256) * (at - begun).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
        each[space] = 0
        word = mix64(np.add.reduceat(each, starts))
        bound = np.searchsorted(starts, offsets[i : j + 1] - offsets[i])
        for k in range(i, j):
            w = word[bound[k - i] : bound[k - i + 1]]
            if len(w):
                yield k, np.unique(_chain(w, min(width, len(w))))


def _chain(word: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(word) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of each of the universal hashes a * x + b over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        part = x[i : i + 512]
        np.minimum(least, (_A[:, None] * part + _B[:, None]).min(1), out=least)
    return least


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys, one byte of each minimum); without words all but n_shingles are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        for b in batches:
            n, (digest, bands, low) = np.zeros(b.num_rows, np.int64), ([None] * b.num_rows for _ in range(3))
            for k, s in shingle_sets(b.column(1), width):
                n[k], digest[k] = len(s), _digest(s)
                m = minima(s)
                key = turn.copy()
                for r in m.reshape(BANDS, ROWS).T:
                    key = mix64(key + r)
                bands[k], low[k] = key.view(np.int64), (m >> np.uint32(7)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "low"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, low binary")


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(rep, hashes) of the documents whose id is in ``ids``; of several texts of one id that of least digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(shingle_sets(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _ in found], pa.int64())), pa.array([_digest(s) for _, s in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["rep", "digest", "hashes"])

    kind = dict(docs.dtypes)["doc_id"]
    wanted = ids.select(F.col("rep").alias("doc_id"))
    if kind in ("bigint", "int") and ids.count() <= _SENT_IDS:
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, f"rep {kind}, digest binary, hashes binary")
    return sets.groupBy("rep").agg(F.min_by("hashes", "digest").alias("hashes"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least, most = sorted((len(p), len(q)))
                if 100 * least < percent * most:
                    ok.append(False)
                    continue
                same = _same(p, q)
                ok.append(100 * same >= percent * (least + most - same))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    kind = dict(pairs.dtypes)["a"]
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a")
    both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, of nodes with an edge (a, b).

    Alternates large-star and small-star until the edges stay as they are; each round is written to
    the shared folder. The rounds needed grow with the logarithm of the number of nodes.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        last = now
    raise RuntimeError(f"the components weren't stable after {most_rounds} rounds")


def _same(p: np.ndarray, q: np.ndarray) -> int:
    both = np.concatenate([p, q])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _blocks(members: DataFrame, signs: DataFrame, component: DataFrame) -> DataFrame:
    """(key, band, i, j, seeks, met, rep, component, inside, bands, low): of buckets with several components, the rows outside
    the largest one in blocks i, once for each block j of all the bucket's rows, and those once for each i."""
    marked = members.join(component, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    several = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    held = materialize(marked.join(several, "key"), "open-buckets")
    parts = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    whole = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "component")).alias("main"))
    blocks = lambda n, size: F.greatest(F.ceil(n / _BLOCK), F.ceil(size / _BLOCK_SHINGLES)).cast("int")
    counts = whole.select("key", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("outer"), blocks(F.col("n"), F.col("size")).alias("blocks"))
    rows = held.join(counts, "key").join(signs, "rep")
    own = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, seeks, met: F.struct(i.alias("i"), j.alias("j"), seeks.alias("seeks"), met.alias("met"))
    yes, no, outside = F.lit(True), F.lit(False), F.col("component") != F.col("main")
    members = F.transform(every("outer"), lambda i: place(i, own("blocks", 2), no, yes))
    seekers = F.transform(F.when(outside, every("blocks")).otherwise(F.array().cast("array<int>")), lambda j: place(own("outer", 1), j, yes, no))
    one = F.array(place(F.lit(0), F.lit(0), outside, yes))  # nearly all buckets: a row comes once and does both
    places = F.when((F.col("outer") == 1) & (F.col("blocks") == 1), one).otherwise(F.concat(members, seekers))
    # of the band keys those before the bucket's own decide whether a pair met earlier
    return rows.select("key", "band", "rep", "component", (~outside).alias("inside"), F.slice("bands", F.lit(1), F.col("band")).alias("bands"), "low", F.explode(places).alias("at")).select("key", "band", "at.*", "rep", "component", "inside", "bands", "low")


def _near_pairs(group: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(seeking row, rows met of other components whose signature agrees), each pair in the bucket of its first common band."""
    seeks = np.array(group["seeks"].to_pylist(), bool)
    met = np.flatnonzero(group["met"].to_pylist())
    if not len(met) or not seeks.any():
        return
    band = group["band"][0].as_py()
    bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, band)
    low = np.frombuffer(b"".join(group["low"].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    _, comp = np.unique(np.array(group["component"].to_pylist()), return_inverse=True)
    _, rank = np.unique(np.array(group["rep"].to_pylist()), return_inverse=True)
    inside = np.array(group["inside"].to_pylist(), bool)
    for x in np.flatnonzero(seeks):
        # two rows outside the largest component seek one another: the lower one looks
        near = met[(comp[met] != comp[x]) & (inside[met] | (rank[met] > rank[x]))]
        if len(near):
            near = near[(low[near] == low[x]).sum(1) >= least]
        if len(near) and band:
            near = near[~(bands[near] == bands[x]).any(1)]
        if len(near):
            yield x, near


def _least_agreeing(threshold: float) -> int:
    hashes = BANDS * ROWS
    return int(np.floor(hashes * (threshold - 5.5 * np.sqrt(threshold * (1 - threshold) / hashes))))


def _open_rows(blocks: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``blocks`` that have a partner of another component there."""
    least, kind = _least_agreeing(threshold), dict(blocks.dtypes)["rep"]

    def find(group: pa.Table) -> pa.Table:
        hit = np.zeros(group.num_rows, bool)
        for x, near in _near_pairs(group, least):
            hit[x] = True
            hit[near] = True
        return group.select(["key", "i", "j", "seeks", "rep"]).filter(pa.array(hit))

    return blocks.groupBy("key", "i", "j").applyInArrow(find, f"key long, i int, j int, seeks boolean, rep {kind}")


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between components, verified on full sets (``hashes``), as many as join the components of each block."""
    least, percent, kind = _least_agreeing(threshold), round(threshold * 100), dict(rows.dtypes)["rep"]

    def find(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        size = np.array([len(x) for x in sets])
        parent = np.unique(np.array(group["component"].to_pylist()), return_inverse=True)[1]
        a, b = [], []
        for x, near in _near_pairs(group, least):
            near = near[100 * np.minimum(size[near], size[x]) >= percent * np.maximum(size[near], size[x])]
            for y in near:
                if parent[x] != parent[y]:
                    same = _same(sets[x], sets[y])
                    if 100 * same >= percent * (size[x] + size[y] - same):
                        parent[parent == parent[y]] = parent[x]
                        a.append(x)
                        b.append(y)
        take = lambda r: group["rep"].take(pa.array(r, pa.int64()))
        return pa.table({"a": take(a), "b": take(b)})

    return rows.groupBy("key", "i", "j").applyInArrow(find, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; kept: it is its component's smallest doc_id."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = materialize(signatures(source, "doc_id", "text", width), "signatures")
    sets = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    one = materialize(sets.groupBy("doc_id").agg(F.min("digest").alias("digest")), "documents")
    reps = materialize(one.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "sets")
    held = sets.join(reps, (sets["digest"] == reps["digest"]) & (sets["doc_id"] == reps["rep"]), "left_semi").dropDuplicates(["digest", "doc_id"])
    keys = materialize(held.select(F.col("doc_id").alias("rep"), "n_shingles", F.posexplode("bands").alias("band", "key")), "bands")
    shared = keys.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keys.join(shared.select("key", "least"), "key"), "buckets")

    counted = members.where("rep <> least").groupBy(F.col("least").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    best = Window.partitionBy("b").orderBy(F.desc("n"), "a")  # a document has at most as many rows here as bands
    stars = materialize(counted.withColumn("k", F.row_number().over(best)).where("k <= 2").select("a", "b"), "stars")
    ids = lambda p: p.select(F.col("a").alias("rep")).unionByName(p.select(F.col("b").alias("rep"))).distinct()
    known = full_sets(source, ids(stars), width)
    first = materialize(components(verified(stars, materialize(known, "sets"), threshold)), "components")

    signs = held.select(F.col("doc_id").alias("rep"), "bands", "low")
    blocks = _blocks(members.select("key", "band", "rep", "n_shingles"), signs, first)
    open_ = materialize(_open_rows(blocks, threshold), "open")
    if not open_.isEmpty():
        rest = full_sets(source, open_.select("rep").distinct(), width)
        links = _links(blocks.join(open_, ["key", "i", "j", "seeks", "rep"]).join(rest, "rep"), threshold)
        tree = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        first = materialize(components(tree.unionByName(links)), "components")

    of_set = materialize(reps.join(first, F.col("rep") == F.col("node"), "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id")), "set-components")
    group = join_spread(one, of_set, "digest", "n").select("doc_id", "component_id")
    grouped = signed.select("doc_id", "n_shingles").join(group, "doc_id", "left")
    return grouped.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
