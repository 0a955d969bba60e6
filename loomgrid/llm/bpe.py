"""Byte-level BPE encoding and decoding by a table of ranked merges.

Each distinct word is folded once per worker by the rank map: the adjacent pair of lowest rank
merges first, the leftmost of equal ones. Encoded words are then laid side by side; decoding
concatenates the binary pieces of the ids. The rank map is a literal of the vocabulary's size
(1 MB for 50,000 ranks), so sending it to each worker is bounded whatever the corpus.

The fold runs in Arrow batches. The same fold written with Spark's higher-order functions is
:func:`fold_words_sql`; README.md has its measured speed and why it isn't the main path.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a worker remembers; when full it starts anew, so memory stays bounded and results are the same.
CACHE_WORDS = 400_000

#: A single space between two characters that aren't white space always starts a new match of the pattern.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_RUN = regex.compile(r"\s | \s")


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: lines of base64 piece and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def fold_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 64:
        return _fold_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 60
    pair = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair and (least := min(pair)) != none:
        i = pair.index(least)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap over a linked list: n log n for a piece of n bytes."""
    n = len(piece)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := nxt[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prv[i]) >= 0 and (r := ranks.get(piece[p : end[i]])) is not None:
            heapq.heappush(heap, (r, p, end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class _Pieces(dict):
    """Match of the pattern -> its ids as int32 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = np.array(fold_piece(piece.encode(), self.ranks), np.int32).tobytes()
        if len(piece) <= 256:
            self[piece] = out
        return out


class _Words(dict):
    """Text after one space, up to the next sure cut -> ids as int32 bytes."""

    def __init__(self, pieces: _Pieces, pattern: str):
        super().__init__()
        self.pieces, self.find = pieces, regex.compile(pattern).findall

    def spell(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self.spell(" " + word)
        if len(word) <= 256:
            self[word] = out
        return out


def _words_of(text: str) -> list[str]:
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


class Encoder:
    """Encodes strings with caches of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = _Words(_Pieces(ranks), pattern)

    def __call__(self, text: str) -> bytes:
        """Ids as int32 bytes, side by side."""
        if not text:
            return b""
        first, *rest = _words_of(text)
        return self.words.spell(first) + b"".join(map(self.words.__getitem__, rest))


class Decoder:
    """Concatenates the pieces of ids, cut from one buffer."""

    def __init__(self, ranks: dict[bytes, int]):
        ordered = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            ordered[rank] = piece
        self.size = np.array([len(p) for p in ordered], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(ordered), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        into = np.cumsum(n) - n
        return self.data[np.repeat(self.start[ids] - into, n) + np.arange(n.sum())].tobytes()


_encoders: dict[tuple, Encoder] = {}
_decoders: dict[int, Decoder] = {}


def _decoder(ranks: dict[bytes, int]) -> Decoder:
    if id(ranks) not in _decoders:
        _decoders.clear()
        _decoders[id(ranks)] = Decoder(ranks)
    return _decoders[id(ranks)]


def encode(df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, ids: str = "ids", keep: list[str] | None = None, verify: str | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but ``text``) and ``ids`` array<int>; with ``verify`` a column of that name
    that says whether decoding the ids gives the text's bytes again.

    Null and empty texts have an empty array. Columns of ``df`` named like ``ids`` are replaced.
    Map-only: no shuffle, one pass, any row may be recomputed alone.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, ids, verify)]
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (len(shared.value[0]), hash(shared.value[1]), id(shared.value[0]))
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(*shared.value)
        enc = _encoders[key]
        for b in batches:
            at = b.schema.get_field_index("__text")
            texts = b.column(at).to_pylist()
            rows = [np.frombuffer(enc(t) if t else b"", np.int32) for t in texts]
            made = [_lists(rows)]
            if verify:
                back = _decoder(shared.value[0])
                made.append(pa.array([back(r) == (t or "").encode() for r, t in zip(rows, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), *made], names=[*keep, ids, *[verify] * bool(verify)])

    held = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    return held.mapInArrow(run, _schema(df, keep) + f"`{ids}` array<int>" + (f", `{verify}` boolean" if verify else ""))


def decode(df: DataFrame, ids: str, ranks: dict[bytes, int], out: str = "decoded") -> DataFrame:
    """``df`` without ``ids``, with ``out`` binary: the pieces of the ids concatenated; null ids give empty bytes."""
    keep = [c for c in df.columns if c not in (ids, out)]
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _decoder(shared.value)
        for b in batches:
            at = b.schema.get_field_index("__ids")
            rows = [back(row.values.to_numpy(zero_copy_only=False)) if row.is_valid else b"" for row in b.column(at)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(rows, pa.binary())], names=[*keep, out])

    held = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids}`").alias("__ids"))
    return held.mapInArrow(run, _schema(df, keep) + f"`{out}` binary")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _schema(df: DataFrame, keep: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in keep)


def fold_words_sql(word: Column, ranks: dict[bytes, int], buckets: int = 1 << 16) -> Column:
    """The ranked-merge fold of one match as Spark higher-order functions: array<int> of ids.

    The rank map is a literal array of small buckets found by hash, since Spark's own map lookup
    scans all keys. ``word`` is binary and not empty; null stays null.
    """
    import xxhash

    table: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    for piece, rank in ranks.items():
        table[signed(xxhash.xxh64_intdigest(piece, 42)) % buckets].append((piece.hex().upper(), rank))
    literal = F.split(F.lit("|".join(";".join(f"{p}:{r}" for p, r in b) for b in table)), r"\|")

    def rank_of(piece: Column) -> Column:
        bucket = F.element_at(literal, (F.pmod(F.xxhash64(piece), F.lit(buckets)) + 1).cast("int"))
        entry = F.get(F.filter(F.split(bucket, ";"), lambda e: F.substring_index(e, ":", 1) == F.hex(piece)), F.lit(0))
        return F.substring_index(entry, ":", -1).cast("int")

    def merge(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(rank_of(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))
        i = best["i"]
        merged = F.concat(F.slice(parts, F.lit(1), i - 1), F.array(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))), F.slice(parts, i + 2, F.greatest(F.size(parts) - i - 1, F.lit(0))))
        return F.when((F.size(parts) < 2) | i.isNull(), parts).otherwise(merged)

    single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    return F.transform(F.aggregate(F.sequence(F.lit(1), F.length(word)), single, merge), rank_of)
