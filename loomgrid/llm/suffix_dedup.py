"""Repeated passages by per-shard suffix arrays.

A byte is removed if a ``length``-byte string that covers it also starts in a document with a
smaller doc_id. Comparing every pair of document shards would grow with the square of the input,
so suffixes are first dealt by content:

1. Every window of ``length`` bytes has an anchor, its 16-byte string of least hash; equal windows
   have equal anchors. Anchors are about a twentieth of the positions. Each shard of anchor hashes
   finds those that occur in several documents and answers the bundles of documents they came from.
2. Around the anchors that occur elsewhere, documents send contexts: the bytes of the windows that
   share the anchor. Equal contexts of a bundle go as one, that of its smallest doc_id; the others are
   covered as they stand. A shard holds all contexts sent of its anchors, again equal ones as one.
3. Contexts are indexed in blocks of bounded size: a suffix array by Larsson-Sadakane refinement,
   common prefixes by Kasai's method in step for all contexts, and so the classes of equal windows.
   The sorted windows of the blocks are merged by binary search; a window is covered if a smaller
   doc_id holds it.
4. Covered windows return to their bundles, where the spans are joined.

Memory: a bundle is at most ``BUNDLE`` doc_ids with texts of ``LONG_BYTES`` at most each, or one longer
document; rows that repeat a doc_id add to its bundle. A shard is the anchors of about ``SHARD_BYTES`` of
text, however many shards that makes, and the distinct contexts of a bundle for each.
Rows travel as packed binaries of many anchors, so the JVM handles few rows. Everything after the
scan is deterministic, so lost tasks can run again.

Null texts are empty; texts under ``length`` bytes lose nothing. Rows with a null doc_id take no
part and come back whole. Repeated rows of one doc_id, equal or not, don't remove one another, and each
loses what smaller doc_ids hold. Columns named ``removed`` or ``kept`` are replaced, others pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import slices, text_buffer

GRAM = 16
#: Documents of a bundle have doc_ids in a range of this many.
BUNDLE_BITS = 9
BUNDLE = 1 << BUNDLE_BITS
#: A longer text is a bundle of its own.
LONG_BYTES = 1 << 18
#: Text per shard of anchors.
SHARD_BYTES = 4 << 20
#: Contexts of a block; a block ends with an anchor, but for anchors that fill more than one.
_BLOCK_ROWS = 1 << 13
_SLICE, _BATCH = 1 << 18, 8 << 20
_PAD = 8
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


# -- anchors ---------------------------------------------------------------------------------


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[p : p + width] at each p; past the end counts as the largest value."""
    have = 1
    while have < width:
        step = min(have, width - have)
        y = x.copy()
        np.minimum(x[:-step], x[step:], out=y[:-step])
        x, have = y, have + step
    return x


def _most_before(x: np.ndarray, width: int) -> np.ndarray:
    """Largest of x[p - width + 1 : p + 1] at each p."""
    have = 1
    while have < width:
        step = min(have, width - have)
        y = x.copy()
        np.maximum(x[step:], x[:-step], out=y[step:])
        x, have = y, have + step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes of them, least hash of the window that starts at each byte, 0 where none does)."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n, np.uint64)
    padded = np.zeros(n + GRAM, np.uint8)
    padded[:n] = data
    word = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    high = word[8:]
    h = word[:n] * _C1 + ((high << np.uint64(31)) | (high >> np.uint64(33))) * _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    width = length - GRAM + 1
    m = _least(h, width)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    m[left < length] = 0
    at = np.flatnonzero(_most_before(m, width) == h)
    return at, h[at], m


def _keys(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of an anchor in the high half, 32 further bits of its hash in the low half."""
    return (((h >> np.uint64(1)) % np.uint64(shards)) << np.uint64(32)) | (h >> np.uint64(32))


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, np.int64)


# -- suffix arrays ---------------------------------------------------------------------------


def suffix_array(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the rows in order, as row * columns + column, and the rank of each cell (-1: past its row's end).

    Larsson-Sadakane refinement: suffixes sorted by eight bytes form groups; each pass sorts the
    groups that still hold several by the rank of the suffix as many bytes further as are known.
    A row ends with a symbol of its own, larger than any byte.
    """
    count, columns = rows.shape
    inside = np.arange(columns) < sizes[:, None]
    padded = np.full((count, columns + _PAD), 255, np.uint8)
    np.copyto(padded[:, :columns], rows, where=inside)
    cell = np.flatnonzero(inside.ravel())
    prefix = np.ndarray((count, columns), ">u8", padded, strides=(columns + _PAD, 1)).ravel()[cell].astype(np.uint64)
    order = np.argsort(prefix)
    sa = cell[order]
    rank = np.full(count * columns, -1, np.int64)
    # a suffix of fewer than eight bytes equals none of another length, since 0xFF is no byte of UTF-8
    first = _runs(prefix[order])
    size = np.diff(first)
    rank[sa] = np.repeat(first[:-1], size)
    total, known = len(sa), _PAD
    at = np.flatnonzero(np.repeat(size > 1, size))
    while len(at):
        s = sa[at]
        row = s // columns
        further = s - row * columns + known
        second = np.where(further < sizes[row], rank[np.minimum(s + known, count * columns - 1)], total + row)
        order = np.argsort((rank[s] << 32) | second)
        s, second = s[order], second[order]
        sa[at] = s
        group = rank[s]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        starts = np.append(np.flatnonzero(new), len(s))
        size = np.diff(starts)
        rank[s] = np.repeat(at[starts[:-1]], size)
        at = at[np.repeat(size > 1, size)]
        known *= 2
    return sa, rank


def common_prefixes(rows: np.ndarray, sizes: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it, by Kasai's method.

    All rows take their k-th suffix in the same step; from one suffix to the next of a row the
    common prefix shrinks by one at most.
    """
    count, columns = rows.shape
    flat = rows.ravel()
    lcp = np.zeros(len(sa), np.int64)
    have = np.zeros(count, np.int64)
    for k in range(columns):
        live = np.flatnonzero(k < sizes)
        if not len(live):
            break
        r = rank[live * columns + k]
        have[live[r == 0]] = 0
        live, r = live[r > 0], r[r > 0]
        other = sa[r - 1]
        other_row, other_column = other // columns, other % columns
        n = have[live]
        most = np.minimum(sizes[live] - k, sizes[other_row] - other_column)
        go = np.arange(len(live))
        while len(go):
            go = go[n[go] < most[go]]
            go = go[flat[live[go] * columns + k + n[go]] == flat[other[go] + n[go]]]
            n[go] += 1
        lcp[r] = n
        have[live] = np.maximum(n - 1, 0)
    return lcp


def window_classes(rows: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: (each window's cell, its class), and per class the smallest owner; classes are in the order of their bytes."""
    columns = rows.shape[1]
    sa, rank = suffix_array(rows, sizes)
    lcp = common_prefixes(rows, sizes, sa, rank)
    full = sa % columns + length <= sizes[sa // columns]
    new = lcp < length
    group = np.cumsum(new)
    group, cell = group[full], sa[full]
    _, group = np.unique(group, return_inverse=True)
    least = np.full(group.max() + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner[cell // columns])
    return cell, group, least


def _cuts(anchor: np.ndarray) -> list[tuple[int, int]]:
    """Blocks of rows sorted by anchor."""
    out, i, n = [], 0, len(anchor)
    while i < n:
        j = min(i + _BLOCK_ROWS, n)
        if j < n and (k := int(np.searchsorted(anchor, anchor[j]))) > i:
            j = k
        out.append((i, j))
        i = j
    return out


def covered_windows(rows: np.ndarray, sizes: np.ndarray, owner: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """For each row and column: does a row with a smaller owner hold the window that starts there? Rows are sorted by anchor."""
    count, columns = rows.shape
    out = np.zeros((count, columns), bool)
    blocks = []
    for i, j in _cuts(anchor):
        cell, group, least = window_classes(rows[i:j], sizes[i:j], owner[i:j], length)
        if i and anchor[i] == anchor[i - 1] or j < count and anchor[j - 1] == anchor[j]:
            first = np.full(len(least), -1)
            first[group[::-1]] = cell[::-1]
            window = np.empty((len(first), length), np.uint8)
            flat = rows[i:j].ravel()
            for k in range(length):
                window[:, k] = flat[first + k]
            window = window.view(f"S{length}").ravel()
        else:
            window = None
        blocks.append((i, j, cell, group, least, window))
    for x in range(len(blocks)):  # an anchor of more contexts than a block holds: its blocks' windows are merged
        for y in range(x + 1, len(blocks)):
            if anchor[blocks[y][0]] != anchor[blocks[x][1] - 1]:
                break
            a, b = blocks[x][5], blocks[y][5]
            if not len(a) or not len(b):
                continue
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            same = np.flatnonzero(a[at] == b)
            low = np.minimum(blocks[x][4][at[same]], blocks[y][4][same])
            blocks[x][4][at[same]] = low
            blocks[y][4][same] = low
    for i, _, cell, group, least, _ in blocks:
        row = cell // columns
        hit = least[group] < owner[i + row]
        out[i + row[hit], cell[hit] % columns] = True
    return out


# -- stages ----------------------------------------------------------------------------------


def _bases(bundle: np.ndarray) -> np.ndarray:
    """Least doc_id that each bundle can hold: odd ones are of one long document."""
    return np.where(bundle & 1, bundle >> 1, (bundle >> 1) << BUNDLE_BITS)


def _numbers(docs: pa.Table, base: int) -> np.ndarray:
    """A number for each row of a bundle that every task gives it: its doc_id less ``base``, plus ``BUNDLE`` for each row of that doc_id before it."""
    ids = docs["doc_id"].to_numpy()
    out = (ids - base).astype(np.uint32)
    if len(np.unique(ids)) < len(ids):
        order = pc.sort_indices(docs.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")]).to_numpy()
        starts = _runs(ids[order])
        out[order] += ((np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))) * BUNDLE).astype(np.uint32)
    return out


def _equal(key: np.ndarray, more: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal contexts as one: (rows that stand for them, the place there of each row's, is its doc_id larger than that one's?)."""
    columns = rows.shape[1]
    wide = np.zeros((len(rows), -(-columns // 8) * 8), np.uint8)
    wide[:, :columns] = rows
    digest = key.astype(np.uint64) * _C1 + more.astype(np.uint64)
    for w in wide.view(np.uint64).T:
        digest = (digest ^ w) * _C2
        digest ^= digest >> np.uint64(32)
    order = np.lexsort((doc, digest))
    starts = _runs(digest[order])
    size = np.diff(starts)
    head = order[starts[:-1]]
    # the digest deals; the anchor, the windows and the bytes decide
    first = np.repeat(head, size)
    equal = (rows[order] == rows[first]).all(1) & (key[order] == key[first]) & (more[order] == more[first])
    alone = order[~equal]
    place = np.empty(len(rows), np.int64)
    place[order] = np.repeat(np.arange(len(head)), size)
    place[alone] = len(head) + np.arange(len(alone))
    head = np.concatenate([head, alone])
    return head, place, doc > doc[head[place]]


def _asked(base: int, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, shards: int) -> list[tuple]:
    found = []
    for i, j in slices(offsets, _SLICE):
        at, h, _ = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
        doc = i + np.searchsorted(offsets[i : j + 1] - offsets[i], at, side="right") - 1
        found.append((doc, _keys(h, shards)))
    doc, key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.argsort(key)
    key, doc = key[order], ids[doc[order]]
    starts = _runs(key)[:-1]
    if not len(starts):
        return []
    least, most = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    key = key[starts]
    shard = (key >> np.uint64(32)).astype(np.int32)
    cut = _runs(shard)
    low, off, many = key.astype(np.uint32), (least - base).astype(np.uint16), (least != most)
    return [(shard[i], low[i:j].tobytes(), off[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _ask(length: int, shards: int):
    """A bundle's documents -> per shard: its distinct anchors, least doc_id of each and whether others of the bundle have it."""
    names, types = ["shard", "bundle", "low", "off", "many"], [pa.int32(), pa.int64(), *[pa.binary()] * 3]

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        ids, bundle = docs["doc_id"].to_numpy(), key[0].as_py()
        base = int(_bases(np.array([bundle]))[0])
        data, offsets = text_buffer(docs["text"].combine_chunks())
        rows = [r for i, j in slices(offsets, _BATCH) for r in _asked(base, ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, shards)]
        shard, *packed = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.table([pa.array(x, t) for x, t in zip([shard, [bundle] * len(rows), *packed], types, strict=True)], names=names)

    return run, "shard int, bundle long, low binary, off binary, many binary"


def _answer(key: tuple, group: pa.Table) -> pa.Table:
    """A shard's anchors -> per bundle: those that several documents have."""
    low = [np.frombuffer(x, np.uint32) for x in group["low"].to_pylist()]
    n = [len(x) for x in low]
    bundle = np.repeat(group["bundle"].to_numpy(), n)
    doc = np.concatenate([np.frombuffer(x, np.uint16) for x in group["off"].to_pylist()]) + _bases(bundle)
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:k] for x, k in zip(group["many"].to_pylist(), n, strict=True)])
    low = np.concatenate(low)
    order = np.argsort(low)
    starts = _runs(low[order])
    first = starts[:-1]
    doc, many = doc[order], many[order]
    shared = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | (np.maximum.reduceat(many, first) > 0)
    back = np.zeros(len(low), bool)
    back[order] = np.repeat(shared, np.diff(starts))
    low, bundle = low[back], bundle[back]
    order = np.argsort(bundle, kind="stable")
    low, bundle = low[order], bundle[order]
    cut = _runs(bundle)
    out = [np.unique(low[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"bundle": pa.array(bundle[cut[:-1]], pa.int64()), "shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "low": pa.array(out, pa.binary())})


def _contexts(length: int, shards: int):
    """A bundle's documents and shared anchors -> per shard: anchor, row, first window, windows less one, bytes.

    One row of each bundle has ``runs`` instead: windows that equal contexts of its smaller doc_ids cover.
    """
    reach = length - GRAM

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        names = ["shard", "bundle", "low", "row", "first", "more", "bytes", "runs"]
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        if not docs.num_rows or not found.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        bundle = key[0].as_py()
        number = _numbers(docs, int(_bases(np.array([bundle]))[0]))
        known = np.concatenate([(np.uint64(s) << np.uint64(32)) | np.frombuffer(x, np.uint32) for s, x in zip(found["shard"].to_pylist(), found["low"].to_pylist(), strict=True)])
        known.sort()
        data, offsets = text_buffer(docs["text"].combine_chunks())
        parts = []
        for i, j in slices(offsets, _SLICE):
            base, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            at, h, m = anchors(base, own, length)
            k = _keys(h, shards)
            hit = known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k
            at, h, k = at[hit], h[hit], k[hit]
            if not len(at):
                continue
            start = np.maximum(at[:, None] + np.arange(-reach, 1), 0)
            same = (m[start] == h[:, None]) & (at[:, None] + np.arange(-reach, 1) >= 0)
            lo, hi = at - reach + same.argmax(1), at - same[:, ::-1].argmax(1)
            padded = np.concatenate([base, np.zeros(length + reach, np.uint8)])
            bytes_ = np.lib.stride_tricks.sliding_window_view(padded, length + reach)[lo]
            bytes_[np.arange(length + reach) >= (hi - lo + length)[:, None]] = 255
            doc = np.searchsorted(own, at, side="right") - 1
            parts.append((k, number[i + doc], (lo - own[doc]).astype(np.uint32), (hi - lo).astype(np.uint8), bytes_))
        if not parts:
            return pa.table([pa.array([], t) for t in types], names=names)
        k, row, first, more, bytes_ = (np.concatenate(x) for x in zip(*parts, strict=True))
        whole = _equal(k, more, bytes_, row % BUNDLE)[2]
        ready = np.stack([row[whole], first[whole], first[whole] + more[whole]], 1).astype(np.int64)
        order = np.flatnonzero(~whole)
        order = order[np.argsort(k[order], kind="stable")]
        k, row, first, more, bytes_ = k[order], row[order], first[order], more[order], bytes_[order]
        shard = (k >> np.uint64(32)).astype(np.int32)
        cut = _runs(shard)
        packed = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (k.astype(np.uint32), row, first, more, bytes_)]
        n = len(cut) - 1
        out = [[*shard[cut[:-1]]], [bundle] * n, *packed, [None] * n]
        if len(ready):
            for column, x in zip(out, [bundle % shards, bundle, *[None] * 5, ready.tobytes()], strict=True):
                column.append(x)
        return pa.table([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return run, "shard int, bundle long, low binary, row binary, first binary, more binary, bytes binary, runs binary"


def _cover(length: int):
    """A shard's contexts -> per bundle: runs of covered windows (row, first, last)."""
    columns = 2 * length - GRAM

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ready = group.filter(pc.is_valid(group["runs"])).select(["bundle", "runs"])
        group = group.filter(pc.is_null(group["runs"]))
        if not group.num_rows:
            return ready
        low = [np.frombuffer(x, np.uint32) for x in group["low"].to_pylist()]
        bundle = np.repeat(group["bundle"].to_numpy(), [len(x) for x in low])
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in group[c].to_pylist()])
        low, first, more = np.concatenate(low), read("first", np.uint32).astype(np.int64), read("more", np.uint8).astype(np.int64)
        row, rows = read("row", np.uint32).astype(np.int64), read("bytes", np.uint8).reshape(-1, columns)
        doc = row % BUNDLE + _bases(bundle)
        head, owner_of, whole = _equal(low, more, rows, doc)
        # contexts of anchors that have more than one
        anchor = low[head]
        by = np.argsort(anchor, kind="stable")
        run_of = _runs(anchor[by])
        several = np.zeros(len(head), bool)
        several[by] = np.repeat(np.diff(run_of) > 1, np.diff(run_of))
        at = np.flatnonzero(several)
        part = np.zeros((len(head), length - GRAM + 1), bool)
        if len(at):
            at = at[np.argsort(anchor[at], kind="stable")]
            part[at] = covered_windows(rows[head[at]], more[head[at]] + length, doc[head[at]], anchor[at], length)[:, : part.shape[1]]
        bits = part[owner_of]
        bits[whole] = True
        bits &= np.arange(bits.shape[1]) <= more[:, None]
        edge = np.diff(bits.astype(np.int8), axis=1, prepend=0, append=0)
        r, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        out = np.stack([row[r], first[r] + begin, first[r] + end - 1], 1).astype(np.int64)
        order = np.argsort(bundle[r], kind="stable")
        out, cut_by = out[order], bundle[r][order]
        cut = _runs(cut_by)
        found = pa.table({"bundle": pa.array(cut_by[cut[:-1]], pa.int64()), "runs": pa.array([out[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})
        return pa.concat_tables([ready.cast(found.schema), found])

    return run, "bundle long, runs binary"


def _spans(length: int, whole_characters: bool):
    """A bundle's documents and covered windows -> documents with removed spans and kept bytes."""

    def run(key: tuple, docs: pa.Table, runs: pa.Table) -> pa.Table:
        found = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 3) for x in runs["runs"].to_pylist())])
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        spans, kept = [], []
        for i, t in zip(_numbers(docs, int(_bases(np.array([key[0].as_py()]))[0])).tolist(), docs["text"].to_pylist(), strict=True):
            t = t or b""
            a, b = np.searchsorted(found[:, 0], i), np.searchsorted(found[:, 0], i, side="right")
            mark = np.zeros(len(t) + 1, np.int64)
            np.add.at(mark, found[a:b, 1], 1)
            np.add.at(mark, found[a:b, 2] + length, -1)
            gone = np.cumsum(mark[:-1]) > 0
            data = np.frombuffer(t, np.uint8)
            if whole_characters and gone.any():
                head = (data & 0xC0) != 0x80
                starts = np.flatnonzero(head)
                gone = np.repeat(np.minimum.reduceat(gone, starts), np.diff(np.append(starts, len(t))))
            edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
            spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            kept.append(data[~gone].tobytes())
        names = [n for n in docs.column_names if n not in ("bundle", "text")]
        return pa.table({**{n: docs[n] for n in names}, "text": docs["text"], "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """Columns of ``docs`` (``text`` as binary), ``removed`` array<struct<start,stop>> in bytes and ``kept`` binary.

    ``whole_characters``: a character is removed only if all its bytes are, so ``kept`` stays UTF-8.
    """
    rest = [c for c in docs.columns if c not in (doc_id, text, "removed", "kept")]
    key = F.col(f"`{doc_id}`").cast("long")
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    shards = int(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // SHARD_BYTES)))
    source = docs.select(key.alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)))
    usable = source.where("doc_id IS NOT NULL")
    alone = (F.octet_length("text") > LONG_BYTES) & F.col("doc_id").between(-(1 << 61), 1 << 61)  # larger ids have no double
    bundled = usable.withColumn("bundle", F.when(alone, F.col("doc_id") * 2 + 1).otherwise(F.shiftright("doc_id", BUNDLE_BITS) * 2))

    ask, asked = _ask(length, shards)
    anchored = bundled.groupBy("bundle").applyInArrow(ask, asked)  # the same exchange as below, read again
    answers = anchored.groupBy("shard").applyInArrow(_answer, "bundle long, shard int, low binary")
    contexts, sent = _contexts(length, shards)
    dealt = bundled.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(contexts, sent)
    cover, ran = _cover(length)
    covered = dealt.groupBy("shard").applyInArrow(cover, ran)
    own = "".join(f"{c} {kind}, " for c, kind in source.dtypes if c[:2] == "__")
    spans = _spans(length, whole_characters)
    out = bundled.groupBy("bundle").cogroup(covered.groupBy("bundle")).applyInArrow(spans, f"doc_id long, {own}text binary, removed array<struct<start:int,stop:int>>, kept binary")
    none = source.where("doc_id IS NULL").select("doc_id", *(c for c in source.columns if c[:2] == "__"), "text", F.array().cast("array<struct<start:int,stop:int>>").alias("removed"), F.coalesce("text", F.lit(b"")).alias("kept"))
    kind = dict(docs.dtypes)[doc_id]
    return out.unionByName(none).select(F.col("doc_id").cast(kind).alias(doc_id), "text", *(F.col(f"__{i}").alias(c) for i, c in enumerate(rest)), "removed", "kept")
