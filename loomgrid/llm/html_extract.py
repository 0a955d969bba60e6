"""Main text of HTML pages by nearest-URL page differencing.

1. Each page becomes text lines, one per block, with what its markup says of them: boilerplate
   (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles), inside
   an explicit article (else the main element), or unmarked.
2. Pages are range-sorted by host and URL path, so a host of any size is spread over many tasks.
   Each page is paired with the nearest page of other lines, before or after it, of its host, whose
   path shares the longer prefix, and the two pages' lines are aligned by longest common subsequence, over 64-bit hashes of the lines.
3. Lines shared with that page are deleted, but for those inside an explicit article: articles
   repeat whole sentences across pages, and those belong to the text. Marked boilerplate goes in
   any case; it often differs from page to page.

An explicit article keeps all its lines whatever the alignment says; of all others that aren't
boilerplate, those in a main element too, the alignment decides. Only pages that have such lines
are joined with their deletions, so no page's text is shuffled in vain.

Null or empty html has empty text. Null urls share one nameless host. A copy of a page says nothing
about what belongs to its site, so pages of equal lines aren't paired but looked past. Repeated rows and
page_ids are pages of their own, told apart by a number given once and stored. Ties of two neighbours go to the one before.
An empty table gives no rows. Extra columns, whatever their names, are dropped. Pages of any length and however
broken their markup are read in one pass; aligning two pages holds at most ``_TABLE_BITS`` bits of their table.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One step within a tag: white space and slashes, then its end, or an attribute's name with what stands before its value.
_STEP = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*)?)")
_BARE = re.compile(r"[^\s>]*")

#: Fixed values of HTML: elements whose content is not text of the page, elements without content, elements that break lines.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_SKIP = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "svg", "canvas", "object", "audio", "video", "map", "search"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Words that mark boilerplate wherever they stand in a class, id or role.
_MARKS = {
    "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr",
    "popup", "navbar", "navigation", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "contentinfo", "footer", "masthead", "topbar",
    "comments", "disqus", "newsletter", "pagination", "signup",
}
#: Words that mark it only as the whole name, its last word, or with nothing but words of the third list: "form" and "user-form" do, "form-factor" doesn't.
_WHOLE = {
    "ad", "ads", "banner", "notice", "notices", "alert", "notification", "modal", "overlay", "nav", "menu", "aside", "complementary", "foot", "toolbar",
    "comment", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "subscribe", "subscription", "login",
    "search", "form", "widget", "pager", "copyright", "legal", "disclaimer", "promotion",
}
_CONTAINERS = {"area", "bar", "block", "bottom", "box", "buttons", "column", "container", "holder", "inner", "left", "links", "panel", "right", "section", "slot", "thread", "top", "unit", "wrap", "wrapper"}
#: Whole names of a site's header, those of a comment that is an article element, and beginnings of names that speak of a layout.
_HEADER_MARKS = {"header", "siteheader", "pageheader", "mainheader", "globalheader", "topheader"}
_ASIDE_ARTICLES = {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related"}
_LAYOUT = ("no-", "has-", "with-", "without-", "layout-", "is-")
_CAMEL, _PARTS, _JOINTS = re.compile(r"([a-z])([A-Z])"), re.compile(r"[-_:]+"), re.compile(r"[-_]")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)

#: What the markup says of a line; in a header inside main or article the kind is negative, and only headings count.
BOILERPLATE, UNMARKED, MAIN, ARTICLE = 0, 1, 2, 3
#: Bits of a table of two pages' lines held at once: 16 MB.
_TABLE_BITS = 1 << 27
#: Rows of a task that aligns pages.
_TASK_ROWS = 50_000


class Markup:
    """Tokens of a page in one pass, each character read a bounded number of times, however broken the page is."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.quotes = True  # False once a tag didn't end because of its quotes: later ones end at the first >

    def tag(self, at: int) -> tuple[str, dict[str, str], bool, int] | None:
        """(name, attributes, does it close itself, end) of the tag whose name starts at ``at``."""
        page = self.page
        if at > self.last[">"] or not (found := _NAME.match(page, at)):
            return None
        name, k, attributes = found[0].lower(), found.end(), {}
        while self.quotes:
            step = _STEP.match(page, k)
            if not step:
                self.quotes = False
                break
            k = step.end()
            if step[1]:
                return name, attributes, page[k - 2] == "/", k
            value = ""
            if step[0].rstrip().endswith("="):
                quote = page[k : k + 1]
                if quote in ('"', "'") and k < self.last[quote]:
                    end = page.index(quote, k + 1)
                    value, k = page[k + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, k)
                    value, k = bare[0], bare.end()
            attributes.setdefault(step[2].lower(), value)
        if found.end() > self.last[">"]:
            return None
        end = page.index(">", found.end())
        return name, attributes, page[end - 1] == "/", end + 1

    def tokens(self) -> Iterator[tuple[str, str, bool, dict[str, str], bool]]:
        """(text before, tag's name, is it an end tag, attributes, does it close itself); the last has no name."""
        page, at, n = self.page, 0, len(self.page)
        begun = 0  # of the text
        while (k := page.find("<", at)) >= 0:
            if page.startswith("<!--", k):
                end = page.find("-->", k + 2)
                at = n if end < 0 else end + 3
                yield page[begun:k], "", False, {}, False
                begun = at
                continue
            if page[k + 1 : k + 2] in ("!", "?") and k < self.last[">"]:
                at = page.index(">", k) + 1
                yield page[begun:k], "", False, {}, False
                begun = at
                continue
            closing = page.startswith("/", k + 1)
            found = self.tag(k + 1 + closing)
            if not found:
                at = k + 1
                continue
            name, attributes, alone, at = found
            yield page[begun:k], name, closing, attributes, alone
            if not closing and name in _RAW:
                end = _END_OF[name].search(page, at)
                at = n if not end or end.end() > self.last[">"] else page.index(">", end.end()) + 1
            begun = at
        yield page[begun:], "", False, {}, False


_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW}


def _marks(attributes: dict[str, str]) -> tuple[set[str], set[str], bool]:
    """(words, whole names, do they mark boilerplate) of class, id and role."""
    words: set[str] = set()
    names: set[str] = set()
    marked = False
    for name in (x for key in ("class", "id", "role") if key in attributes for x in attributes[key].split()):
        name = _CAMEL.sub(r"\1-\2", name).lower()
        if name.startswith(_LAYOUT):
            continue
        parts = [x for x in _PARTS.split(name) if x]
        whole = _JOINTS.sub("", name)
        names.add(whole)
        words |= {whole, *parts}
        kept = [x for x in parts if x not in _CONTAINERS]
        marked |= not _MARKS.isdisjoint(parts) or whole in _MARKS or whole in _WHOLE or bool(kept) and kept[-1] in _WHOLE and (len(kept) == len(parts) or len(kept) == 1)
    return words, names, marked


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(attributes.get("style", "")) is not None


def page_lines(page: str) -> list[tuple[str, int]]:
    """(line, kind) of each block with text, in page order."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, with the kind of text in them
    open_at: dict[str, list[int]] = {}  # places of each name in the stack
    kind, held_kind = UNMARKED, UNMARKED

    def flush() -> None:
        if held and (line := " ".join(html.unescape("".join(held)).split())):
            out.append((line, max(held_kind, BOILERPLATE)))
        held.clear()

    def text(t: str) -> None:
        nonlocal held_kind
        if not t:
            return
        if held and kind != held_kind:
            flush()
        held_kind = kind
        held.append(t)

    def pop(size: int) -> None:
        nonlocal kind
        while len(stack) > size:
            open_at[stack.pop()[0]].pop()
        kind = stack[-1][1] if stack else UNMARKED

    for before, name, closing, attributes, alone in Markup(page).tokens():
        text(before)
        if not name:
            continue
        if name in _BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            text(" ")
        if closing:
            if places := open_at.get(name):
                # a stray end tag closes nothing outside the nearest article, main or body
                walls = () if name in ("article", "main", "body", "html") else ("article", "main", "body")
                if all(not open_at.get(w) or open_at[w][-1] < places[-1] for w in walls):
                    pop(places[-1])
            continue
        if name in _RAW or name in _VOID or alone and name in ("svg", "path"):
            continue
        if name in _BLOCK and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)  # a block ends an open paragraph
        new = kind
        words, names, marked = _marks(attributes) if attributes else (set(), set(), False)
        if name == "main" or "main" in words and "role" in attributes:
            new = MAIN if kind != ARTICLE else kind
        elif kind < 0:
            new = -kind if name in _HEADINGS else kind
        elif kind != BOILERPLATE:
            if name == "article" or "articlebody" in names:
                new = BOILERPLATE if words & _ASIDE_ARTICLES else ARTICLE
            elif name in _SKIP or name not in ("html", "body") and marked or attributes and _hidden(attributes):
                new = BOILERPLATE
            elif name == "header" or name not in ("html", "body") and names & _HEADER_MARKS:
                new = -kind if kind in (MAIN, ARTICLE) else BOILERPLATE
        kind = new
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, kind))
    flush()
    return out


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Places:
    """Masks of the places of each line in ``b``. Only those of frequent lines are held, at most len(b) / 64 masks."""

    def __init__(self, b: list[int]):
        self.size, self.at, self.held = len(b), {}, {}
        for j, x in enumerate(b):
            self.at.setdefault(x, []).append(j)

    def __getitem__(self, x: int) -> int:
        places = self.at.get(x, ())
        if len(places) < 64:
            mask = 0
            for j in places:
                mask |= 1 << j
            return mask
        if x not in self.held:
            bits = np.zeros(self.size, np.uint8)
            bits[places] = 1
            self.held[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return self.held[x]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Rows of the bit-parallel table of ``a`` against ``b``: bit j is unset where the common subsequence grows at b[j]."""
    places = _Places(b)
    v = full = (1 << len(b)) - 1
    yield v
    for x in a:
        u = v & places[x]
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with b[:j], for each j from 0 on."""
    for last in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``: bit-parallel dynamic programming over tables of at most
    ``_TABLE_BITS`` bits; longer pages are halved first where the lengths of both halves add up to the most (Hirschberg)."""
    known = set(b)
    at = [i for i, x in enumerate(a) if x in known]
    known = {a[i] for i in at}
    return [at[i] for i in _shared([a[i] for i in at], [x for x in b if x in known])]


def _shared(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > _TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _shared(a[:half], b[:cut]) + [half + i for i in _shared(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.netloc or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def parse(pages: DataFrame, url: str, body: str) -> DataFrame:
    """``pages`` with host, path, hashes of the lines, and either the text of the explicit article or lines and kinds."""
    keep = [c for c in pages.columns if c != body]
    at = keep.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, page in zip(b.column(at).to_pylist(), b.column(len(keep)).to_pylist(), strict=True):
                lines = page_lines(page or "")
                final = not any(k in (UNMARKED, MAIN) for _, k in lines)
                text = "\n".join(t for t, k in lines if k == ARTICLE) if final else None
                rows.append((*_place(u), [line_hash(t) for t, _ in lines], text, None if final else [t for t, _ in lines], None if final else [k for _, k in lines]))
            host, path, hashes, text, lines, kinds = ([r[i] for r in rows] for i in range(6))
            made = [pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(text, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], names=[*keep, "__host", "__path", "__hashes", "__text", "__lines", "__kinds"])

    kinds = dict(pages.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "__host string, __path string, __hashes array<bigint>, __text string, __lines array<string>, __kinds array<int>"
    return pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{body}`").alias("__body")).mapInArrow(run, schema)


def _aligned(before: tuple | None, this: tuple, after: tuple | None) -> list[int]:
    """Shared lines of ``this`` = (rid, host, path, hashes) with the nearer of its neighbours."""
    near = [p for p in (before, after) if p is not None and p[1] == this[1] and p[3] != this[3]]
    if not near:
        return []
    return shared_lines(this[3], max(near, key=lambda p: _prefix(p[2], this[2]))[3])


def _nearest_outside(line: list[tuple], pid: int, side: int) -> tuple[tuple | None, tuple | None]:
    """The nearest different rows (rid, host, path, hashes) before and after the first (0) or last (1) run of a partition, from ``line`` = (pid, n, row)."""
    own = next(row for p, n, row in line if p == pid and n == 4 * side)
    other = lambda x: x[2][1] != own[1] or x[2][3] != own[3]
    before = next((x[2] for x in reversed(line) if x[:2] < (pid, 4 * side) and other(x)), None)
    after = next((x[2] for x in line if x[:2] > (pid, 1 + 4 * side) and other(x)), None)
    return before, after


def shared_with_nearest(rows: DataFrame) -> DataFrame:
    """(rid, shared) of rows (rid, host, path, hashes): the lines that the nearest different page of the host has in the same order.

    Pages of equal lines in a row are a run and have the same neighbours. For the runs at a partition's edges the driver
    finds these, from at most six rows a partition, hashes only.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _TASK_ROWS))
    ordered = rows.repartitionByRange(parts, "host", "path", "rid").sortWithinPartitions("host", "path", "rid").withColumn("pid", F.spark_partition_id())
    types = {"rid": pa.int64(), "shared": pa.list_(pa.int32()), "pid": pa.int32(), "n": pa.int32(), "host": pa.string(), "path": pa.string(), "hashes": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current: list[tuple[int, str]] = []  # (rid, path) of a run; host and hashes are the same
        host = hashes = last = pid = None
        runs = 0

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types.values())], names=list(types))
            out.clear()
            return made

        def note(n, row):
            out.append((None, None, pid, n, *row[1:]))  # a row without rid serves as a neighbour only

        def close(after):
            nonlocal last
            first, end = ((rid, host, path, hashes) for rid, path in (current[0], current[-1]))
            if runs and after:
                out.extend((rid, _aligned(last, (rid, host, path, hashes), after), *[None] * 5) for rid, path in current)
            else:
                side = 1 if runs else 0
                out.extend((rid, None, pid, side, host, path, hashes) for rid, path in current)
                note(4 * side, first)
                note(4 * side + 1, end)
                if side:
                    note(3, last)
                elif after:
                    note(2, after)
            last = end

        for b in batches:
            for rid, h, path, x, pid in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):  # noqa: B007
                if current and (h != host or x != hashes):
                    close((rid, h, path, x))
                    runs += 1
                    current = []
                if not current:
                    host, hashes = h, x
                current.append((rid, path))
            if len(out):
                yield batch()
        if current:
            close(None)
            yield batch()

    found = materialize(ordered.select("rid", "host", "path", "hashes", "pid").mapInArrow(run, "rid long, shared array<int>, pid int, n int, host string, path string, hashes array<bigint>"), "alignments")
    notes = found.where("rid IS NULL").collect()
    line = sorted(((r["pid"], r["n"], (None, r["host"], r["path"], list(r["hashes"]))) for r in notes), key=lambda x: x[:2])
    around = {(p, n // 4): _nearest_outside(line, p, n // 4) for p, n, _ in line if n in (0, 4)}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = []
            for rid, pid, side, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                before, after = around[pid, side]
                shared.append(_aligned(before, (rid, *row), after))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared, pa.list_(pa.int32()))], names=["rid", "shared"])

    edges = found.where("rid IS NOT NULL AND shared IS NULL").select("rid", "pid", "n", "host", "path", "hashes")
    return found.where("shared IS NOT NULL").select("rid", "shared").unionByName(edges.mapInArrow(solve, "rid long, shared array<int>"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", out: str = "text") -> DataFrame:
    """(page_id, url, text) of each row."""
    read = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.monotonically_increasing_id().alias("__rid"), F.col(f"`{body}`").alias("html"))
    parsed = materialize(parse(read, "url", "html"), "pages")
    shared = shared_with_nearest(parsed.select(F.col("__rid").alias("rid"), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__hashes").alias("hashes")))
    final = parsed.where(F.col("__text").isNotNull()).select("page_id", "url", F.col("__text").alias(out))
    rest = parsed.where(F.col("__text").isNull()).join(shared.withColumnRenamed("rid", "__rid"), "__rid", "left")
    marked = F.transform("__lines", lambda t, i: F.when((F.get("__kinds", i) == ARTICLE) | (F.get("__kinds", i) > BOILERPLATE) & ~F.array_contains(F.coalesce("shared", F.array().cast("array<int>")), i), t))
    text = F.coalesce(F.array_join(F.array_compact(marked), "\n"), F.lit(""))
    return final.unionByName(rest.select("page_id", "url", text.alias(out)))
