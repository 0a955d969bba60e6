"""Chat formatting: role sequences repaired at least cost, then rendered.

An automaton says which turns are legal: an optional system turn first, then user and assistant in
turn, an assistant last. Each turn is kept, relabelled, or merged into the turn before it, and empty
turns may be inserted; dynamic programming finds the cheapest way through the automaton.

A conversation may hold any number of turns: rows are range-sorted by conversation and turn, and a
conversation may span partitions. Reading a partition backwards, each turn gets the best next state
for each state before it, from the cost of what follows; reading it forwards, the states are walked.
Both passes stream, carrying four numbers or one state; what they know of the partitions behind and
before them are matrices (min and plus) and maps of four states of the partitions' first and last
conversations, at most two a partition, which the driver multiplies. To find these a pass over the
roles alone holds a byte a turn. Texts pass through and are put together by Spark.

Of equal costs each turn takes the lowest state, the first turn first, so the result doesn't depend on
the partitions.

Each input turn returns its piece of the rendering; a conversation is its pieces in the order of
(turn, role, text). Null texts are empty, null or unknown roles are relabelled, rows with a null
conversation are one conversation, null turns come first, repeated rows are turns of their own. Very
long texts and conversations are treated like others, an empty table gives no rows, and other columns,
whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgrid.llm.common import shared_dir

#: States: nothing yet, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Other names of the roles.
_ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
#: Costs of a merge, a relabelling of a known and of an unknown role, and an empty turn.
MERGE, RELABEL, UNKNOWN, INSERT = 2, 5, 1, 4
_FAR = 1 << 60
#: Bytes of text of a partition.
PART_BYTES = 64 << 20


def _steps() -> list[list[list[tuple[int, tuple[int, ...], int, bool]]]]:
    """For each role (0: unknown) and states s, t: cheapest (cost, states of inserted turns, state of this turn, merged)."""
    paths = {s: [((), s)] for s in _NEXT}
    for s in _NEXT:
        for a in _NEXT[s]:
            paths[s].append(((a,), a))
            paths[s] += [((a, b), b) for b in _NEXT[a]]
    table = []
    for role in range(4):
        rows = []
        for s in _NEXT:
            best = [(_FAR, (), 0, False)] * 4
            options = []
            if s != START:
                options.append((s, (MERGE + (0 if role == s else UNKNOWN if not role else RELABEL), (), s, True)))
            for inserted, at in paths[s]:
                for t in _NEXT[at]:
                    options.append((t, (INSERT * len(inserted) + (0 if role == t else UNKNOWN if not role else RELABEL), inserted, t, False)))
            for t, o in sorted(options, key=lambda x: (x[1][0], x[1][3], len(x[1][1]))):
                if o[0] < best[t][0]:
                    best[t] = o
            rows.append(best)
        table.append(rows)
    return table


STEPS = _steps()
#: Empty turns that end a conversation in each state, and what they cost.
_ENDS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END_COSTS = tuple(INSERT * len(_ENDS[s]) for s in range(4))


def role_of(name: str | None) -> int:
    return _ROLES.get((name or "").strip().lower(), 0)


@lru_cache(1 << 16)
def _decided(role: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    best = [min((STEPS[role][s][t][0] + behind[t], t) for t in range(4)) for s in range(4)]
    return tuple(c for c, _ in best), tuple(t for _, t in best)


def decided(role: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(least cost from each state before a turn, its next state) from the costs behind the turn; of equal ones the lowest state."""
    low = min(behind)  # less the lowest cost few different vectors occur, whatever the length
    costs, states = _decided(role, tuple(min(c - low, _FAR) for c in behind))
    return tuple(min(c + low, _FAR) for c in costs), states


def solve(roles: list[int]) -> list[int]:
    """States after each turn of a whole conversation."""
    behind, maps, path = END_COSTS, [], [START]
    for r in reversed(roles):
        behind, states = decided(r, behind)
        maps.append(states)
    for m in reversed(maps):
        path.append(m[path[-1]])
    return path[1:]


def _through(roles: bytes, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(least cost from each state before the turns, the state behind them that it leads to)."""
    reached = tuple(range(4))
    for r in reversed(roles):
        behind, states = decided(r, behind)
        reached = tuple(reached[t] for t in states)
    return behind, reached


def _matrix(roles: bytes) -> list[int]:
    """Least cost from each state to each state, row by row."""
    columns = [_through(roles, tuple(0 if s == t else _FAR for s in range(4)))[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, bytearray]]:
    """(conversation, partition, roles) of each run of (conv, role, n)."""
    held = None
    for b in batches:
        for conv, role, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if held is None or conv != held[0]:
                if held is not None:
                    yield held
                held = (conv, n >> 33, bytearray())
            held[2].append(role_of(role))
    if held is not None:
        yield held


def _edges(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of a partition: conversation and matrix of its first and last run."""
    first = last = None
    count = 0
    for last in _runs(batches):
        first = first or last
        count += 1
    if count:
        ends = [first, last]
        yield pa.RecordBatch.from_arrays([pa.array([first[1]]), pa.array([count]), *(pa.array([x[0]], kind) for x in ends), *(pa.array([_matrix(x[2])], pa.list_(pa.int64())) for x in ends)], names=["pid", "runs", "first", "last", "first_matrix", "last_matrix"])


def _before(matrix: list[int], behind: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(min(matrix[4 * s + t] + behind[t] for t in range(4)), _FAR) for s in range(4))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, new_role, action, inserted, cost, rendered) of each row.

    action: keep, relabel, merge; inserted: empty turns put before this one (and, for a conversation's last row, behind it).
    """
    spark = turns.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    named = turns.select(*(F.col(f"`{c}`").alias(n) for c, n in ((conv_id, "conv"), (turn, "turn"), (role, "role"), (text, "text"))))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ordered = named.repartitionByRange(parts, "conv", "turn").sortWithinPartitions("conv", "turn", "role", "text").withColumn("n", F.monotonically_increasing_id())
    held = ordered.checkpoint()  # the passes below see the same partitions in the same order
    kinds = dict(named.dtypes)
    kind = to_arrow_type(named.schema["conv"].dataType)
    roles = held.select("conv", "role", "n")

    known = roles.mapInArrow(lambda b: _edges(b, kind), f"pid long, runs long, first {kinds['conv']}, last {kinds['conv']}, first_matrix array<bigint>, last_matrix array<bigint>").collect()
    known.sort(key=lambda r: r["pid"])
    # partitions that continue the conversation before them
    joined = [i > 0 and known[i - 1]["last"] == r["first"] for i, r in enumerate(known)] + [False]
    behind: dict[int, tuple[int, ...]] = {}  # costs behind a partition's last run
    for i in range(len(known) - 1, -1, -1):
        behind[known[i]["pid"]] = END_COSTS
        if joined[i + 1]:
            after = known[i + 1]
            behind[known[i]["pid"]] = _before(after["first_matrix"], behind[after["pid"]] if after["runs"] == 1 else END_COSTS)
    goes_on = {r["pid"] for i, r in enumerate(known) if joined[i + 1]}

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition: where its last run leads from each state."""
        last = None
        for last in _runs(batches):  # noqa: B007
            pass
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([last[1]]), pa.array([_through(last[2], behind[last[1]])[1]], pa.list_(pa.int32()))], names=["pid", "reached"])

    start = {r["pid"]: START for r in known}
    if any(joined):
        reached = {r["pid"]: r["reached"] for r in roles.mapInArrow(lead, "pid long, reached array<int>").collect()}
        for i in range(1, len(known)):
            if joined[i]:
                one = known[i - 1]
                start[known[i]["pid"]] = reached[one["pid"]][start[one["pid"]] if one["runs"] == 1 else START]

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = conv = None
        for b in batches:
            maps, last = np.zeros(b.num_rows, np.int16), np.zeros(b.num_rows, bool)
            for k, (c, name, n) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if costs is None or c != conv:
                    costs, last[k] = (behind[n >> 33], n >> 33 not in goes_on) if costs is None else (END_COSTS, True)
                    conv = c
                costs, states = decided(role_of(name), costs)
                maps[k] = states[0] | states[1] << 2 | states[2] << 4 | states[3] << 6
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maps), pa.array(last)], names=[*b.schema.names, "maps", "last"])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = conv = None
        for b in batches:
            made = []
            for c, name, n, m, last in zip(*(b.column(k).to_pylist() for k in (0, 2, 4, 5, 6)), strict=True):
                if state is None or c != conv:
                    state, conv = start[n >> 33] if state is None else START, c
                after = m >> 2 * state & 3
                made.append(_piece(role_of(name), state, after, last))
                state = after
            new, action, inserted, cost, head, tail = zip(*made, strict=True) if made else ([],) * 6
            columns = [pa.array(new, pa.string()), pa.array(action, pa.string()), pa.array(inserted, pa.int32()), pa.array(cost, pa.int32()), pa.array(head, pa.string()), pa.array(tail, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *columns], names=["conv", "turn", "role", "text", "new_role", "action", "inserted", "cost", "head", "tail"])

    own = f"conv {kinds['conv']}, turn {kinds['turn']}, role string, text string"
    mapped = held.sortWithinPartitions(F.desc("n")).mapInArrow(backwards, f"{own}, n long, maps smallint, last boolean")
    walked = mapped.sortWithinPartitions("n").mapInArrow(forwards, f"{own}, new_role string, action string, inserted int, cost int, head string, tail string")
    return walked.select(F.col("conv").alias("conv_id"), "turn", "role", "new_role", "action", "inserted", "cost", F.concat("head", F.coalesce("text", F.lit("")), "tail").alias("rendered"))


@lru_cache
def _piece(role: int, before: int, after: int, last: bool) -> tuple[str, str, int, int, str, str]:
    """(new role, action, turns inserted, cost, rendering before and behind the text) of a turn."""
    cost, put, state, merged = STEPS[role][before][after]
    head = "\n" if merged else "<|im_end|>\n" if before != START else ""
    empty = lambda turns: "".join(f"<|im_start|>{NAMES[x]}\n<|im_end|>\n" for x in turns)
    head += empty(put) + ("" if merged else f"<|im_start|>{NAMES[state]}\n")
    tail, ending = "", _ENDS[state] if last else ()
    if last:
        tail = "<|im_end|>\n" + empty(ending)
    return NAMES[state], "merge" if merged else "keep" if role == state else "relabel", len(put) + len(ending), cost + INSERT * len(ending), head, tail


def repair_sql() -> str:
    """The same rows in DuckDB SQL, for ``conversations``: costs to go by recursion backwards, states by recursion forwards."""
    names = ", ".join(f"('{name}', {code})" for name, code in _ROLES.items())
    costs = ", ".join(f"({r}, {s}, {', '.join(str(min(STEPS[r][s][t][0], 10**9)) for t in range(4))})" for r in range(4) for s in range(4))
    quoted = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    pieces = ", ".join(
        f"({r}, {s}, {t}, {last}, '{p[0]}', '{p[1]}', {p[2]}, {p[3]}, {quoted(p[4])}, {quoted(p[5])})"
        for r in range(4) for s in range(4) for t in range(4) if STEPS[r][s][t][0] < _FAR for last in (False, True) for p in (_piece(r, s, t, last),)
    )
    least = lambda s: f"least({', '.join(f'm{s}.m{t} + g.c{t}' for t in range(4))})"
    joins = " ".join(f"JOIN costs m{s} ON m{s}.r = x.r AND m{s}.s = {s}" for s in range(4))
    return f"""
    WITH RECURSIVE names(name, code) AS (VALUES {names}), costs(r, s, m0, m1, m2, m3) AS (VALUES {costs}),
    pieces(r, s, t, last, new_role, action, inserted, cost, head, tail) AS (VALUES {pieces}),
    x AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) conv, conv_id, turn, role, text, coalesce(names.code, 0) r,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) k, count(*) OVER (PARTITION BY conv_id) n
        FROM conversations LEFT JOIN names ON names.name = lower(trim(role))),
    g(conv, k, c0, c1, c2, c3) AS (
        SELECT DISTINCT conv, n, {', '.join(map(str, END_COSTS))} FROM x
        UNION ALL SELECT g.conv, g.k - 1, {', '.join(map(least, range(4)))} FROM g JOIN x ON x.conv = g.conv AND x.k = g.k {joins}),
    v AS (SELECT x.conv, x.k, m.s, m.m0 + g.c0 v0, m.m1 + g.c1 v1, m.m2 + g.c2 v2, m.m3 + g.c3 v3 FROM x JOIN g ON g.conv = x.conv AND g.k = x.k JOIN costs m ON m.r = x.r),
    best AS (SELECT conv, k, s, CASE WHEN v0 <= least(v1, v2, v3) THEN 0 WHEN v1 <= least(v2, v3) THEN 1 WHEN v2 <= v3 THEN 2 ELSE 3 END t FROM v),
    path(conv, k, s, t) AS (
        SELECT conv, k, s, t FROM best WHERE k = 1 AND s = 0
        UNION ALL SELECT best.conv, best.k, best.s, best.t FROM path JOIN best ON best.conv = path.conv AND best.k = path.k + 1 AND best.s = path.t)
    SELECT x.conv_id, x.turn, x.role, p.new_role, p.action, cast(p.inserted AS int) inserted, cast(p.cost AS int) AS "cost", p.head || coalesce(x.text, '') || p.tail rendered
    FROM x JOIN path ON path.conv = x.conv AND path.k = x.k JOIN pieces p ON p.r = x.r AND p.s = path.s AND p.t = path.t AND p.last = (x.k = x.n)"""
