"""Minimum-cost role repair of conversations, and their rendering.

Turns must follow a legal automaton: an optional system turn, then user and assistant in alternation, ending with the assistant. A
dynamic program over its states chooses for each turn, at least total cost: keep, relabel, merge into the turn before, or insert an
empty turn before it (and one at the end). A turn is a min-plus matrix over the four states, so a conversation may span partitions: a
first pass multiplies the matrices of the conversations at partition ends, the driver chains these (two per partition), a second pass
backtracks through them, a third repairs and renders. No conversation is ever collected in one task.

Contract of :func:`repair`
* one row per input turn, in the order of turn (nulls first), then role and text; repeated rows are turns of their own;
* roles are compared trimmed and in lower case, with aliases; null or unknown roles must be relabelled or merged;
* null text counts as empty; null conv_id is a conversation of its own; an empty table stays empty;
* ties are broken by the order of options and then states, whatever the partitions;
* concatenating ``rendered`` in order gives the conversation's text; only conv_id, turn, role, text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import shared_dir

SYSTEM, USER, ASSISTANT = 1, 2, 3
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT, "developer": SYSTEM}
KNOWN = {v: k for k, v in ROLES.items()} | ALIASES
#: Which turns may follow the start (0) and each role; costs of the edits.
LEGAL = {0: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
FAR = 1 << 50
START = [0, FAR, FAR, FAR]


def _options(state: int, role: int | None) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(next state, cost, action, roles inserted before), the preferred first."""
    out = []
    if role in LEGAL[state]:
        out.append((role, 0, "keep", ()))
    if state and role in (None, state):
        out.append((state, MERGE, "merge", ()))
    relabel = RELABEL_UNKNOWN if role is None else RELABEL
    out += [(r, relabel, "relabel", ()) for r in LEGAL[state] if r != role]
    for mid in LEGAL[state]:
        if role in LEGAL[mid]:
            out.append((role, INSERT, "keep", (mid,)))
        out += [(r, INSERT + relabel, "relabel", (mid,)) for r in LEGAL[mid] if r != role]
    return out


OPTIONS = {(s, r): _options(s, r) for s in range(4) for r in (None, *ROLES)}
END = {0: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def role_of(role: str | None) -> int | None:
    return KNOWN.get((role or "").strip().lower())


def forward(costs: list[int], roles: list[int | None], trace: bool = False) -> tuple[list[int], list]:
    """Costs after the turns, and for each turn and state (state before, option)."""
    back = []
    for role in roles:
        new, how = [FAR] * 4, [None] * 4
        for s in range(4):
            if costs[s] < FAR:
                for option in OPTIONS[s, role]:
                    if (c := costs[s] + option[1]) < new[option[0]]:
                        new[option[0]], how[option[0]] = c, (s, option)
        costs = new
        if trace:
            back.append(how)
    return costs, back


def backtrack(back: list, state: int) -> tuple[int, list]:
    out = []
    for how in reversed(back):
        state, option = how[state]
        out.append(option)
    return state, out[::-1]


def best_end(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + END[s][0], s))


def _segments(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list, list]]:
    """(partition, conversation, rows), one conversation of a partition at a time."""
    held, key, pid = [], None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("pid", "conv", *names)]
        for p, conv, *row in zip(*cols, strict=True):
            if held and conv != key:
                yield pid, key, held
                held = []
            key, pid = conv, p
            held.append(row)
    if held:
        yield pid, key, held


def repair(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted (roles put before), appended (roles put at the end), rendered."""
    shared_dir(turns.sparkSession)
    kind = turns.schema[conv_col].dataType.simpleString()
    conv = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))
    rows = turns.select(conv.alias("conv"), F.col(conv_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = ["conv", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "nth").sortWithinPartitions(*order, "nth").drop("nth").checkpoint()
    rows = rows.withColumn("pid", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for pid, key, held in _segments(batches, ["role"]):
            roles = [role_of(r) for (r,) in held]
            last = (pid, key, roles)
            first = first or last
        out = []
        for which, seg in (("first", first), ("last", last)):
            if seg:
                matrix = [c for s in range(4) for c in forward([0 if t == s else FAR for t in range(4)], seg[2])[0]]
                out.append({"pid": seg[0], "which": which, "conv": seg[1], "matrix": matrix, "whole": first is last})
        types = pa.schema([("pid", pa.int32()), ("which", pa.string()), ("conv", pa.string()), ("matrix", pa.list_(pa.int64())), ("whole", pa.bool_())])
        yield pa.RecordBatch.from_pylist(out, schema=types)

    got = rows.select("pid", "conv", "role").mapInArrow(ends, "pid int, which string, conv string, matrix array<long>, whole boolean").collect()
    by = {}
    for r in got:
        by.setdefault(r.pid, {})[r.which] = r
    pids = sorted(by)
    carry, joined = {}, {}  # costs with which a partition's first conversation begins; whether the partition before shares it
    for k, p in enumerate(pids):
        prev = pids[k - 1] if k else None
        joined[p] = prev is not None and by[prev]["last"].conv == by[p]["first"].conv
        carry[p] = START
        if joined[p]:
            came = carry[prev] if by[prev]["last"].whole else START
            m = by[prev]["last"].matrix
            carry[p] = [min(FAR, *(came[s] + m[4 * s + t] for s in range(4))) for t in range(4)]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for pid, _, held in _segments(batches, ["role"]):
            costs, back = forward(carry[pid], [role_of(r) for (r,) in held], trace=True)
            out.append({"pid": pid, "before": [backtrack(back, t)[0] if costs[t] < FAR else -1 for t in range(4)], "best": best_end(costs)})
            break
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("pid", pa.int32()), ("before", pa.list_(pa.int32())), ("best", pa.int32())]))

    chained = [p for p in pids if joined[p]]
    target: dict[int, int] = {}  # the state in which the conversation at a partition's end goes on in the next one
    if chained:
        wanted = rows.filter(F.col("pid").isin(chained)).select("pid", "conv", "role")
        found = {r.pid: r for r in wanted.mapInArrow(maps, "pid int, before array<int>, best int").collect()}
        for k in range(len(pids) - 1, 0, -1):
            p = pids[k]
            if joined[p]:
                on = k + 1 < len(pids) and joined[pids[k + 1]] and by[p]["first"].whole
                target[pids[k - 1]] = found[p].before[target[p] if on else found[p].best]
    joined_next = {pids[k]: joined[pids[k + 1]] for k in range(len(pids) - 1)}
    last_of = {p: by[p]["last"].conv for p in pids}

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for pid, key, held in _segments(batches, ["conv_id", "turn", "role", "text"]):
            came = carry[pid] if first else START
            first, out = False, []
            costs, back = forward(came, [role_of(r[2]) for r in held], trace=True)
            goes_on = joined_next.get(pid, False) and key == last_of[pid]
            state, options = backtrack(back, target[pid] if goes_on else best_end(costs))
            opened = state != 0
            for n, ((cid, turn, role, text), (after, _, action, put)) in enumerate(zip(held, options, strict=True)):
                piece = "\n" if action == "merge" else "<|end|>\n" * opened + "".join(f"<|{ROLES[x]}|>\n<|end|>\n" for x in put) + f"<|{ROLES[after]}|>\n"
                opened, more = True, []
                piece += text or ""
                if n == len(held) - 1 and not goes_on:
                    more = list(END[after][1])
                    piece += "<|end|>\n" + "".join(f"<|{ROLES[x]}|>\n<|end|>\n" for x in more)
                out.append((cid, turn, role, ROLES[after], action, ",".join(ROLES[x] for x in put), ",".join(ROLES[x] for x in more), piece))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["conv_id", "turn", "role", "new_role", "action", "inserted", "appended", "rendered"]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(turns.schema[conv_col].dataType), pa.int64(), *[pa.string()] * 6]
    schema = f"conv_id {kind}, turn long, role string, new_role string, action string, inserted string, appended string, rendered string"
    return rows.mapInArrow(mend, schema)
