"""Conversation structure repair by bidirectional Dijkstra search over the edit lattice.

A node of the lattice is (rows passed, state); the state is where the role initials written so far stand in
``(s?(ua)+)?``. Keep, Rerole and Delete pass a row, Insert stays. The search runs from both ends with a heap each, until
no unfinished path can cost as little as the best crossing; it then looks at all crossings of that cost and takes the
least concatenated audit. Paths of equal cost between the same two nodes never have audits of which one begins the
other, as they pass the same rows and inserts cost, so least prefixes and least suffixes make least audits. Ties within a
heap go by rows passed, since only edges that pass a row are free.

Rows are sorted over all partitions by conversation and turn, so a long conversation is spread over as many as it needs.
A task reads its rows as they come and cuts them into segments. A conversation that lies within a task and a segment is
repaired there. Segments of others are solved apart, in parallel, for each state to begin and to end in; the same search
over the segments as one step each then finds the whole repair, and each segment gets its part of the audit. Rows seen
earlier in another segment are told by a grouped minimum over digests. The text of a repaired conversation is hashed as it
streams by, in order. What one task holds at once is a segment's rows, or the audits of one conversation.

Defined results: nulls count as one space. Rows of equal turn go by role and text, null turns first. A row whose role is
empty has no initial and can't be kept. Repeated rows are duplicates. A null conv_id is a conversation. A conversation
without rows gets zeros and the hash of an empty string. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from footbridge.llm.columns import pruned
from footbridge.session import cut

BLANKS = " \t\n\x0b\f\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last role initial was
DONE = (START, ASSISTANT)
BY_INITIAL = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# where Rerole and Insert lead: the one role that may come next
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3  # faults
SEGMENT_ROWS = 512
SEGMENT_CHARS = 4_000_000  # of text, at least one row

Edge = tuple[int, int, int, str]  # rows passed, state, cost, letters
Edges = Callable[[int, int], list[Edge]]


class Side:
    """One of the two searches. Labels are least (cost, audit); ``rank`` orders nodes of equal cost."""

    def __init__(self, nodes: list[tuple[int, int]], edges: Edges, rank: Callable[[int], int], join: Callable[[str, str], str]):
        self.label = {node: (0, "") for node in nodes}
        self.heap = [(0, rank(i), i, q) for i, q in nodes]
        self.settled: set[tuple[int, int]] = set()
        self.edges, self.rank, self.join = edges, rank, join
        heapq.heapify(self.heap)

    def settle(self) -> list[tuple[int, int]]:
        """Finish the cheapest open node; the nodes that got or kept a label by it."""
        cost, _, i, q = heapq.heappop(self.heap)
        node = i, q
        if node in self.settled:
            return []
        self.settled.add(node)
        audit, label, reached = self.label[node][1], self.label, [node]
        for j, to, c, letters in self.edges(i, q):
            new, old = (cost + c, self.join(audit, letters)), label.get((j, to))
            if old is None or new < old:
                label[j, to] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(self.heap, (new[0], self.rank(j), j, to))
            reached.append((j, to))
        return reached


def cheapest(n: int, out: Edges, into: Edges, starts: tuple[int, ...], goals: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, audit) from (0, a start) to (n, a goal).

    ``out`` of (rows passed, state) lists the edges that leave a node, ``into`` those that enter it."""
    ahead = Side([(0, q) for q in starts], out, lambda i: i, lambda audit, letters: audit + letters)
    back = Side([(n, q) for q in goals], into, lambda i: n - i, lambda audit, letters: letters + audit)
    best = None
    while ahead.heap and back.heap and (best is None or ahead.heap[0][0] + back.heap[0][0] <= best):
        one, other = (ahead, back) if ahead.heap[0][0] <= back.heap[0][0] else (back, ahead)
        for node in one.settle():
            if node in other.label:
                total = one.label[node][0] + other.label[node][0]
                best = total if best is None else min(best, total)
    if best is None:
        return None
    # every cheapest path has an edge, or its last node, between what one side has settled and what the other has
    audits = []
    for node in ahead.settled:
        cost, audit = ahead.label[node]
        for j, q, c, letters in [(*node, 0, ""), *out(*node)]:
            rest = back.label.get((j, q))
            if rest and cost + c + rest[0] == best:
                audits.append(audit + letters + rest[1])
    for node in back.settled & ahead.label.keys():
        if ahead.label[node][0] + back.label[node][0] == best:
            audits.append(ahead.label[node][1] + back.label[node][1])
    return best, min(audits)


@cache
def passing(initial: str, fault: int) -> tuple[dict[int, list[tuple[int, int, str]]], dict[int, list[tuple[int, int, str]]]]:
    """How a row may be passed: (other state, cost, letter) by the state before it, and by the state after it."""
    ways = [(q, q, DELETE, "D") for q in range(4)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT_SHORT else 0
        ways += [(q, to, extra, "K") for q, to in BY_INITIAL.get(initial, {}).items()]
        ways += [(q, to, REROLE + extra, "R") for q, to in NEXT.items()]
    return {s: [(to, c, x) for q, to, c, x in ways if q == s] for s in range(4)}, {s: [(q, c, x) for q, to, c, x in ways if to == s] for s in range(4)}


INSERTED = {q: [a for a, to in NEXT.items() if to == q] for q in range(4)}


def row_edges(rows: list[tuple[str, int]]) -> tuple[Edges, Edges]:
    """The lattice over rows (role initial, fault)."""
    n = len(rows)

    def out(i: int, state: int) -> list[Edge]:
        edges = [(i, NEXT[state], INSERT, "I")]
        return edges + [(i + 1, to, c, x) for to, c, x in passing(*rows[i])[0][state]] if i < n else edges

    def into(i: int, state: int) -> list[Edge]:
        edges = [(i, q, INSERT, "I") for q in INSERTED[state]]
        return edges + [(i - 1, q, c, x) for q, c, x in passing(*rows[i - 1])[1][state]] if i else edges

    return out, into


def step_edges(steps: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[Edges, Edges]:
    """The lattice over segments, each solved from state to state."""

    def out(i: int, state: int) -> list[Edge]:
        return [(i + 1, to, *label) for (q, to), label in steps[i].items() if q == state] if i < len(steps) else []

    def into(i: int, state: int) -> list[Edge]:
        return [(i - 1, q, *label) for (q, to), label in steps[i - 1].items() if to == state] if i else []

    return out, into


def replay(roles: list[str], texts: list[str], audit: str, state: int) -> list[str]:
    """The repaired ``role:text`` lines that an audit makes from a state on."""
    lines, i = [], 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:")
            continue
        if letter == "K":
            state = BY_INITIAL[roles[i][:1]][state]
            lines.append(f"{roles[i]}:{texts[i]}")
        elif letter == "R":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:{texts[i]}")
        i += 1
    return lines


def shares(audit: str, initials: list[list[str]]) -> list[tuple[int, str]]:
    """The state in which each segment begins and its part of an audit; an insert between segments goes to the later."""
    made, at, state = [], 0, START
    for k, own in enumerate(initials):
        begin, first, i = state, at, 0
        while at < len(audit) and (i < len(own) or k == len(initials) - 1):
            letter = audit[at]
            at += 1
            if letter in "IR":
                state = NEXT[state]
            elif letter == "K":
                state = BY_INITIAL[own[i]][state]
            i += letter != "I"
        made.append((begin, audit[first:at]))
    return made


def own_fault(text: str) -> int:
    """The fault that a row's text alone shows."""
    text = text.rstrip(BLANKS)
    return BLANK if not text else 0 if text[-1] in ENDS else CUT_SHORT


def count_rows(turns: list[int | None], roles: list[str], faults: list[int]) -> dict:
    """What a segment's rows add to the counts, with its ends."""
    real = [t for t in turns if t is not None]
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_SHORT),
        "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False)),
        "first_role": roles[0][:1], "last_role": roles[-1][:1],
        "low": real[0] if real else None, "high": real[-1] if real else None, "turns": len(set(real)),
    }


def add_counts(parts: list[dict]) -> dict:
    """Counts of a conversation from those of its segments in order."""
    got = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    got["illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    real = [p for p in parts if p["turns"]]
    turns = sum(p["turns"] for p in real) - sum(a["high"] == b["low"] for a, b in zip(real, real[1:], strict=False))
    return got | {"gaps": real[-1]["high"] - real[0]["low"] + 1 - turns if real else 0}


def repaired(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """The result of a conversation whose rows are all here."""
    faults, seen = [], set()
    for row in zip(roles, texts, strict=True):
        fault = own_fault(row[1])
        faults.append(DUPLICATE if row in seen and fault != BLANK else fault)
        seen.add(row)
    cost, audit = cheapest(len(roles), *row_edges([(r[:1], f) for r, f in zip(roles, faults, strict=True)]), (START,), DONE)
    text = "\n".join(replay(roles, texts, audit, START))
    return add_counts([count_rows(turns, roles, faults)]) | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def damaged(talks: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) after damage."""
    slim = pruned(talks, "conv_id", "turn", "role", "text").fillna(" ", ["role", "text"])
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = slim.withColumn("kind", F.crc32(named.cast("binary")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("kind")).drop("kind")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
ROWS = "seg long, turns array<long>, roles array<string>, texts array<string>"
ENDS_OF = "first_role string, last_role string, low long, high long, turns long"


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def segments(rows: DataFrame) -> DataFrame:
    """One row, with its result, for every conversation that a task could repair alone, and one for each segment of the
    others, with its rows and ``seg`` in ascending order."""
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT}, {ROWS}"
    schema = arrow(ddl)
    # the place of a row among its copies decides nothing; it lets copies be spread over partitions
    order = ["conv_id", "turn", "role", "text", "copy"]
    ranged = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        ready: list[dict] = []
        size, chars, first, whole, key, held = 0, 0, True, True, None, ([], [], [])

        def close(alone: bool) -> None:
            nonlocal seg, size
            turns, roles, texts = held
            if alone:
                ready.append({"conv_id": key} | repaired(turns, roles, texts))
            elif turns:
                ready.append({"conv_id": key, "seg": seg, "turns": turns, "roles": roles, "texts": texts})
                seg += 1
                size += chars

        for batch in batches:
            for conv, *row in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held[0] and conv != key:
                    # a task's first conversation may have begun in the task before
                    close(alone=whole and not first)
                    held, chars, first, whole = ([], [], []), 0, False, True
                elif len(held[0]) >= SEGMENT_ROWS or (held[0] and chars + len(row[2]) > SEGMENT_CHARS):
                    close(alone=False)
                    held, chars, whole = ([], [], []), 0, False
                key = conv
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                chars += len(row[2])
                if len(ready) >= 256 or size > SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(ready, schema=schema)
                    ready.clear()
                    size = 0
        close(alone=False)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)

    return ranged.select("conv_id", "turn", "role", "text").mapInArrow(run, ddl)


def solved(parts: DataFrame) -> DataFrame:
    """conv_id, seg, the initials, counts and labels (least cost and audit from state to state) of every segment."""
    # of each (role, text) of a conversation the first row; all its other rows were seen earlier
    each = parts.select("conv_id", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    key = F.sha2(F.concat_ws(":", F.length("row.roles"), F.concat("row.roles", "row.texts")), 256)
    firsts = each.groupBy("conv_id", key.alias("key")).agg(F.min(F.struct("seg", "at")).alias("f"))
    firsts = firsts.groupBy(F.col("f.seg").alias("seg")).agg(F.collect_list("f.at").alias("firsts"))
    ddl = (
        f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, seg long, initials array<string>, "
        f"counts struct<blank:long,duplicate:long,truncated:long,illegal:long,{ENDS_OF.replace(' ', ':').replace(',:', ',')}>, "
        "labels array<struct<a:int,b:int,cost:long,audit:string>>"
    )
    schema = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                firsts, faults = set(r["firsts"] or ()), []
                for at, text in enumerate(r["texts"]):
                    fault = own_fault(text)
                    faults.append(DUPLICATE if at not in firsts and fault != BLANK else fault)
                initials = [x[:1] for x in r["roles"]]
                edges = row_edges(list(zip(initials, faults, strict=True)))
                pairs = [(a, b, cheapest(len(faults), *edges, (a,), (b,))) for a in range(4) for b in range(4)]
                labels = [{"a": a, "b": b, "cost": x[0], "audit": x[1]} for a, b, x in pairs if x]
                row = {"conv_id": r["conv_id"], "seg": r["seg"], "initials": initials, "counts": count_rows(r["turns"], r["roles"], faults), "labels": labels}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return parts.join(firsts, "seg", "left").select("conv_id", "seg", "turns", "roles", "texts", "firsts").mapInArrow(run, ddl)


def combined(steps: DataFrame) -> DataFrame:
    """For every segment the state in which it begins and its part of the audit; the result too in the last row of each
    conversation."""
    ddl = f"conv_id {steps.schema['conv_id'].dataType.simpleString()}, seg long, state int, share string, {', '.join(f'{c} long' for c in COUNTS)}, audit string"
    schema = arrow(ddl)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
        labels = [{(x["a"], x["b"]): (x["cost"], x["audit"]) for x in r["labels"]} for r in rows]
        cost, audit = cheapest(len(rows), *step_edges(labels), (START,), DONE)
        parts = shares(audit, [r["initials"] for r in rows])
        made = [{"conv_id": r["conv_id"], "seg": r["seg"], "state": q, "share": share} for r, (q, share) in zip(rows, parts, strict=True)]
        made[-1] |= add_counts([r["counts"] for r in rows]) | {"cost": cost, "audit": audit}
        return pa.Table.from_pylist(made, schema=schema)

    return steps.groupBy("conv_id").applyInArrow(run, ddl)


def hashed(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id and the hash of the repaired text, whose segments stream by in order."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    lines_ddl, ddl = f"conv_id {kind}, seg long, lines long, text string", f"conv_id {kind}, repaired_sha256 string"
    lines_schema, schema = arrow(lines_ddl), arrow(ddl)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                lines = replay(r["roles"], r["texts"], r["share"], r["state"])
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "seg": r["seg"], "lines": len(lines), "text": "\n".join(lines)}], schema=lines_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, lines, begun = None, None, 0, False
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                if begun and r["conv_id"] != key:
                    yield pa.RecordBatch.from_pylist([{"conv_id": key, "repaired_sha256": state.hexdigest()}], schema=schema)
                if not begun or r["conv_id"] != key:
                    key, state, lines, begun = r["conv_id"], hashlib.sha256(), 0, True
                if r["lines"]:
                    state.update((("\n" if lines else "") + r["text"]).encode())
                    lines += r["lines"]
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "repaired_sha256": state.hexdigest()}], schema=schema)

    texts = parts.select("seg", "roles", "texts").join(plan.select("conv_id", "seg", "state", "share"), "seg").mapInArrow(write, lines_ddl)
    return texts.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(digest, ddl)


def repair(talks: DataFrame) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 of every conversation after damage."""
    made = cut(segments(damaged(talks)))
    parts = made.where("seg is not null").select("conv_id", "seg", "turns", "roles", "texts")
    plan = cut(combined(cut(solved(parts))))
    alone = made.where("seg is null").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    ends, texts = plan.where("audit is not null").alias("p"), hashed(parts, plan).alias("h")
    rest = ends.join(texts, F.col("p.conv_id").eqNullSafe(F.col("h.conv_id"))).select("p.conv_id", *COUNTS, "audit", "repaired_sha256")
    every, found = pruned(talks, "conv_id").distinct().alias("t"), alone.unionByName(rest).alias("r")
    whole = every.join(found, F.col("t.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    none = {c: F.lit(0).cast("long") for c in COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return whole.select("t.conv_id", *[F.coalesce(F.col(f"r.{c}"), x).alias(c) for c, x in none.items()])
