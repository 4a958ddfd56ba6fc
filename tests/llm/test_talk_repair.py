import hashlib
import random
import zlib
from itertools import groupby

import duckdb
import pyarrow as pa
import pytest

from footbridge.llm import talk_repair as T
from footbridge.llm.sql import TALK_REPAIR

SPACES = " \t\n\x0b\f\r"
NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def slow_repair(rows):
    """Every edit of a conversation's (turn, role, text), one row after another, the cheapest per state kept."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return NONE
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(paths):
        for _ in range(2):
            for state, (cost, audit, lines) in list(paths.items()):
                for x in follow[state].replace("s", ""):
                    new = (cost + 2, audit + "I", lines + (f"{names[x]}:",))
                    paths[x] = min(paths.get(x, new), new)
        return paths

    paths = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def reach(state, new, after=after):
            after[state] = min(after.get(state, new), new)

        for state, (cost, audit, lines) in paths.items():
            reach(state, (cost + 3, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            pay = cost + (fault == "t")
            if role[:1] and role[:1] in follow[state]:
                reach(role[:1], (pay, audit + "K", lines + (f"{role}:{text}",)))
            for x in follow[state].replace("s", ""):
                reach(x, (pay + 2, audit + "R", lines + (f"{names[x]}:{text}",)))
        paths = inserted(after)
    cost, audit, lines = min(paths[s] for s in ("", "a") if s in paths)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow(rows):
    key = lambda r: (r[0] is None, r[0] or 0)
    left = {k: [r[1:] for r in g] for k, g in groupby(sorted(damage(rows), key=key), key=lambda r: r[0])}
    return {c: slow_repair(left.get(c, [])) for c in {r[0] for r in rows}}


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, seg int")


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def in_duckdb(rows):
    con = duckdb.connect()
    con.register("conversations", pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}))
    cur = con.execute(TALK_REPAIR)
    at = [[d[0] for d in cur.description].index(c) for c in ("conv_id", *T.COUNTS, "audit", "repaired_sha256")]
    return {r[at[0]]: tuple(r[i] for i in at[1:]) for r in cur.fetchall()}


def some_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "Well?", "So!  ", "a. b", None, "é.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(1, 14)):
            turn += rng.choice([1, 1, 1, 0, 3])
            alike = rng.random() < 0.6
            rows.append((conv, None if rng.random() < 0.05 else turn, roles[turn % 2] if alike else rng.choice(roles), f"text {turn}." if alike else rng.choice(texts)))
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "None.")] + [(-5, 1, "user", "Same.")] * 6
    rng.shuffle(rows)
    return rows


def test_search_finds_least_audits():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c.", f"{t}!", ""])) for t in range(rng.randrange(1, 12))]
        made = T.repaired(*map(list, zip(*rows, strict=True)))
        assert (*[made[k] for k in T.COUNTS], made["audit"], made["repaired_sha256"]) == slow_repair(rows)


@pytest.mark.parametrize("segment", [512, 3])
def test_against_plain_code_and_sql(spark, monkeypatch, segment):
    monkeypatch.setattr(T, "SEGMENT_ROWS", segment)
    rows = some_rows(segment, 120)
    want = slow(rows)
    assert in_duckdb(rows) == want
    assert got(T.repair(talks(spark, rows))) == want
    assert got(T.repair(talks(spark, rows * 2))) == slow(rows * 2)


def test_one_long_conversation_spreads_over_tasks(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"said {t % 900}" + "." * (t % 5 > 0)) for t in range(6000)] + some_rows(1, 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = T.cut(T.segments(T.damaged(talks(spark, rows)))).where("conv_id = 7 and seg is not null").selectExpr("shiftright(seg, 32) task", "size(turns) n").collect()
        assert len({r.task for r in made}) > 3 and max(r.n for r in made) <= T.SEGMENT_ROWS
        assert got(T.repair(talks(spark, rows))) == slow(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_and_wholly_dropped(spark):
    assert got(T.repair(talks(spark, []))) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert got(T.repair(talks(spark, [(dropped, 1, "user", "Hi.")]))) == {dropped: NONE}


def test_very_long_texts(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t} " + "long text " * 300_000 + ".") for t in range(1, 7)]
    assert got(T.repair(talks(spark, rows))) == slow(rows)
