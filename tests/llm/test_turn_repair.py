"""Conversation repair against its SQL, which compares whole audit strings, and against all audits of short rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from paytrail.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, c string, n string, g string"
TEXTS = ["Fine.", "Fine. ", "no end", "", " \t\x0b\n", None, "What?!", "nbsp ", "Ä!\n", "a\nb", "...", "line.\n\ttail"]
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "Assistant", "usher"]


def rows_of(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randint(1, most)):
            turn = rng.choice([t, t, t, t, t + rng.randint(0, 3), None, -t])
            rows += [(c, turn, rng.choice(ROLES), rng.choice(TEXTS))] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"block_rows": 4}), (3, {"block_rows": 1, "block_bytes": 10})])
def test_against_sql(spark, seed, sizes):
    rows = rows_of(seed, 120, 12)
    got = turn_repair.repair_conversations(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), **sizes)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(con.sql(turn_repair.ORACLE).fetchall(), key=key)


def cheapest(rows):
    """(cost, audit, lines) over every choice of edits with up to two inserts in each gap."""
    found, n, seen, must = [], len(rows), set(), []
    for role, text in rows:
        must.append(not re.search(r"[^\x20\x09-\x0D]", text) or (role, text) in seen)
        seen.add((role, text))
    for edits in itertools.product("DKR", repeat=n):
        if any(m and e != "D" for m, e in zip(must, edits, strict=True)):
            continue
        for runs in itertools.product(range(3), repeat=n + 1):
            lines, cost, roles = [], 3 * sum(runs), ""
            for (role, text), run, e in [*zip(rows, runs, edits, strict=False), (("", ""), runs[-1], "")]:
                for _ in range(run):
                    roles += "a" if roles.endswith("u") else "u"
                    lines.append({"a": "assistant:", "u": "user:"}[roles[-1]])
                if e == "D":
                    cost += 4
                elif e:
                    name = role if e == "K" else "assistant" if roles.endswith("u") else "user"
                    cost += 3 * (e == "R") + 3 * (not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text))
                    roles, lines = roles + (name[:1] or "-"), [*lines, f"{name}:{text}"]
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, "".join("I" * r + e for r, e in zip(runs, [*edits, ""], strict=True)), "\n".join(lines)))
    return min(found)


def test_against_all_audits(spark):
    rng = random.Random(9)
    convs = {c: [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", "", "So!"])) for _ in range(rng.randint(0, 4))] for c in range(40)}
    flat = [(c, i, r, t, "", "", "") for c, rows in convs.items() for i, (r, t) in enumerate(rows)]
    frame = turn_repair.as_rows(spark.createDataFrame(flat, SCHEMA))
    for sizes in ({}, {"block_rows": 2}):
        got = {r.c: r for r in turn_repair.repair(frame, **sizes).collect()}
        assert set(got) == {c for c, rows in convs.items() if rows}
        for c, r in got.items():
            cost, audit, text = cheapest(convs[c])
            assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), convs[c]
            assert r.repaired in (text, None) and (sizes or r.repaired is not None)


def test_one_conversation_with_most_rows_and_a_repeated_row(spark):
    rng = random.Random(5)
    rows = [(7, i // 2, ("user", "assistant")[i % 2], rng.choice(["Same.", f"Text {i}.", f"cut {i}"])) for i in range(3000)] + [(7, 3, "user", "again and again.")] * 2000 + [(8, 0, "user", "Hi."), (9, None, None, None)]
    frame = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    one = {r.conv_id: r for r in turn_repair.repair_conversations(frame).collect()}
    split = {r.conv_id: r for r in turn_repair.repair_conversations(frame, block_rows=300).collect()}
    assert one == split and one[7].duplicate >= 1900 and len(one[7].audit) >= 4500


def test_empty_long_and_dropped(spark):
    assert turn_repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = [i for i in range(400) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0]
    kept = next(i for i in range(400) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 > 4)
    rows = [(i, 0, "user", "Hello.") for i in gone] + [(kept, 0, "user", "long " * 400_000 + ".")]
    got = {r.conv_id: r for r in turn_repair.repair_conversations(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA), block_bytes=1_000_000).collect()}
    for i in gone:
        assert tuple(got[i])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[kept].cost, got[kept].audit) == (3, "KI")
    assert got[kept].repaired_sha256 == hashlib.sha256(("user:" + "long " * 400_000 + ".\nassistant:").encode()).hexdigest()
