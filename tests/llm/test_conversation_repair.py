"""Operator 13 against every audit there is, and DuckDB on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb

from docloom.llm import conversation_repair as repair

TURNS = "conv_id long, turn long, role string, text string, conv string, audit string, n int, digest string"


def all_audits(rows):
    """The cost of every audit with at most two insertions in a row, by brute force."""
    gaps = ["", "I", "II"]
    for edits in product("DKR", repeat=len(rows)):
        for runs in product(gaps, repeat=len(rows) + 1):
            roles, cost, legal = "", 0, True
            for run, edit, (initial, fault) in zip(runs, [*edits, ""], [*rows, ("", "")], strict=True):
                for _ in run:
                    roles += "a" if roles[-1:] == "u" else "u"
                cost += 3 * len(run)
                if edit in ("K", "R"):
                    legal &= fault not in ("blank", "duplicate")
                    roles += initial if edit == "K" else "a" if roles[-1:] == "u" else "u"
                    cost += 3 * (edit == "R") + 3 * (fault == "truncated")
                    legal &= bool(initial) or edit == "R"
                cost += 4 * (edit == "D")
            if legal and re.fullmatch("(s?(ua)+)?", roles):
                yield cost, "".join(r + e for r, e in zip(runs, [*edits, ""], strict=True))


def test_ranks_find_the_least_audit():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "u", "a", ""]), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 4))]
        programme = repair.Audit()
        for row in rows:
            programme.row(*row)
        assert programme.end() == min(all_audits(rows)), rows


def test_long_conversations_cost_what_their_audit_says():
    rng, programme = random.Random(6), repair.Audit()
    rows = [(rng.choice("sua"), rng.choice(["", "", "truncated", "blank"])) for _ in range(5000)]
    for row in rows:
        programme.row(*row)
    cost, audit = programme.end()
    edits = audit.replace("I", "")
    late = sum(f == "truncated" and e != "D" for e, (_, f) in zip(edits, rows, strict=True))
    assert cost == sum(repair.COSTS[e] for e in audit) + 3 * late
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in repair.repaired_turns(audit, (({"s": "system", "u": "user", "a": "assistant"}[i], "") for i, _ in rows))))


def odd_turns():
    rng = random.Random(7)
    rows = [(None, None, None, None), (None, 1, "user", "Yes."), (5, None, "user", "first?"), (5, 3, "user", "first?"), (5, 9, "tool", " \t\n"), (6, 0, "user", "x" * 200_000 + "."), (7, 2, "system", "Only.")]
    rows += [(8, 4, "assistant", "Same. ")] * 5 + [(8, 5, "assistant", "Same. "), (8, -3, "", "é!"), (-1, 0, "user", "a\nb")]
    rows += [(c, rng.randint(0, 6), rng.choice(["system", "user", "assistant", "user", "assistant", "umpire"]), rng.choice(["Fine.", "no end", "", "why?", "Well! \x0b"])) for c in range(100, 160) for _ in range(rng.randint(1, 7))]
    return rows


def test_odd_turns_against_sql_and_the_repaired_turns(spark):
    turns = spark.createDataFrame([(*r, "c", "a", 1, "d") for r in odd_turns()], TURNS)
    found = {r["conv_id"]: r for r in repair.repair(turns).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", odd_turns())
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in found.values()) == Counter(con.execute(repair.oracle_sql()).fetchall())
    assert set(found) == {r[0] for r in odd_turns()}
    rows = repair.damaged(turns)
    told = {}
    for r in sorted(repair.repaired(rows, repair.edits(turns, rows)).collect(), key=lambda r: r["number"]):
        told.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv_id, row in found.items():
        assert hashlib.sha256("\n".join(told.get(conv_id, [])).encode()).hexdigest() == row["repaired_sha256"]


def test_damage_follows_the_checksum(spark):
    turns = spark.createDataFrame([(c, t, "system", "A.b!") for c in range(30) for t in (0, None)], "conv_id long, turn long, role string, text string")
    found = Counter(map(tuple, repair.damaged(turns).collect()))
    expected = Counter()
    for c in range(30):
        for t in (0, None):
            kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
            row = (str(c), t, "user" if kind == 4 else "system", {1: "", 2: "Ab"}.get(kind, "A.b!"))
            expected[row] += {0: 0, 3: 2}.get(kind, 1)
    assert found == +expected


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair(empty).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repair(spark.createDataFrame([(dropped, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
