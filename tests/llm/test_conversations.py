"""Conversation repair against a plain search over (cost, audit), short and long conversations, odd rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from echoloom.llm import conversations as conv
from echoloom.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "user", "system": "user", "user": "assistant", "assistant": "user"}
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute_damage(rows):
    out = []
    for cid, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if cid is None else cid}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(cid, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """The report of one conversation from all (cost, audit) pairs, last row first."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        marks = WORD.findall(text)
        faults.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add((role, text))

    def inserted(best):
        for _ in range(2):
            best = {s: min(best[s], (best[NEXT[s]][0] + 5, "I" + best[NEXT[s]][1])) for s in best}
        return best

    best = inserted({"": (0, ""), "assistant": (0, ""), "system": (99, ""), "user": (99, "")})
    for (_, _, role, _), fault in zip(rows[::-1], faults[::-1]):
        now = {}
        for s in best:
            ways = [(best[s][0] + 2, "D" + best[s][1])]
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                ways.append((best[NEXT[s]][0] + 1 + extra, "R" + best[NEXT[s]][1]))
                to = "system" if (s, role[:1]) == ("", "s") else NEXT[s] if role[:1] == NEXT[s][0] else None
                if to:
                    ways.append((best[to][0] + extra, "K" + best[to][1]))
            now[s] = min(ways)
        best = inserted(now)
    cost, audit = best[""]
    lines, state, left = [], "", list(rows)
    for letter in audit:
        _, _, role, text = left.pop(0) if letter != "I" else (None, None, "", "")
        if letter == "D":
            continue
        state = "system" if letter == "K" and role[:1] == "s" else NEXT[state]
        lines.append(f"{role if letter == 'K' else state}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in brute_damage(rows):
        by[r[0]].append(r)
    return {c: brute_repair(r) for c, r in by.items()}


def found(df):
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert len(out) == df.count()
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_op13_brute_force_and_sql(spark, sf):
    got = registry.QUERIES["op13_conversation_repair"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    assert found(got) == want
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    sql = duckdb.sql(registry.ORACLE_SQL["op13_conversation_repair"]).df()
    assert {r.conv_id: tuple(getattr(r, c) for c in COLUMNS) for r in sql.itertuples()} == want


def test_op13_random_rows(spark):
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "uncle"], ["Yes.", "No!", "Cut off", "", " \n", None, "Why?", "a . ", "x" * 100 + ".", "Fine. \x85"]
    rows = []
    for c in range(300):
        for turn in range(int(rng.integers(1, 12))):
            t = None if rng.random() < 0.05 else int(turn + rng.integers(0, 2))
            rows.append((c, t, roles[int(rng.choice(8, p=[0.35, 0.35, 0.1, 0.04, 0.04, 0.04, 0.04, 0.04]))], texts[int(rng.integers(0, 10))] if rng.random() < 0.5 else f"Text {c} {turn}."))
    assert found(conv.repair(conv.damage(frame(spark, rows).repartition(7)))) == expected(rows)


def test_op13_long_conversation_over_tasks(spark):
    """20,000 rows of one conversation: several tasks, each of several chunks; another lies between, a third has no rows left."""
    rng = np.random.default_rng(6)
    roles = np.array(["user", "assistant", "system"])
    rows = [(7, t, str(roles[(t % 2) if rng.random() < 0.8 else rng.integers(0, 3)]), "Same words." if rng.random() < 0.3 else f"Line {t}" + "." * int(rng.random() < 0.7)) for t in range(20_000)]
    rows += [(8, 1, "user", "Hi."), (8, 2, "assistant", "Ho."), (None, None, None, None)]
    gone = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    df = conv.damage(frame(spark, rows).repartition(5))
    assert found(conv.repair(df)) == expected(rows)
    assert found(conv.repair(df))[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    edits = conv.repaired(df).filter("conv_id = 7").orderBy("step").collect()
    kept = "\n".join(f"{e['role']}:{e['text']}" for e in edits if e["edit"] != "D")
    assert "".join(e["edit"] for e in edits) == expected(rows)[7][6] and hashlib.sha256(kept.encode()).hexdigest() == expected(rows)[7][7]


def test_op13_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 5, "user", "A."), (1, 5, "user", "A."), (1, 5, "user", "A."), (2, 1, "assistant", "x" * 300_000), (3, None, "user", ""), (4, -3, "system", "S."), (4, 9, "user", "U?")]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("cost", "chunk", "place", "conv", "fault", "step", "whole", "rows")})
    assert found(conv.repair(conv.damage(df))) == expected(rows)
    assert conv.repair(conv.damage(df.limit(0))).count() == 0
    assert conv.repair(frame(spark, [(1, 0, "assistant", "Hi.")])).first()["audit"] == "D"
