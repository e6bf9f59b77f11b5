import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from riskloom.llm import conversations, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, edit string, gone_by string"
WHITE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(key.encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        cut = text.rstrip(WHITE)
        out.append("b" if not cut else "d" if (role, text) in seen else "t" if cut[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """By memoised recursion over (turn, last role): (cost, audit, lines)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(i, last, inserted):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        due = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]

        def add(cost, letter, line, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if inserted < 2:
            add(5, "I", (f"{name}:",), go(i, due, inserted + 1))
        if i < len(rows):
            _, _, role, text = rows[i]
            add(2, "D", (), go(i + 1, last, 0))
            if faults[i] not in ("b", "d"):
                cut = 5 if faults[i] == "t" else 0
                if role and role[0] in follow[last]:
                    add(cut, "K", (f"{role}:{text}",), go(i + 1, role[0], 0))
                add(cut + 1, "R", (f"{name}:{text}",), go(i + 1, due, 0))
        return min(found, default=None)

    return go(0, "", 0)


def brute(turns, damage=True):
    out = []
    for conv in {t[0] for t in turns}:
        rows = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or " ", t[3] or " "))
        rows = hurt(rows) if damage else [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]
        faults = faults_of(rows)
        known = [t[1] for t in rows if t[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [t[2][:1] for t in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(tuple(rows), tuple(faults))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, turns, damage=True):
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], SCHEMA)
    got = conversations.digests(conversations.repair(conversations.damaged(df) if damage else df.drop("gone_by")))
    return sorted(map(tuple, got.collect()), key=str)


def conversation(rng, conv, n, odd=0.3):
    rows, pool = [], [f"words {i} of text{end}" for i in range(max(3, n // 2)) for end in ".?"]
    for t in range(n):
        role = ("user", "assistant")[t % 2] if rng.random() > odd else rng.choice(["system", "user", "assistant", "tool", "", None])
        text = rng.choice(pool) if rng.random() > odd else rng.choice(["", " \n", "cut off", "ends. \t", None, "ééç!"])
        rows.append((conv, rng.choice([t, t, t, t + 1000]), role, text))
    return rows


def test_search_against_every_edit(spark):
    rng = random.Random(5)
    turns = [t for c in range(150) for t in conversation(rng, c, rng.randint(1, 12))]
    assert repaired(spark, turns) == brute(turns)
    assert repaired(spark, turns, damage=False) == brute(turns, damage=False)


def test_long_conversation_is_searched_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    long = conversation(rng, 7, 300)
    turns = long + conversation(rng, 8, 9) + conversation(rng, 6, 9)
    want = brute(turns)
    assert repaired(spark, turns) == want
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], SCHEMA)
    assert conversations.parts(conversations.damaged(df)).where("conv_id = 7").count() > 2


def test_parts_of_any_size_agree():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(0, 14)
        rows = [(rng.choice("suax "), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(n)]
        whole = conversations.ways(rows, True)[0]
        for size in (1, 2, 3, 5):
            chain = conversations.Chain()
            for i in range(0, max(n, 1), size):
                chain.add({"ways": conversations.ways(rows[i:i + size], False)})
            cost, path = chain.end()
            assert (cost, "".join(a for _, _, a in path)) == (whole["cost"], whole["audit"])


def test_nulls_ties_repeats_and_dropped(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = [(dropped, 0, "user", "gone."), (None, None, None, None), (None, None, "user", "q?"), (None, 3, "assistant", "a."), (None, 3, "assistant", "a."),
             (-5, None, "user", "x."), (-5, None, "assistant", "y."), (-5, -9, "user", "z."), (-6, 1, "user", "same."), (-6, 1, "user", "same."), (-6, 1, "user", "same."),
             (-7, 1, "system", "s."), (-8, 1, "user", "w " * 60_000 + "."), (-8, 2, "assistant", "")]
    got = repaired(spark, turns)
    assert got == brute(turns)
    empty = hashlib.sha256(b"").hexdigest()
    assert (dropped, 0, 0, 0, 0, 0, 0, "", empty) in got


def test_no_rows(spark):
    assert repaired(spark, []) == []


def test_repaired_turns_follow_the_edits(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind.", "", ""), (1, 1, "assistant", "Hi.", "", ""), (1, 2, "assistant", "Yes.", "", "")], SCHEMA)
    rows = conversations.repair(df).where("last").collect()
    assert [(r.audit, r.cost) for r in rows] == [("KRK", 1)]
    turns = conversations.repair(df).orderBy("p", "no").select(F.explode("repaired").alias("t")).select("t.*").collect()
    assert [(t.edit, t.role, t.text) for t in turns] == [("K", "system", "Be kind."), ("R", "user", "Hi."), ("K", "assistant", "Yes.")]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted(map(tuple, queries.op11_conversation_repair(spark, sf).collect()), key=str) == brute(turns)
