"""Conversation repair against an enumeration of all edits, and against the whole contract in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docweft.llm import repair

WANTED = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, copy string, gone string"
NAMES = {"u": "user", "a": "assistant"}


def best_edits(rows, inserts=2):
    """(cost, audit, repaired rows) by trying everything. rows: (role, text, must go, truncated)."""
    found = None

    def go(i, left, out, audit, cost):
        nonlocal found
        if i == len(rows) and WANTED.match("".join(r[:1] for r, _ in out)) and (found is None or (cost, audit) < found[:2]):
            found = (cost, audit, out)
        if left:
            for r in "ua":
                go(i, left - 1, [*out, (NAMES[r], "")], audit + "I", cost + 5)
        if i < len(rows):
            role, text, must_go, open_end = rows[i]
            go(i + 1, left, out, audit + "D", cost + 2)
            if not must_go:
                more = 5 if open_end else 0
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, left, [*out, (role, text)], audit + "K", cost + more)
                for r in "ua":
                    go(i + 1, left, [*out, (NAMES[r], text)], audit + "R", cost + 1 + more)

    go(0, inserts, [], "", 0)
    return found


def expected(rows, edits=best_edits):
    """The query's rows, from plain rows (conv_id, turn, role, text) whose turns differ within a conversation."""
    out = {}
    fill = lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = fill(role), fill(text)
            kind = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
            if kind == 1:
                text = ""
            elif kind == 2:
                text = re.sub("[.!?]", "", text)
            elif kind == 4:
                role = "user"
            after += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in after:
            full = text.strip(" \t\n\v\f\r")
            fault = 0 if not full else 1 if (role, text) in seen else 2 if full[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in after if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, kept = edits(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_solve_against_all_edits():
    kinds = {0: ("system", 0, 0), 1: ("user", 0, 0), 2: ("assistant", 0, 0), 3: ("x", 0, 0), 5: ("user", 1, 0), 9: ("user", 0, 1), 10: ("assistant", 0, 1)}
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            if n < 3 or sum(rows) % 2:
                want = best_edits([(kinds[k][0], "t", *kinds[k][1:]) for k in rows])[:2]
                assert repair._by_integers(bytes(rows)) == want == repair._long(bytes(rows))


def test_solve_of_long_conversations_is_the_same_either_way():
    rng = random.Random(5)
    for n in (50, 700, 3000):
        rows = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 10]) for _ in range(n))
        assert repair._by_integers(rows) == repair._long(rows)


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(11)
    texts = ["Yes.", "No", "", " \t\n", None, "Why?", "A. b! c? d", "same.", "same.", "é…", "ends. \n"]
    rows = []
    for conv in [*range(60), None]:
        turns = rng.sample([None, *range(-3, 9)], rng.randrange(1, 6))
        rows += [(conv, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "ux"]), rng.choice(texts)) for t in turns]
    return rows


def test_report_against_plain_python(spark, awkward):
    rows = spark.createDataFrame([(*r, "x", "y") for r in awkward], SCHEMA)
    assert got(repair.repair_report(repair.damage(rows))) == expected(awkward)
    assert repair.repair_report(repair.damage(rows.limit(0))).count() == 0


def test_rows_that_are_all_dropped(spark):
    turn = next(t for t in itertools.count() if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = spark.createDataFrame([(7, turn, "user", "Hello.", "", "")], SCHEMA)
    assert got(repair.repair_report(repair.damage(rows))) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_gives_rows_and_ties_have_an_order(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "", ""), (1, 1, "user", "Hello?", "", ""), (1, 1, "user", "Hello?", "", ""), (1, 2, "assistant", "Yes.", "", ""), (2, 0, "assistant", "b.", "", ""), (2, 0, "user", "a.", "", "")], SCHEMA)
    found = sorted(tuple(r) for r in repair.repair(rows).collect())
    assert found == [(1, 1, "K", "user", "Hello?"), (1, 2, "K", "assistant", "Yes."), (2, 1, "R", "user", "b."), (2, 2, "R", "assistant", "a.")]
    assert got(repair.audits(repair.ordered(rows)).select("conv_id", "cost", "audit")) == {1: (4, "DKDK"), 2: (2, "RR")}


def test_a_very_long_conversation_with_a_very_long_text(spark):
    n = 9_001
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"word {i}." if i != 77 else "x " * 200_000 + ".") for i in range(n)]
    table = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(3)
    found = got(repair.repair_report(repair.damage(table)))

    def edits(marked):
        codes = bytes("sua".find(r[:1]) + (4 if gone else 0) + (8 if cut else 0) for r, _, gone, cut in marked)
        cost, audit = repair._by_integers(codes)
        kept, at, turn = [], 0, "ua"
        for letter in audit:
            if letter == "I":
                kept.append((NAMES[turn[len(kept) % 2]], ""))
            else:
                if letter != "D":
                    kept.append((NAMES[turn[len(kept) % 2]], marked[at][1]))
                at += 1
        return cost, audit, kept

    assert found == expected(rows, edits)


def test_query_on_given_conversations(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    short = {c for c in {r[0] for r in rows} if sum(r[0] == c for r in rows) <= 4}
    want = expected([r for r in rows if r[0] in short])
    found = got(repair.op11(spark, data))
    assert set(found) == {r[0] for r in rows} and {c: found[c] for c in short} == want and len(short) >= 10


def test_damage_keeps_conversations(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    kinds = {r["gone"] for r in repair.damage(rows).groupBy("gone").agg(F.count("*")).collect()}
    assert kinds == {True, False}
