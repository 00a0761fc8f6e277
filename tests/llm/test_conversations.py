"""Repairs of conversations against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plyforge.llm import conversation_repair as C
from plyforge.llm import turn_grammar as G
from plyforge.llm.queries import ORACLES

NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def cheapest(turns):
    """(cost, audit) over (initial, must go, truncated), by the least path through turns and places."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, place = heapq.heappop(heap)
        if i == len(turns) and place in (0, 3):
            return cost, audit
        if (i, place) in seen:
            continue
        seen.add((i, place))
        ways = [(5, "I", i, NEXT[r, place]) for r in "ua" if (r, place) in NEXT]
        if i < len(turns):
            initial, gone, cut = turns[i]
            ways.append((2, "D", i + 1, place))
            if not gone:
                ways += [(5 * cut, "K", i + 1, NEXT[initial, place])] if (initial, place) in NEXT else []
                ways += [(1 + 5 * cut, "R", i + 1, NEXT[r, place]) for r in "ua" if (r, place) in NEXT]
        for c, e, j, q in ways:
            heapq.heappush(heap, (cost + c, audit + e, j, q))
    raise AssertionError


def simple_report(rows):
    """The report of damaged (turn, role, text) rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")[-1:]
        blank, repeat = not end, (role, text) in seen
        cut = not blank and not repeat and end not in ".!?"
        counts = [n + x for n, x in zip(counts, (blank, not blank and repeat, cut))]
        seen.add((role, text))
        turns.append((role[:1], blank or repeat, cut))
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit = cheapest(turns)
    out, i, place = [], 0, 0
    for e in audit:
        role = "assistant" if place == 2 else "user"
        if e in "KR":
            role = rows[i][1] if e == "K" else role
            out.append(f"{role}:{rows[i][2]}")
        elif e == "I":
            out.append(f"{role}:")
        i += e != "I"
        place = place if e == "D" else NEXT[role[:1], place]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def simple_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def simple_query(rows):
    hurt = simple_damage(rows)
    return {conv: simple_report([r[1:] for r in hurt if r[0] == conv]) for conv in {r[0] for r in rows}}


def test_cells_against_all_edits():
    rng = random.Random(1)
    for n in [*range(1, 8)] * 40:
        letters = "".join(rng.choice("suaoSUAOxy") for _ in range(n))
        cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(n - 1, 3))))
        pieces = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        cost, told = G.paths([G.span(p) for p in pieces])
        turns = [(x.lower(), x in "xy", x.isupper()) for x in letters]
        assert (cost, "".join(a for _, a in told)) == cheapest(turns)
        assert G._long_span(letters) == G.span(letters)


def test_every_cut_of_a_span_gives_the_same_cell():
    rng = random.Random(2)
    for _ in range(60):
        letters = "".join(rng.choice("suaoSUAOxy") for _ in range(rng.randint(2, 12)))
        for k in range(1, len(letters)):
            assert G.joined(G.span(letters[:k]), G.span(letters[k:])) == G.span(letters)


def conversations():
    rng = random.Random(5)
    words = ["Yes.", "No!", "why?", "cut off", "", " \n", "Yes.", "a b. ", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(words)) for _ in range(400)]
    long = [(99, i // 2, ("user", "assistant")[i % 2], f"turn {i % 1900}" + rng.choice([".", "", "!"])) for i in range(2000)]
    equal = [(77, None, "user", "same.")] * 700
    return rows + long + equal


@pytest.mark.parametrize("chunk", [3, 256])
def test_reports_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_TURNS", chunk)
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in C.report(C.damaged(frame), frame).collect()}
    assert got == simple_query(rows)


def test_repaired_turns(spark):
    rows = conversations()[:400]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("own"))
    by: dict = {}
    for r in sorted(C.repair(frame).collect(), key=lambda r: r["at"]):
        by.setdefault(r["conv_id"], []).append(r)
    filled = [(c, t, r or (" " if r is None else ""), " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        want = simple_report([r[1:] for r in filled if r[0] == conv])
        kept = by.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == want[-1]
        assert "".join(r["edit"] for r in kept) == want[-2].replace("D", "")
        assert all((r["turn"] is None and r["text"] == "") for r in kept if r["edit"] == "I")


def test_awkward_tables(spark):
    schema = "conv_id string, turn int, role string, text string, cost string"
    none = spark.createDataFrame([], schema)
    assert C.report(C.damaged(none), none).count() == 0 and C.repair(none).count() == 0
    rows = [("a", 1, "user", "x " * 200_000 + "?", "own"), ("a", 2, "assistant", "Short.", "own"), ("", None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    got = {r[0]: tuple(r)[1:] for r in C.report(C.damaged(frame), frame).collect()}
    assert got == simple_query([r[:4] for r in rows])


def test_sql_against_brute_force(tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = conversations()[:400]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(ORACLES["op13_conversation_repair"]).fetchall()} == simple_query(rows)
