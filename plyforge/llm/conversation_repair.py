"""Conversations whose turns are blank, repeated, cut off or out of turn, and their cheapest repair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plyforge.llm import turn_grammar as G
from plyforge.llm.common import CRC_SQL, crc32_sql, small_batches, written
from plyforge.llm.sharding import dealt

CHUNK_TURNS = 256  # turns of one conversation that are held together, at most
CHUNK_LETTERS = 1 << 22  # letters after which a chunk ends
FAULTS = {G.BLANK: 0, G.REPEATED: 1}
CELLS = "array<struct<p:int,q:int,cost:long,audit:string>>"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``turns`` with faults put in by the hash of conversation and turn: of
    twenty, 0 drops the row, 1 empties the text, 2 takes its ``.!?`` away, 3 repeats the row, 4 makes it the
    user's. NULL in any column counts as one space; conv_id and turn themselves stay NULL."""
    as_text = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", turns["turn"].cast("long").alias("turn"), as_text("role").alias("role"),
                        as_text("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), times.alias("_again")).drop("_again")


def _in_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the record batches of every task; it yields lists of columns. The type of conv_id is kept."""
    kind = dict(df.dtypes)["conv_id"]
    full = T._parse_datatype_string(schema.replace("conv_id ?", f"conv_id {kind}"))
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    small_batches(df)
    return df.mapInArrow(run, full)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def chunks(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as runs of turns that follow each other in a conversation: conv_id,
    ``chunk`` (rising in the order of all turns), arrays of turns, roles and texts, the letters of
    `turn_grammar`, and a digest of role and text for each turn that is not blank.

    Turns are ordered by turn, NULL first, then role and text. They are dealt by ranges of this order, so that
    a conversation of any length is cut over many tasks, and written once. Each task holds one chunk at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        number, held, size, of = TaskContext.get().partitionId() << 33, [], 0, None

        def closed() -> list:
            roles, texts = [r for _, r, _ in held], [t for _, _, t in held]
            letters = "".join(map(G.letter, roles, texts))
            digests = [None if x == G.BLANK else hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for x, r, t in zip(letters, roles, texts)]
            return [[of], [number], [[t for t, _, _ in held]], [roles], [texts], [letters], [digests]]

        for conv, turn, role, text in _rows(batches):
            if held and (conv != of or len(held) == CHUNK_TURNS or size > CHUNK_LETTERS):
                yield closed()
                number, held, size = number + 1, [], 0
            of = conv
            held.append((turn, role, text))
            size += len(text)
        if held:
            yield closed()

    ordered = dealt(turns.select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")
    return written(_in_arrow(ordered, run, "conv_id ?, chunk long, turns array<long>, roles array<string>, "
                             "texts array<string>, letters string, digests array<binary>"), "turn-chunks")


def _first_places(parts: DataFrame) -> DataFrame:
    """(chunk, firsts): the numbers of the turns in a chunk that no equal turn of the conversation precedes."""
    each = parts.select("conv_id", "chunk", F.posexplode("digests").alias("at", "digest")).where("digest IS NOT NULL")
    first = each.groupBy("conv_id", "digest").agg(F.min(F.struct("chunk", "at")).alias("first"))
    return first.groupBy(F.col("first.chunk").alias("_chunk")).agg(F.collect_list("first.at").alias("firsts"))


def _parsed(parts: DataFrame) -> DataFrame:
    """(conv_id, chunk, letters, cells): repeats marked in the letters, and the cell of each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            conv, chunk, letters, firsts = (c.to_pylist() for c in batch.columns)
            known = [set(f or ()) for f in firsts]
            told = ["".join(x if x == G.BLANK or i in k else G.REPEATED for i, x in enumerate(row)) for row, k in zip(letters, known)]
            cells = [[(p, q, cost, audit) for (p, q), (cost, audit) in G.span(t).items()] for t in told]
            yield [conv, chunk, told, [[dict(zip(("p", "q", "cost", "audit"), c)) for c in row] for row in cells]]

    firsts = _first_places(parts)
    both = parts.join(firsts, parts["chunk"] == firsts["_chunk"], "left").select("conv_id", "chunk", "letters", "firsts")
    return _in_arrow(both, run, f"conv_id ?, chunk long, letters string, cells {CELLS}")


def plan(parts: DataFrame) -> DataFrame:
    """(chunk, letters, cost, place, audit) for every chunk of `chunks`: the cost of its conversation's cheapest
    repair, the place where the chunk starts in it, and its edits.

    Chunks are parsed where they lie; the cells of a conversation's chunks then meet in one row, a 256th of
    its turns long, which hold a few letters for every turn, as the audit itself does.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for conv, held in zip(*(c.to_pylist() for c in batch.columns)):
                cost, told = G.paths([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in h["cells"]} for h in held])
                for h, (place, audit) in zip(held, told):
                    for column, value in zip(out, (conv, h["chunk"], h["letters"], cost, place, audit)):
                        column.append(value)
            yield out

    met = _parsed(parts).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "letters", "cells"))).alias("held"))
    found = _in_arrow(met, run, "conv_id ?, chunk long, letters string, cost long, place int, audit string")
    return written(found.select(F.col("chunk").alias("_chunk"), F.col("letters").alias("told"), "cost", "place", "audit"), "turn-plan")


def _planned(parts: DataFrame) -> DataFrame:
    edits = plan(parts)
    return parts.join(edits, parts["chunk"] == edits["_chunk"]).drop("_chunk", "letters", "digests")


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, at, edit, turn, role, text) of the repaired conversations of ``turns`` (conv_id, turn, role,
    text): ``at`` rises along a conversation, ``edit`` is K, R or I, an inserted turn has no ``turn`` and an
    empty text.

    A repaired conversation is empty, or holds an optional system turn and then pairs of user and assistant
    turns, told by the roles' initials. Blank turns and those whose role and text were seen earlier are deleted;
    otherwise the cheapest edits count, of equal ones those whose letters come first. NULL roles and texts count
    as one space; NULL is a conversation of its own, and a NULL turn comes first; turns of one number are
    ordered by role and text; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for conv, chunk, numbers, roles, texts, place, audit in _rows(batches):
            kept = G.repaired(roles, texts, place, audit)
            yield [[conv] * len(kept), [(chunk << 20) + i for i in range(len(kept))], [e for e, *_ in kept],
                   [None if i is None else numbers[i] for _, i, _, _ in kept], [r for _, _, r, _ in kept], [t for *_, t in kept]]

    filled = turns.select("conv_id", turns["turn"].cast("long").alias("turn"), *[F.coalesce(turns[c], F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = _planned(chunks(filled)).select("conv_id", "chunk", "turns", "roles", "texts", "place", "audit")
    return _in_arrow(rows, run, "conv_id ?, at long, edit string, turn long, role string, text string")


def _told(rows: DataFrame) -> DataFrame:
    """What a report needs of each chunk, among it the repaired turns as one text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for conv, chunk, numbers, roles, texts, letters, cost, place, audit in _rows(batches):
            kept = G.repaired(roles, texts, place, audit)
            known = [n for n in numbers if n is not None]
            pairs = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
            yield [[conv], [chunk], [letters.count(G.BLANK)], [letters.count(G.REPEATED)], [sum(x.isupper() for x in letters)], [pairs],
                   [roles[0][:1]], [roles[-1][:1]], [known[0] if known else None], [known[-1] if known else None], [len(set(known))],
                   [cost], [audit], ["\n".join(f"{r}:{t}" for _, _, r, t in kept) if kept else None]]

    return _in_arrow(rows, run, "conv_id ?, chunk long, blank long, duplicate long, truncated long, illegal long, opens string, "
                     "closes string, low long, high long, turns long, cost long, audit string, text string")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One row per conversation of chunks that come in order; one chunk is held at a time, and the audit."""
    of, seen = None, False
    state: dict = {}

    def closed() -> list:
        gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
        return [[x] for x in (of, gaps, *state["counts"], state["cost"], "".join(state["audit"]), state["sha"].hexdigest())]

    for conv, _, blank, duplicate, truncated, illegal, opens, closes, low, high, turns, cost, audit, text in _rows(batches):
        if not seen or conv != of:
            if seen:
                yield closed()
            of, seen = conv, True
            state = {"counts": [0, 0, 0, 0], "turns": 0, "low": None, "high": None, "closes": None, "audit": [], "sha": hashlib.sha256(), "any": False}
        state["counts"] = [a + b for a, b in zip(state["counts"], (blank, duplicate, truncated, illegal))]
        if state["closes"] is not None and state["closes"] + opens not in ("su", "ua", "au"):
            state["counts"][3] += 1
        if turns:
            state["turns"] += turns - (low == state["high"])
            state["low"] = low if state["low"] is None else state["low"]
            state["high"] = high
        state["closes"], state["cost"] = closes, cost
        state["audit"].append(audit)
        if text is not None:
            state["sha"].update((("\n" if state["any"] else "") + text).encode())
            state["any"] = True
    if seen:
        yield closed()


def report(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every
    conversation of ``turns`` (without NULL in role and text), or of the rows ``conversations``: what is wrong
    with its turns, the cheapest edits, and the hash of what they leave. A conversation without turns has zeros,
    no edits and the hash of the empty text. Other rules are those of `repair`.

    The hash runs over all repaired turns of a conversation in order, so one task reads them, as one text per
    chunk, and holds one of these at a time.
    """
    rows = _planned(chunks(turns)).select("conv_id", "chunk", "turns", "roles", "texts", "told", "cost", "place", "audit")
    ordered = _told(rows).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    found = _in_arrow(ordered, _folded, "conv_id ?, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                      "audit string, repaired_sha256 string")
    ids = (turns if conversations is None else conversations).select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: Damage and report in SQL, one recursion per turn of the longest conversation.
REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
keyed AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS again FROM keyed WHERE fault <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM hurt),
repeats AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM placed),
told AS (
  SELECT conv_id, turn, role, text, i, seen = '' AS blank, seen <> '' AND copy > 1 AS duplicate,
         seen <> '' AND copy = 1 AND NOT regexp_matches(seen, '[.!?]$') AS truncated,
         substring(role, 1, 1) AS initial, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM repeats),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM told GROUP BY conv_id),
says(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
added(p, q, cost, audit) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'),
         (0, 3, 10, 'II'), (1, 3, 10, 'II')),
edits AS (
  SELECT conv_id, i, p, p AS q, 2 AS cost, 'D' AS audit FROM told, (VALUES (0), (1), (2), (3)) v(p)
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN truncated THEN 5 ELSE 0 END, 'K' FROM told JOIN says USING (initial) WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN truncated THEN 6 ELSE 1 END, 'R' FROM told, says WHERE says.initial <> 's' AND NOT blank AND NOT duplicate),
steps AS (
  SELECT e.conv_id, e.i, e.p, a.q, min({{'cost': e.cost + a.cost, 'audit': e.audit || a.audit}}) AS way
  FROM edits e JOIN added a ON a.p = e.q GROUP BY ALL),
best AS (
  SELECT conv_id, 0::BIGINT AS i, q AS place, cost, audit FROM stats, added WHERE p = 0
  UNION ALL
  SELECT conv_id, i, place, way.cost, way.audit FROM (
    SELECT b.conv_id, s.i, s.q AS place, min({{'cost': b.cost + s.way.cost, 'audit': b.audit || s.way.audit}}) AS way
    FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 AND s.p = b.place GROUP BY ALL)),
chosen AS (
  SELECT conv_id, way.cost AS cost, way.audit AS audit FROM (
    SELECT b.conv_id, min({{'cost': b.cost, 'audit': b.audit}}) AS way
    FROM best b JOIN stats s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.n = b.i WHERE place IN (0, 3) GROUP BY b.conv_id)),
letters AS (
  SELECT conv_id, k, substring(audit, k, 1) AS edit, k - len(replace(substring(audit, 1, k), 'I', '')) AS inserted
  FROM (SELECT conv_id, audit, CAST(unnest(range(1, len(audit) + 1)) AS INTEGER) AS k FROM chosen)),
kept AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.conv_id ORDER BY k) AS j, t.role, t.text, t.initial
  FROM letters l LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = k - inserted AND edit <> 'I' WHERE edit <> 'D'),
spoken AS (
  SELECT *, bool_or(j = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY conv_id) AS led FROM kept),
lines AS (
  SELECT conv_id, k, CASE WHEN edit = 'K' THEN role WHEN (j % 2 = 1) <> led THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line
  FROM spoken),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS repaired_sha256 FROM lines GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
