"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate, found by bidirectional Dijkstra.

The edit lattice has a node for every number of rows read and every way the output may stand (nothing yet, after a system row, after a user
row, after an assistant row). Keeping, re-roling and deleting read a row, inserting does not. One heap grows from the start, one from
the end; labels are (cost, audit), so that among equal costs the least letters are settled. The heaps stop only when no crossing of equal
cost can be left, and of all crossings the least joined audit is taken.

Conversations of at most ``SHORT_ROWS`` rows are repaired whole. Of longer ones no task holds more than a segment: rows are numbered in order by
a range sort, every segment yields the best edits between each two ways the output may stand, and these are composed in order. The
result is the same, as the best way through the whole crosses every border somewhere."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracklake.llm.common import slices
from tracklake.llm.importance import CRC_SQL, crc_sql
from tracklake.operators.skew import global_index
from tracklake.session import settle

SHORT_ROWS, SEGMENT_ROWS, BROADCAST_BYTES = 1_000, 256, 8_000_000
BLANK = "\t\n\x0b\x0c\r "  # fixed value: the characters that count as blank
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # ways the output may stand
ENDS = (NOTHING, ASSISTANT)
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
RETELL, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3  # fixed values: costs
GOOD_PAIRS = ("su", "ua", "au")


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str  # b(lank), d(uplicate), t(runcated) or empty


def edits_from(row: Row, stand: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, stand after it) of the edits that read ``row``."""
    yield "D", DELETE, stand
    if row.fault in ("b", "d"):
        return
    extra = UNFINISHED if row.fault == "t" else 0
    kept = STEPS.get(row.role[:1], {}).get(stand)
    if kept is not None:
        yield "K", extra, kept
    for role in ("u", "a"):
        if stand in STEPS[role]:
            yield "R", RETELL + extra, STEPS[role][stand]


def inserts_from(stand: int) -> Iterator[tuple[str, int, int]]:
    for role in ("u", "a"):
        if stand in STEPS[role]:
            yield "I", INSERT, STEPS[role][stand]


def cheapest(rows: list[Row], start: int = NOTHING, goals: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits that lead from ``start`` to one of ``goals`` over all rows, ASCII-least among equals."""
    n = len(rows)

    def onward(node):
        at, stand = node
        for letter, cost, then in inserts_from(stand):
            yield (at, then), cost, letter
        if at < n:
            for letter, cost, then in edits_from(rows[at], stand):
                yield (at + 1, then), cost, letter

    def backward(node):
        at, then = node
        for stand in range(4):
            for letter, cost, to in inserts_from(stand):
                if to == then:
                    yield (at, stand), cost, letter
            if at:
                for letter, cost, to in edits_from(rows[at - 1], stand):
                    if to == then:
                        yield (at - 1, stand), cost, letter

    # Heap entries are (cost, rows passed, audit, node): free edits lead away from the side's own end, so at equal
    # cost nodes that are passed first are settled first and an audit is final when its node is settled.
    settled: tuple[dict, dict] = ({}, {})
    heaps = ([(0, 0, "", (0, start))], [(0, 0, "", (n, goal)) for goal in goals])
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1]:
        if best and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, audit, node = heapq.heappop(heaps[side])
        mine, other = settled[side], settled[1 - side]
        if node in mine:
            continue
        mine[node] = (cost, audit)
        crossings = [(cost + other[node][0], *((audit, other[node][1]) if side == 0 else (other[node][1], audit)))] if node in other else []
        for neighbour, price, letter in onward(node) if side == 0 else backward(node):
            if neighbour in other:
                far, rest = other[neighbour]
                crossings.append((cost + price + far, *((audit + letter, rest) if side == 0 else (rest, letter + audit))))
            if neighbour not in mine:
                passed = neighbour[0] if side == 0 else n - neighbour[0]
                heapq.heappush(heaps[side], (cost + price, passed, audit + letter if side == 0 else letter + audit, neighbour))
        for total, head, tail in crossings:
            if best is None or (total, head + tail) < best:
                best = (total, head + tail)
    return best


def repaired(rows: list[Row], audit: str, stand: int = NOTHING) -> tuple[list[str], int]:
    """The lines that ``audit`` makes of the rows, and how the output stands after them."""
    lines, at = [], 0
    for letter in audit:
        row = rows[at] if letter != "I" else None
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            stand = STEPS[row.role[:1]][stand]
            lines.append(f"{row.role}:{row.text}")
        else:
            stand = ASSISTANT if stand == USER else USER
            lines.append(f"{NAMES[stand]}:{row.text if row else ''}")
    return lines, stand


def fault_of(text: str, seen: bool) -> str:
    last = text.rstrip(BLANK)[-1:]
    return "b" if not last else "d" if seen else "" if last in ".!?" else "t"


def bad_neighbours(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in GOOD_PAIRS for a, b in zip(roles, roles[1:]))


def counted(rows: list[Row]) -> tuple[int, int, int, int]:
    faults = [r.fault for r in rows]
    return faults.count("b"), faults.count("d"), faults.count("t"), bad_neighbours([r.role for r in rows])


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def in_groups(df: DataFrame, keys: list[str], order: list[str], result: str, make: Callable[[tuple, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Rows of ``df`` brought together by ``keys`` and sorted by ``order`` (nulls first); ``make(key, rows)`` reads a group's rows as they
    come and yields tuples of the ``result`` columns, which follow the keys. Nothing but what ``make`` holds is kept in memory."""
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    schema = StructType([df.schema[k] for k in keys] + StructType.fromDDL(result).fields)
    arrow, width = to_arrow_schema(schema), len(keys)

    def run(batches):
        rows = (row for part in slices(batches) for row in zip(*(c.to_pylist() for c in part.columns)))
        out = []
        for key, group in groupby(rows, lambda row: row[:width]):
            for made in make(key, group):
                out.append((*key, *made))
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows as the damage leaves them; dropped rows stay as markers, so that no conversation is lost.

    Null roles and texts are one space, and so are null ids and turns where the damage is chosen; elsewhere these stay null."""
    def spoken(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(spoken(conv_col), F.lit(":"), spoken(turn_col))) % 20
    text = spoken(text_col)
    return (conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(spoken(role_col)).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (hit == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))).alias("_copy")).drop("_copy"))


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _gaps(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def _whole(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    rows, seen = [], set()
    for _, turn, role, text, dropped in group:
        if not dropped:
            rows.append(Row(turn, role, text, fault_of(text, (role, text) in seen)))
            seen.add((role, text))
    cost, audit = cheapest(rows)
    yield (_gaps({r.turn for r in rows if r.turn is not None}), *counted(rows), cost, audit, digest(repaired(rows, audit)[0]))


def _short(rows: DataFrame) -> DataFrame:
    return in_groups(rows, ["conv_id"], ["turn", "role", "text"], RESULT, _whole)


SEGMENT = ("blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
           "costs array<long>, audits array<string>")


def _segment(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    rows = [Row(turn, role, text, fault_of(text, seen)) for _, _, _, turn, role, text, seen in group]
    ways = [cheapest(rows, start, (end,)) for start in range(4) for end in range(4)]
    yield (*counted(rows), rows[0].role[:1], rows[-1].role[:1], [w[0] if w else None for w in ways], [w[1] if w else None for w in ways])


def _compose(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    """The best way through all segments of a conversation: per segment how the output stands before it, its audit, its cost and the number
    of bad neighbours at its border. Of every way only the two ends that are still compared are joined text."""
    best: dict[int, tuple[int, str]] = {NOTHING: (0, "")}
    came_from, segments, last = [], [], None
    for _, segment, first_role, last_role, costs, audits in group:
        reached, origin = {}, {}
        for start, (cost, audit) in best.items():
            for end in range(4):
                if costs[4 * start + end] is not None:
                    way = (cost + costs[4 * start + end], audit + audits[4 * start + end])
                    if end not in reached or way < reached[end]:
                        reached[end], origin[end] = way, start
        segments.append((segment, costs, audits, int(last is not None and last + first_role not in GOOD_PAIRS)))
        came_from.append(origin)
        best, last = reached, last_role
    end = min((e for e in ENDS if e in best), key=best.get)
    chosen = []
    for (segment, costs, audits, border), origin in zip(reversed(segments), reversed(came_from)):
        start = origin[end]
        chosen.append((segment, start, audits[4 * start + end], costs[4 * start + end], border))
        end = start
    yield from reversed(chosen)


def _lines(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    rows, audit, start = [], "", NOTHING
    for _, _, _, turn, role, text, audit, start in group:
        rows.append(Row(turn, role, text, ""))
    lines, _ = repaired(rows, audit, start)
    yield len(lines), "\n".join(lines)


def _digest(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    made, begun = hashlib.sha256(), False
    for _, _, n_lines, text in group:
        if n_lines:
            made.update((("\n" if begun else "") + text).encode("utf-8", "surrogatepass"))
            begun = True
    yield (made.hexdigest(),)


def _with(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined to ``b`` on equal or both null ``names``."""
    other = b.select(*[F.col(n).alias(f"_{n}") for n in names], *[c for c in b.columns if c not in names])
    condition = None
    for name in names:
        equal = F.col(name).eqNullSafe(F.col(f"_{name}"))
        condition = equal if condition is None else condition & equal
    return a.join(other, condition, how).drop(*[f"_{n}" for n in names])


def _long(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Long conversations: every group below is a segment, one row per segment, or a total."""
    left = rows.filter(~F.col("dropped")).drop("dropped")
    placed = settle(global_index(left, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]))
    said = ["conv_id", "role", "said"]
    keyed = placed.withColumn("said", F.sha2("text", 256))
    first = keyed.groupBy(*said).agg(F.min("pos").alias("first_pos"))
    parts = settle(_with(keyed, first, said).select(
        "conv_id", F.floor(F.col("pos") / segment_rows).alias("segment"), "pos", "turn", "role", "text", (F.col("pos") > F.col("first_pos")).alias("seen")))
    maps = settle(in_groups(parts, ["conv_id", "segment"], ["pos"], SEGMENT, _segment))
    ways = settle(in_groups(maps.select("conv_id", "segment", "first_role", "last_role", "costs", "audits"), ["conv_id"], ["segment"],
                            "segment long, start int, audit string, cost long, border long", _compose))
    told = _with(parts.drop("seen"), ways.select("conv_id", "segment", "audit", "start"), ["conv_id", "segment"])
    lines = settle(in_groups(told, ["conv_id", "segment"], ["pos"], "n_lines long, lines string", _lines))
    digests = in_groups(lines, ["conv_id"], ["segment"], "repaired_sha256 string", _digest)
    turns = (left.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
             .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")))
    totals = maps.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    audits = ways.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"), F.sum("border").alias("border"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    out = rows.select("conv_id").distinct()
    for part in (turns, totals, audits, digests):
        out = _with(out, part, ["conv_id"], "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers[:4]],
                      (F.coalesce("illegal", F.lit(0)) + F.coalesce("border", F.lit(0))).alias("illegal"), F.coalesce("cost", F.lit(0)).alias("cost"),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(conversations: DataFrame, short_rows: int = SHORT_ROWS, segment_rows: int = SEGMENT_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
           conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of ``conversations``, after the damage of ``damaged``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Rows are taken by turn, nulls first; rows of one turn by role and text. Rows without an id are one conversation, with a null id.
    Conversations of which no row is left have zeros, an empty audit and the hash of nothing. Further columns are not read; an empty
    table gives no rows. The hash of a conversation's whole repaired text is a serial sum: of a huge conversation one task
    reads the repaired lines as a stream."""
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    long = settle(conversations.groupBy(F.col(conv_col).alias("conv_id")).count().filter(F.col("count") * 2 > short_rows).select("conv_id"))
    size = long.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("conv_id").cast("string"))).alias("bytes")).first()
    if not size["n"]:
        return _short(rows)
    ids = F.broadcast(long) if (size["bytes"] or 0) + 16 * size["n"] <= broadcast_bytes else long
    few = _with(rows, ids, ["conv_id"], "left_anti")
    many = settle(_with(rows, ids, ["conv_id"], "left_semi"))
    return _short(few).unionByName(_long(many, segment_rows))


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit
  FROM conversations, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hit)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, substr(role, 1, 1) AS initial FROM damaged),
judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS seen
  FROM placed
),
faulty AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM judged),
inserts(s0, s1, letters, price, lines) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 3, chr(10) || 'user:'), (1, 2, 'I', 3, chr(10) || 'user:'), (3, 2, 'I', 3, chr(10) || 'user:'), (2, 3, 'I', 3, chr(10) || 'assistant:'),
  (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')),
reads(s0, s1, letter, price, initial) AS (VALUES (0, 0, 'D', 4, NULL), (1, 1, 'D', 4, NULL), (2, 2, 'D', 4, NULL), (3, 3, 'D', 4, NULL),
  (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
  (0, 2, 'R', 3, NULL), (1, 2, 'R', 3, NULL), (3, 2, 'R', 3, NULL), (2, 3, 'R', 3, NULL)),
walk(conv_id, k, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', '' FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, k, state, (way).cost, (way).audit, (way).lines FROM (
    SELECT w.conv_id, w.k + 1 AS k, r.s1 AS state, min({{'cost': w.cost + i.price + r.price + CASE WHEN f.fault = 't' AND r.letter <> 'D' THEN 3 ELSE 0 END,
      'audit': w.audit || i.letters || r.letter,
      'lines': w.lines || i.lines || CASE r.letter WHEN 'D' THEN '' ELSE chr(10) || CASE WHEN r.letter = 'K' THEN f.role WHEN r.s1 = 2 THEN 'user' ELSE 'assistant' END || ':' || f.text END}}) AS way
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1
    JOIN inserts i ON i.s0 = w.state JOIN reads r ON r.s0 = i.s1
    WHERE (r.letter = 'D' OR f.fault NOT IN ('b', 'd')) AND (r.letter <> 'K' OR r.initial = f.initial)
    GROUP BY w.conv_id, w.k, r.s1)
),
ends AS (
  SELECT w.conv_id, min({{'cost': w.cost + i.price, 'audit': w.audit || i.letters, 'lines': w.lines || i.lines}}) AS way
  FROM walk w JOIN (SELECT conv_id, max(k) AS k FROM walk GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k
  JOIN inserts i ON i.s0 = w.state WHERE i.s1 IN (0, 3) GROUP BY w.conv_id
),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce((way).cost, 0) AS cost, coalesce((way).audit, '') AS audit, sha256(coalesce(substr((way).lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
