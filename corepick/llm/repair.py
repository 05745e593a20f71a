"""Cheapest repair of the structure of conversations, by block tables (the method of the Four Russians).

The rows of a conversation in the order of their turns are symbols: the initial of the role (user, assistant, system or any
other), whether the text is cut off, and whether the row has to go (blank, or a repetition of an earlier one). Keeping a
row costs nothing, another role for it 2, deleting it 3, an empty row put in 2, and a row that stays cut off 1 more. What
is left has to read ``(s?(ua)+)?``, an automaton of four states. For each place the costs to the end from every state are a
vector; less its least element it is one of a few vectors, so a table gives for every vector and every block of ``BLOCK``
symbols the vector before the block. Costs are looked up block by block from the end; a trace then expands one block
after the other backward into the vectors inside it and takes the first of the letters D, I, K, R that keeps the cost.

Groups: rows are dealt out in ranges of (conversation, turn), so one conversation may hold any share of them. Every 1,024
rows make a chunk; the chunks' cost matrices and traces from all four states are computed apart, and only these few numbers
a chunk are run through in order (from the last to the first for costs, then from the first to the last for states). Texts
are hashed as a stream in order, which is sequential by its nature and holds one text at a time.

Nulls: a null role or text is one space, so such a row is of another role or blank; null turns come first and count for no
gap; a null conversation id is a conversation of its own. An empty role is neither of the three and cannot stay. Turns with
equal numbers are ordered by role, then by the MD5 of the text. Repeated rows are duplicates. Very long texts are never
gathered. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.common import SQL_CRC32, cut, table
from corepick.llm.places import in_order, same

BLOCK = 4
#: Rows of a chunk, as a power of two.
CHUNK_BITS = 10
SPACES = " \t\n\v\f\r"
INITIALS = "uas"
#: Symbol 0 has to be deleted; 1 + 2 x role + cut off are the others, role 3 being any other.
SYMBOLS = 9
STATES = 4
START, AFTER_S, AFTER_U, AFTER_A = range(STATES)
ACCEPTS = (START, AFTER_A)
REROLE, DELETE, INSERT = 2, 3, 2
#: Where a user or assistant row leads, whichever may come next.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE_INTO = {AFTER_U: "user", AFTER_A: "assistant"}
INFINITE = 1 << 20
Vector = tuple[int, ...]


def moves(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """What may be done with a row: letter, cost and the state after it, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol:
        role, cut_off = divmod(symbol - 1, 2)
        kept = AFTER_S if role == 2 and state == START else NEXT[state] if role < 2 and NEXT[state] == (AFTER_U, AFTER_A)[role] else None
        if kept is not None:
            out.append(("K", cut_off, kept))
        out.append(("R", REROLE + cut_off, NEXT[state]))
    return out


def _with_inserts(costs: list[int]) -> Vector:
    for _ in range(STATES):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(min(c, INFINITE) for c in costs)


def before(vector: Vector, symbol: int) -> Vector:
    """Costs to the end from before a row, given those from after it."""
    return _with_inserts([min(cost + vector[to] for _, cost, to in moves(q, symbol)) for q in range(STATES)])


def _normal(vector: Vector) -> tuple[Vector, int]:
    least = min(vector)
    return tuple(c if c >= INFINITE else c - least for c in vector), least


END = _with_inserts([0 if q in ACCEPTS else INFINITE for q in range(STATES)])
#: Costs to exactly one state at the end.
ENDS = [_with_inserts([0 if q == to else INFINITE for q in range(STATES)]) for to in range(STATES)]


@dataclass(frozen=True)
class Tables:
    """``vectors`` that occur, and for each of them and each block of symbols the vector before it and the cost added."""

    vectors: list[Vector]
    number: dict[Vector, int]
    to: np.ndarray
    cost: np.ndarray


@lru_cache(1)
def tables() -> Tables:
    vectors, number = [], {}

    def add(v: Vector) -> int:
        if v not in number:
            number[v] = len(vectors)
            vectors.append(v)
        return number[v]

    for v in (END, *ENDS):
        add(_normal(v)[0])
    one, cost = [], []
    for v in vectors:  # grows while it is gone through
        found = [_normal(before(v, s)) for s in range(SYMBOLS)]
        one.append([add(x) for x, _ in found])
        cost.append([c for _, c in found])
    first, first_cost = np.array(one), np.array(cost)
    to, total = first, first_cost
    for _ in range(BLOCK - 1):  # a symbol put before what is there: vector, symbol in front, those behind
        to, total = first[to].swapaxes(1, 2).reshape(len(vectors), -1), (total[..., None] + first_cost[to]).swapaxes(1, 2).reshape(len(vectors), -1)
    return Tables(vectors, number, to, total)


def _blocks(symbols: bytes) -> list[int]:
    """Codes of the full blocks; what is left over stands at the front."""
    front = len(symbols) % BLOCK
    s = np.frombuffer(symbols, np.uint8)[front:].reshape(-1, BLOCK).astype(np.int64)
    return (s @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()


def boundaries(symbols: bytes, vector: Vector) -> list[tuple[Vector, int]]:
    """The vectors (with what is to be added to them) at all block boundaries from the front to the end, which has ``vector``."""
    t = tables()
    normal, added = _normal(vector)
    at = t.number[normal]
    out = [(normal, added)]
    for code in reversed(_blocks(symbols)):
        at, added = t.to[at, code], added + int(t.cost[at, code])
        out.append((t.vectors[at], added))
    out.reverse()
    return out


def expanded(symbols: bytes, end: tuple[Vector, int]) -> list[Vector]:
    """The costs at every place of a few symbols, from the vector at their end backward."""
    out = [tuple(min(INFINITE, c + end[1]) for c in end[0])]
    for s in reversed(symbols):
        out.append(before(out[-1], s))
    out.reverse()
    return out


def costs_before(symbols: bytes, vector: Vector) -> tuple[Vector, int]:
    """The normal vector before some symbols and what is to be added to it."""
    first, added = boundaries(symbols, vector)[0]
    normal, more = _normal(expanded(symbols[: len(symbols) % BLOCK], (first, 0))[0])
    return normal, added + more


def trace(symbols: bytes, vector: Vector, last: bool) -> tuple[list[str], list[int]]:
    """From each state before the symbols: the least letters of cheapest edits, and the state after them.

    ``last``: nothing follows, so rows may be put in at the end as well.
    """
    known = boundaries(symbols, vector)
    front = len(symbols) % BLOCK
    edges = [0, *range(front, len(symbols) + 1, BLOCK)] if front else [*range(0, len(symbols) + 1, BLOCK)]
    ends = known if front else known[1:]
    letters, states = [[] for _ in range(STATES)], list(range(STATES))
    for a, b, end in zip(edges, edges[1:], ends):
        go = expanded(symbols[a:b], (end[0], 0))
        for start in range(STATES):
            q, out = states[start], letters[start]
            for i in range(b - a):
                while True:
                    choices = [(x, cost + go[i + 1][to], to, False) for x, cost, to in moves(q, symbols[a + i])]
                    choices.append(("I", INSERT + go[i][NEXT[q]], NEXT[q], True))
                    letter, _, q, stay = min(c for c in choices if c[1] == go[i][q])
                    out.append(letter)
                    if not stay:
                        break
            states[start] = q
    if last:
        for start in range(STATES):
            while states[start] not in ACCEPTS:
                letters[start].append("I")
                states[start] = NEXT[states[start]]
    return ["".join(x) for x in letters], states


def fates(symbols: bytes, state: int, letters: str) -> list[tuple[list[str], str | None, list[str]]]:
    """Of each row: roles put in before it, its role (empty: its own, None: deleted) and, of the last one, roles put in after it."""
    out, waiting, i = [], [], 0
    for x in letters:
        if x == "I":
            state = NEXT[state]
            waiting.append(ROLE_INTO[state])
            continue
        state = next(to for letter, _, to in moves(state, symbols[i]) if letter == x)
        out.append((waiting, {"D": None, "K": "", "R": ROLE_INTO.get(state)}[x], []))
        waiting, i = [], i + 1
    if waiting:
        out[-1] = (*out[-1][:2], waiting)
    return out


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _map(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` gives for a batch the columns after those (``conv, chunk``) that are handed on."""

    def run(batches):
        state: dict = {}
        for batch in batches:
            rows = batch.to_pylist()
            made = [work(r, state) for r in rows]
            names = list(made[0]) if made else []
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[n] for m in made], TYPES[n]) for n in names)], names=["conv", "chunk", *names])

    return df.mapInArrow(run, schema)


TYPES = {
    "first": pa.int64(), "symbols": pa.binary(), "matrix": pa.list_(pa.int64()), "head": pa.string(), "tail": pa.string(), "illegal": pa.int64(),
    "after": pa.list_(pa.int64()), "last": pa.bool_(), "cost": pa.int64(), "letters": pa.list_(pa.string()), "exits": pa.list_(pa.int64()), "entry": pa.int64(), "crossing": pa.int64(),
}


def _matrix(row: dict, _: dict) -> dict:
    symbols = bytes(row["symbols"])
    columns = []
    for end in ENDS:
        vector, added = costs_before(symbols, end)
        columns.append([c if c >= INFINITE else c + added for c in vector])
    initials = row["initials"]
    # an empty initial would hide between two others
    said = "".join(x or "?" for x in initials)
    return {"first": row["first"], "symbols": symbols, "matrix": [c for column in columns for c in column], "head": said[0], "tail": said[-1], "illegal": _illegal(said)}


def _new(row: dict, state: dict) -> bool:
    """Whether another conversation begins here."""
    new = state.get("conv", state) is state or state["conv"] != row["conv"]
    state["conv"] = row["conv"]
    return new


def _costs(row: dict, state: dict) -> dict:
    """From the last chunk to the first: the costs after each, and from its start on."""
    if last := _new(row, state):
        state["vector"], state["added"] = END, 0
    after, m = state["vector"], row["matrix"]
    # a matrix holds true costs of a chunk; no sum of two that are finite comes near INFINITE beyond a chunk's rows
    ahead = [min(m[STATES * to + q] + after[to] for to in range(STATES)) for q in range(STATES)]
    vector, least = _normal(tuple(min(c, INFINITE) for c in ahead))
    state["vector"], state["added"] = vector, state["added"] + least
    return {"after": list(after), "last": last, "cost": state["added"] + vector[START]}


def _traces(row: dict, _: dict) -> dict:
    letters, exits = trace(row["symbols"], tuple(row["after"]), row["last"])
    return {"letters": letters, "exits": exits}


def _entries(row: dict, state: dict) -> dict:
    """From the first chunk to the last: the state at the start of each, and whether its first row follows the last one illegally."""
    if new := _new(row, state):
        state["at"], state["tail"] = START, ""
    entry, crossing = state["at"], 0 if new else _illegal(state["tail"] + row["head"])
    state["at"], state["tail"] = row["exits"][entry], row["tail"]
    return {"entry": entry, "crossing": crossing}


def _row_fates(batches):
    for batch in batches:
        for r in batch.to_pylist():
            found = fates(r["symbols"], r["entry"], r["letters"])
            columns = [pa.array([r["first"] + i for i in range(len(found))], pa.int64()), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.list_(pa.string()), pa.string(), pa.list_(pa.string()))))]
            yield pa.RecordBatch.from_arrays(columns, names=["mark_f", "put_before", "own", "put_after"])


def _digests(batches):
    """One SHA-256 a conversation over its lines, newline between, as they come."""
    state: dict = {}
    kind, hashed, began = None, None, False

    def done():
        return pa.RecordBatch.from_arrays([pa.array([state["conv"]], kind), pa.array([hashed.hexdigest()])], names=["conv", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, lines in zip(batch.column(0), batch.column(1)):
            held = state.get("conv")
            if _new({"conv": conv.as_py()}, state):
                if hashed is not None:
                    now, state["conv"] = state["conv"], held
                    yield done()
                    state["conv"] = now
                hashed, began = hashlib.sha256(), False
            if (lines := lines.as_py()) is not None:
                hashed.update((("\n" if began else "") + lines).encode())
                began = True
    if hashed is not None:
        yield done()


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` with ``blank`` and ``truncated`` (of those not blank)."""
    bare = F.rtrim("text", F.lit(SPACES))
    last = F.right(bare, F.lit(1))
    return rows.withColumns({"blank": bare == "", "truncated": (bare != "") & ~last.isin(".", "!", "?")})


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    blank_for_null = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank_for_null(role).alias("role"), blank_for_null(text).alias("text"))
    rows = in_order(rows.withColumn("md5", F.md5("text")), ["conv", "turn", "role", "md5"], "mark")
    kind = rows.schema["conv"].dataType.simpleString()
    narrow = with_faults(rows).drop("text")
    first = narrow.groupBy("conv", "role", "md5").agg(F.min("mark").alias("first_mark"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(*(F.col(c).alias(f"{c}_f") for c in ("conv", "role", "md5")), "first_mark")
    narrow = narrow.join(first, same([F.col(c) for c in ("conv", "role", "md5")], [F.col(f"{c}_f") for c in ("conv", "role", "md5")]), "left")
    narrow = narrow.withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("mark") > F.col("first_mark"), F.lit(False)))
    narrow = narrow.withColumn("truncated", F.col("truncated") & ~F.col("duplicate"))
    initial = F.left("role", F.lit(1))
    which = F.coalesce(*(F.when(initial == x, i) for i, x in enumerate(INITIALS)), F.lit(3))
    symbol = F.when(F.col("blank") | F.col("duplicate"), 0).otherwise(1 + 2 * which + F.col("truncated").cast("int"))
    narrow = cut(narrow.select("conv", "turn", "mark", "blank", "duplicate", "truncated", symbol.alias("symbol"), initial.alias("initial")))

    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = narrow.groupBy("conv").agg(gaps.cast("long").alias("gaps"), n("blank"), n("duplicate"), n("truncated"))

    chunks = narrow.groupBy("conv", F.shiftrightunsigned("mark", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("mark", "symbol", "initial"))).alias("r"))
    chunks = chunks.select("conv", "chunk", F.get("r.mark", F.lit(0)).alias("first"), F.col("r.symbol").alias("symbols"), F.col("r.initial").alias("initials"))
    key = f"conv {kind}, chunk long"
    chunks = cut(_map(chunks, _matrix, f"{key}, first long, symbols binary, matrix array<long>, head string, tail string, illegal long"))
    onto = lambda a, b: a.join(b.withColumnsRenamed({"conv": "conv_b", "chunk": "chunk_b"}), same([F.col("conv"), F.col("chunk")], [F.col("conv_b"), F.col("chunk_b")])).drop("conv_b", "chunk_b")
    costs = _map(chunks.select("conv", "chunk", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("chunk")), _costs, f"{key}, after array<long>, last boolean, cost long")
    chunks = cut(onto(chunks.drop("matrix"), costs))
    traced = cut(_map(chunks.select("conv", "chunk", "symbols", "after", "last"), _traces, f"{key}, letters array<string>, exits array<long>"))
    ends = onto(traced.drop("letters"), chunks.select("conv", "chunk", "head", "tail"))
    entries = _map(ends.repartition("conv").sortWithinPartitions("conv", "chunk"), _entries, f"{key}, entry long, crossing long")
    chunks = onto(onto(chunks.select("conv", "chunk", "first", "symbols", "cost", "illegal"), traced.drop("exits")), entries)
    chunks = cut(chunks.withColumn("letters", F.get("letters", F.col("entry").cast("int"))))
    audits = chunks.groupBy("conv").agg(
        F.sum(F.col("illegal") + F.col("crossing")).alias("illegal"),
        F.min_by("cost", "chunk").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "letters")))["letters"], "").alias("audit"),
    )

    done = chunks.select("symbols", "entry", "letters", "first").mapInArrow(_row_fates, "mark_f long, put_before array<string>, own string, put_after array<string>")
    line = lambda roles: F.transform(roles, lambda r: F.concat(r, F.lit(":")))
    own = F.when(F.col("own").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.when(F.col("own") == "", F.col("role")).otherwise(F.col("own")), F.lit(":"), "text")))
    lines = F.concat(line("put_before"), own, line("put_after"))
    pieces = rows.join(done, F.col("mark") == F.col("mark_f")).select("conv", "mark", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("lines"))
    hashes = pieces.repartition("conv").sortWithinPartitions("conv", "mark").select("conv", "lines").mapInArrow(_digests, f"conv {kind}, repaired_sha256 string")

    other = lambda df, name: df.withColumnRenamed("conv", name)
    out = counts.join(other(audits, "conv_a"), F.col("conv").eqNullSafe(F.col("conv_a"))).join(other(hashes, "conv_h"), F.col("conv").eqNullSafe(F.col("conv_h")))
    return out.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the query plants, by the CRC-32 of ``conv_id:turn``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), chance.alias("h")).filter("h <> 0")
    text: Column = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("h") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def op13_block_table_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "conv_f")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv_f")), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns({**zero, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}).drop("conv_f")


_SAID = "coalesce(CAST({} AS VARCHAR), ' ')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP13_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, {_SAID.format("role")} AS role, {_SAID.format("text")} AS text, {SQL_CRC32.format(f"{_SAID.format('conv_id')} || ':' || {_SAID.format('turn')}")} % 20 AS h FROM conversations
), dam AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src WHERE h <> 0)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, {_SPACES}) AS bare FROM dam
), again AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, left(role, 1) AS initial FROM ranked
), f AS MATERIALIZED (
  SELECT *, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || '>' || initial NOT IN ('s>u', 'u>a', 'a>u') AS illegal FROM again
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id
), ins(q, k, letters, q2) AS (
  VALUES (0, 0, '', 0), (1, 0, '', 1), (2, 0, '', 2), (3, 0, '', 3), (0, 1, 'I', 2), (1, 1, 'I', 2), (2, 1, 'I', 3), (3, 1, 'I', 2), (0, 2, 'II', 3), (1, 2, 'II', 3)
), mv(q, initial, op, q2, cost) AS (
  VALUES (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0), (0, 's', 'K', 1, 0),
    (0, '*', 'R', 2, {REROLE}), (1, '*', 'R', 2, {REROLE}), (3, '*', 'R', 2, {REROLE}), (2, '*', 'R', 3, {REROLE}),
    (0, '*', 'D', 0, {DELETE}), (1, '*', 'D', 1, {DELETE}), (2, '*', 'D', 2, {DELETE}), (3, '*', 'D', 3, {DELETE})
), g(conv_id, i, q, best) AS (
  SELECT conv_id, n + 1, q, printf('%08d', {INSERT} * k) || letters FROM counts, ins WHERE q2 IN (0, 3) AND (q, k) IN ((0, 0), (1, 2), (2, 1), (3, 0))
  UNION ALL
  SELECT g.conv_id, g.i - 1, ins.q, min(printf('%08d', CAST(left(g.best, 8) AS INTEGER) + {INSERT} * ins.k + mv.cost + CASE WHEN f.truncated AND mv.op <> 'D' THEN 1 ELSE 0 END) || ins.letters || mv.op || substr(g.best, 9))
  FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i - 1
  JOIN mv ON mv.q2 = g.q AND mv.initial IN ('*', f.initial) AND (mv.op = 'D' OR NOT f.blank AND NOT f.duplicate) JOIN ins ON ins.q2 = mv.q
  GROUP BY g.conv_id, g.i - 1, ins.q
), won AS (
  SELECT conv_id, CAST(left(best, 8) AS BIGINT) AS cost, substr(best, 9) AS audit FROM g WHERE i = 1 AND q = 0
), step AS (
  SELECT conv_id, p, substr(audit, p, 1) AS op FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM won)
), placed AS (
  SELECT *, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w AS j FROM step WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), line AS (
  SELECT a.conv_id, a.p, a.op, f.role, f.text, a.j - max(CASE WHEN a.j = 1 AND a.op = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS j
  FROM placed a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = a.i WHERE a.op <> 'D'
), said AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role ELSE CASE WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM line GROUP BY conv_id
)
SELECT c.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated, coalesce(k.illegal, 0) AS illegal,
  coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(s.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""
