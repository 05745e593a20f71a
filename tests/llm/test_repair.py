import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from corepick.llm import repair as r
from tests.llm.helpers import SF, run_sql, same_rows

SCHEMA = "conv_id long, turn long, role string, text string, mark string, chunk string"


def plain(symbols):
    """The cheapest edits and the least letters among them, by best-first search over (cost, letters)."""
    heap, seen = [(0, "", 0, r.START)], set()
    while heap:
        cost, letters, i, q = heapq.heappop(heap)
        if i == len(symbols) and q in r.ACCEPTS:
            return cost, letters
        if (i, q) in seen:
            continue
        seen.add((i, q))
        heapq.heappush(heap, (cost + 2, letters + "I", i, {0: 2, 1: 2, 2: 3, 3: 2}[q]))
        if i == len(symbols):
            continue
        s = symbols[i]
        heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q))
        if s:
            role, late = "uasx"[(s - 1) // 2], (s - 1) % 2
            for to, name in ((2, "u"), (3, "a")):
                if (to == 2) == (q != 2):
                    heapq.heappush(heap, (cost + late + (0 if role == name else 2), letters + ("K" if role == name else "R"), i + 1, to))
            if role == "s" and q == 0:
                heapq.heappush(heap, (cost + late, letters + "K", i + 1, 1))
    raise AssertionError


def whole(symbols):
    normal, added = r.costs_before(symbols, r.END)
    return normal[r.START] + added, r.trace(symbols, r.END, True)[0][r.START]


def test_tables_equal_a_search_over_all_short_conversations():
    for n in range(5):
        for s in itertools.product(range(r.SYMBOLS), repeat=n):
            assert whole(bytes(s)) == plain(s), s


def test_tables_equal_a_search_over_long_conversations():
    rng = random.Random(1)
    for _ in range(300):
        s = bytes(rng.choices(range(9), [1, 4, 1, 4, 1, rng.random(), 0.2, 0.5, 0.2], k=rng.randrange(5, 60)))
        assert whole(s) == plain(s), s
    assert len(r.tables().vectors) < 100 and r.tables().to.shape[1] == r.SYMBOLS**r.BLOCK


def test_query_equals_sql(spark):
    same_rows(r.op13_block_table_repair(spark, SF).toPandas(), run_sql(r.OP13_SQL))


def plain_rows(rows):
    """The contract in plain Python over rows ``conv_id, turn, role, text``."""
    groups = {x[0]: [] for x in rows}
    for conv, turn, role, text, *_ in rows:
        said = lambda x: " " if x is None else str(x)
        role, text, h = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        groups[conv] += [(turn is not None, turn or 0, "user" if h == 4 else role, hashlib.md5(text.encode()).hexdigest(), text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort()
        seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in own:
            bare = text.rstrip(r.SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append(0 if fault in ("blank", "duplicate") else 1 + 2 * ("uas".find(role[:1]) if role[:1] and role[0] in "uas" else 3) + (fault == "truncated"))
        turns = [t for has, t, *_ in own if has]
        illegal = sum((a[2][:1], b[2][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(own, own[1:]))
        cost, audit = plain(symbols)
        lines, i, expect = [], 0, "user"
        for x in audit:
            role, text = (own[i][2], own[i][4]) if x != "I" else ("", "")
            if x != "D":
                if x == "K" and role[0] == "s":
                    lines.append(f"{role}:{text}")
                else:
                    lines.append(f"{role if x == 'K' else expect}:{text}")
                    expect = "assistant" if expect == "user" else "user"
            i += x != "I"
        gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got_rows(df):
    return sorted((tuple(x) for x in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("bits", [r.CHUNK_BITS, 2])
def test_hard_rows_equal_plain_python_and_sql(spark, tmp_path, monkeypatch, bits):
    """With chunks of 4 rows every conversation is put together from several."""
    monkeypatch.setattr(r, "CHUNK_BITS", bits)
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", "User", "", None, "usher"], ["Yes.", "no", "", None, " \t\x0b\n", "Done!\n ", "é\U0001f600?", "a ", "long. " * 50_000]
    pick = lambda: (rng.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], rng.choices([*texts, f"text {rng.random()}."], [3, 2, 1, 1, 1, 1, 1, 1, 0.05, 9])[0])
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(-3, 30)]), *pick(), "m", "c") for _ in range(1200)]
    rows += [(1000, t, *pick(), "m", "c") for t in range(1500)]  # one conversation holds more than half of all rows
    rows += [(2000, 1, "user", "Same.", "m", "c")] * 30 + [(c, 0, "user", "Hi.", "m", "c") for c in range(3000, 3060)]
    folder = write(spark, tmp_path, rows)
    got = r.op13_block_table_repair(spark, folder)
    assert got_rows(got) == plain_rows(rows)
    if bits == 2:
        same_rows(got.toPandas(), run_sql(r.OP13_SQL, folder))


def test_empty_table(spark, tmp_path):
    assert r.op13_block_table_repair(spark, write(spark, tmp_path, [])).collect() == []
