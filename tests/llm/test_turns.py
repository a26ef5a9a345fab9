"""Conversation repair against shortest paths, a full CYK chart and all edits."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from mediascore.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def hurt(rows):
    """The rows after the damage, in order."""
    one = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def in_order(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))


def told(rows):
    """(initial, fault) of rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def shortest(items):
    """(cost, audit) by going through the rows with the places of the pattern."""
    def closed(at):
        for _ in range(4):
            for p, (c, a) in list(at.items()):
                for r in "ua":
                    q = turns.STEP.get((p, r))
                    if q is not None:
                        at[q] = min(at.get(q, (c + 2, a + "I")), (c + 2, a + "I"))
        return at

    at = closed({0: (0, "")})
    for initial, fault in items:
        new = {}
        for p, (c, a) in at.items():
            options = [(p, c + 3, "D")]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options += [(turns.STEP.get((p, initial)), c + extra, "K")] + [(turns.STEP.get((p, r)), c + 2 + extra, "R") for r in "ua"]
            for q, cost, e in options:
                if q is not None:
                    new[q] = min(new.get(q, (cost, a + e)), (cost, a + e))
        at = closed(new)
    return min(at[q] for q in (0, 3) if q in at)


def lines(rows, audit):
    out, left = [], list(rows)
    for e in audit:
        row = None if e == "I" else left.pop(0)
        if e == "D":
            continue
        start = bool(out) and out[0][0][:1] == "s" and out[0][2]
        wanted = "user" if (len(out) - start) % 2 == 0 else "assistant"
        out.append((row[2] if e == "K" else wanted, "" if e == "I" else row[3], e == "K"))
    assert not left and PATTERN.fullmatch("".join(r[:1] for r, _, _ in out))
    return [f"{r}:{t}" for r, t, _ in out]


def expected(every, rows):
    out = []
    for conv in {r[0] for r in every}:
        own = in_order([r for r in rows if r[0] == conv])
        items = told(own)
        n = lambda f: sum(x[1] == f for x in items)
        numbers = {r[1] for r in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        cost, audit = shortest(items) if own else (0, "")
        text = "\n".join(lines(own, audit))
        out.append((conv, gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_cells_against_all_edits():
    """Every sequence of edits of up to four rows, with up to two insertions at each place."""
    rng = random.Random(1)
    for _ in range(60):
        items = [(rng.choice("suaxu"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 3))]
        best = None
        slots = [["", "I", "II"]] * (len(items) + 1)
        for edits in itertools.product("KRD", repeat=len(items)):
            if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, items)):
                continue
            for gaps in itertools.product(*slots):
                audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:]))
                cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[c] for c in audit) + sum(e != "D" and f == "truncated" for e, (_, f) in zip(edits, items))
                kept = iter(zip(edits, items))
                roles = ["?" if c == "I" else None for c in audit]
                for k, c in enumerate(audit):
                    if c != "I":
                        e, (initial, _) = next(kept)
                        roles[k] = "" if e == "D" else "?" if e == "R" else initial
                if not re.fullmatch(r"([s]?([u?][a?])+)?", "".join(roles)):
                    continue
                best = min(best or (cost, audit), (cost, audit))
        cells = [turns.row_cells(i if i in "sua" else "", f in ("blank", "duplicate"), f == "truncated") for i, f in items]
        assert turns.cheapest(turns.parsed(cells)) == best == shortest(items)


def test_one_cut_gives_the_cell_of_all_cuts():
    rng = random.Random(2)
    for _ in range(40):
        leaves = [turns.row_cells(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 12))]
        n = len(leaves)
        chart = {(i, i + 1): c for i, c in enumerate(leaves)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                best = {}
                for k in range(i + 1, i + size):
                    for key, cell in turns.joined(chart[i, k], chart[k, i + size]).items():
                        best[key] = min(best.get(key, cell), cell)
                chart[i, i + size] = best
        assert chart[0, n] == turns.parsed(leaves)


def conversations(seed, n=120):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", "  \n", "Go on. ", "a.b", "é?", "same.", "long " * 50 + "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", ""]), rng.choice(texts) if rng.random() < 0.5 else f"t{turn}."))
    # a hot conversation with a third of all rows, most of them equal at other turns
    rows += [(n, t, ["user", "assistant"][t % 2], "ok." if t % 3 else f"turn {t}!") for t in range(0, len(rows) // 2)]
    rows += [(None, None, None, None), (None, 1, "user", None), (None, 1, "user", "x."), (None, None, "assistant", "y."), (n + 1, None, "user", "x."), (n + 1, None, "user", "x."), (n + 1, 3, "user", "x."), (n + 1, 9, "assistant", "z.")]
    return rows + [(n + 2, 5, "user", "Hi.")] * 7 + [(n + 3, 1, "user", "long. " * 20000)]


@pytest.mark.parametrize("block_rows", [3, turns.BLOCK_ROWS])
def test_against_shortest_paths(spark, block_rows):
    rows = conversations(5)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(9)).withColumn("digest", F.lit(1)).withColumn("audit", F.lit(""))
    got = turns.report(table, turns.damaged(table), block_rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, hurt(rows))


def test_dropped_rows_and_empty_table(spark):
    gone = [(c, t, "user", "x.") for c in range(40) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:2]
    for rows in ([], gone):
        table = spark.createDataFrame(rows, SCHEMA)
        got = sorted((tuple(r) for r in turns.report(table, turns.damaged(table)).collect()), key=str)
        assert got == expected(rows, []) and all(g[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for g in got)


def test_repaired_rows(spark):
    rows = conversations(8, 30)
    table = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in turns.repaired(table, 4).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = in_order([r for r in clean if r[0] == conv])
        assert got.get(conv, []) == lines(own, shortest(told(own))[1])


def test_sql(spark):
    rows = conversations(9, 60)
    table = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("conversations", table.toArrow())
    cursor = con.execute(turns.oracle())
    assert [c[0] for c in cursor.description] == turns.report(table, turns.damaged(table)).columns
    assert sorted(cursor.fetchall(), key=str) == expected(rows, hurt(rows))
