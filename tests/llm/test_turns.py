"""Conversation repair against a search over all edit scripts."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from flowkit.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, extra int, digest string, `kind` int, lost boolean"
SPACES = " \t\n\v\f\r"


def filled(value):
    return " " if value is None else str(value)


def targets(most):
    yield ""
    for pairs in range(1, most // 2 + 2):
        yield "ua" * pairs
        yield "s" + "ua" * pairs


def cheapest(rows):
    """(cost, audit) over all targets and alignments; rows are (initial, fault)."""
    best = None
    for target in targets(2 * len(rows) + 2):
        @cache
        def rest(i, j):
            ways = []
            if i == len(rows) and j == len(target):
                return 0, ""
            if i < len(rows):
                cost, audit = rest(i + 1, j)
                ways.append((cost + 4, "D" + audit))
                if j < len(target) and rows[i][1] not in ("blank", "duplicate"):
                    extra = 3 if rows[i][1] == "truncated" else 0
                    cost, audit = rest(i + 1, j + 1)
                    if rows[i][0] == target[j]:
                        ways.append((cost + extra, "K" + audit))
                    if target[j] in "ua":
                        ways.append((cost + extra + 3, "R" + audit))
            if j < len(target) and target[j] in "ua":
                cost, audit = rest(i, j + 1)
                ways.append((cost + 3, "I" + audit))
            return min(ways) if ways else (10 ** 9, "")

        found = (*rest(0, 0), target)
        best = found if best is None or found[:2] < best[:2] else best
    return best


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r[:4] for r in table if r[0] == conv):
            role, text = filled(role), filled(text)
            fault = zlib.crc32(f"{filled(conv)}:{filled(turn)}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(SPACES)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen
                          else None if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, target = cheapest([(r[1][:1], f) for r, f in zip(rows, faults)])
        names, parts, i = {"u": "user", "a": "assistant"}, [], 0
        goal = iter(target)
        for edit in audit:
            if edit == "D":
                i += 1
                continue
            initial = next(goal)
            if edit == "I":
                parts.append(names[initial] + ":")
                continue
            parts.append(f"{rows[i][1] if edit == 'K' else names[initial]}:{rows[i][2]}")
            i += 1
        numbers = [r[0] for r in rows if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(parts).encode()).hexdigest())
    return out


def got(spark, table, chunk):
    rows = [(*r[:4], 1, "x", 5, None) for r in table]
    result = turns.repair_report(spark.createDataFrame(rows, SCHEMA), chunk)
    rows = [tuple(r) for r in result.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def conversations(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    texts = ["Yes.", "No!", "well", "", " \t", None, "Why?\n", "Ça va.", "b.c"]
    out = []
    for conv in [None, *range(n)]:
        turn = 0
        for _ in range(rng.randint(1, 7)):
            out.append((conv, turn if rng.random() > 0.05 else None, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 3])
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_every_script_is_the_cheapest(spark, chunk):
    table = conversations(7, 150)
    assert got(spark, table, chunk) == expected(table)


def test_small_batches_change_nothing(spark):
    table = conversations(8, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert got(spark, table, 2) == expected(table)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    table = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    result = {r[0]: tuple(r[1:]) for r in turns.repair_report(rows).collect()}
    assert result == expected(table)


def test_giant_conversation_leaves_in_chunks(spark):
    n = 20_000
    rows = spark.range(n).selectExpr(
        "1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('turn ', id, '.') text")
    script = turns.repair(rows, chunk=1000)
    assert script.where("edit = 'K'").count() == n
    chunks = turns._pointer_chunks(turns._codes(turns._prepared(rows, None)), 1000)
    assert {len(r["pointers"]) for r in chunks.collect()} == {1000}


def test_script_rows(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "Hi."), (1, 1, "user", "cut"), (1, 2, "assistant", "Yes.")],
        "conv_id long, turn long, role string, text string")
    script = [tuple(r) for r in turns.repair(rows).collect()]
    assert [(r[1], r[2], r[3]) for r in script] == [(0, "K", None), (1, "D", "truncated"), (2, "K", None)]
    assert script[0][1] == 0 and script[-1][6:] == ("assistant", "Yes.")


def test_lost_and_empty(spark, nothing):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_report(empty).collect() == []
    lost = spark.createDataFrame([(3, 1, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert [(r["conv_id"], r["edit"]) for r in turns.repair(lost, "gone").collect()] == [(3, None)]
    row = turns.report(turns.repair(lost, "gone")).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_shuffle_for_light_rows_and_one_for_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = turns.repair_report(rows)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2
