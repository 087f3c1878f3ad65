"""Conversation repair against a search over edit letters, one by one, that shares nothing with the operator."""

import hashlib
import random
import re
import zlib

import pytest

from creditflow.llm import conversation_repair, queries

NAMES = {"s": "system", "u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(turns):
    """(cost, letters, [(initial, turn or None)]) by an automaton: 0 nothing yet, 1 after s, 2 after u, 3 after a."""
    state_of, allowed = {"s": 1, "u": 2, "a": 3}, {0: "su", 1: "u", 2: "a", 3: "u"}

    def offer(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    def inserted(best):
        for _ in range(4):
            for state, (cost, letters, roles) in list(best.items()):
                x = "a" if state == 2 else "u"
                offer(best, state_of[x], (cost + 3, letters + "I", [*roles, (x, None)]))
        return best

    best = inserted({0: (0, "", [])})
    for i, (initial, gone, cut) in enumerate(turns):
        new = {}
        for state, (cost, letters, roles) in best.items():
            offer(new, state, (cost + 4, letters + "D", roles))
            for x in () if gone else allowed[state]:
                if x == initial or x != "s":
                    offer(new, state_of[x], (cost + (0 if x == initial else 3) + 3 * cut, letters + ("K" if x == initial else "R"), [*roles, (x, i)]))
        best = inserted(new)
    return min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])


def brute(rows):
    hurt, out = damaged(rows), []
    for conv in {r[0] for r in rows}:
        own = [r for r in hurt if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, turns, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            if fault:
                faults[fault] += 1
            seen.add((role, text))
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, roles = cheapest(turns)
        lines = [f"{NAMES[x]}:" if i is None else f"{own[i][2] if own[i][2][:1] == x else NAMES[x]}:{own[i][3]}" for x, i in roles]
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randint(1, 12)):
            text = rng.choice([None, "", " ", "a.", "b", "c!", "d ?\n", "e", "　", "long " * 3000])
            rows.append((conv if rng.random() < 0.9 else None, rng.choice([None, 0, 1, 2, 3, 5, 8, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "umpire", "User"]), text))
    for conv in (100, 101):  # long ones
        rows += [(conv, i, rng.choice(["user", "assistant", "system"]), rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice([".", ""])) for i in range(80)]
    return [*rows, *[(102, 1, "user", "same.")] * 30]


@pytest.mark.parametrize("segment_rows", [250_000, 30, 7])
def test_equals_brute_force(spark, segment_rows):
    """Nulls everywhere, repeated rows, ties; conversations that are cut into segments give the same results."""
    rows = odd_rows(5)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, at int, seg string")
    got = conversation_repair.repair(conversation_repair.damage(df), df, segment_rows=segment_rows).drop("repaired")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_parts_of_a_conversation_add_up():
    """The tables of two parts, put together, cost what the whole costs, wherever it is cut."""
    rng = random.Random(2)
    for _ in range(200):
        turns = [conversation_repair.Turn(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([0, 0, 0, 2])) for _ in range(rng.randint(1, 9))]
        whole = conversation_repair.costs(turns, conversation_repair.FINAL)
        spread = [x for t in turns for x in [(t.initial, t.gone, t.truncated), *[(t.initial, True, False)] * t.more]]
        made = conversation_repair.choose(turns, conversation_repair.FINAL)
        letters = "".join(made.letters[i] for i in range(len(turns))) + "I" * len(conversation_repair.AFTER[made.state])
        assert (whole[0][0], letters) == cheapest(spread)[:2]
        cut = rng.randint(0, len(turns))
        after = whole[cut]
        assert whole[0] == [min(x + y for x, y in zip(row, after, strict=True)) for row in conversation_repair.table(turns[:cut])]


def test_repaired_text_and_empty_tables(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "And?"), (1, 2, "user", "So")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = conversation_repair.repair(df, keep_text=True).first()
    assert hashlib.sha256(row["repaired"].encode()).hexdigest() == row["repaired_sha256"]
    assert (row["audit"], row["cost"], row["repaired"]) == ("IKKR", 9, "user:\nassistant:Hi.\nuser:And?\nassistant:So")
    none = df.limit(0)
    assert conversation_repair.repair(none).count() == 0
    left = conversation_repair.repair(none, df).first()
    assert (left["gaps"], left["cost"], left["audit"], left["repaired_sha256"]) == (0, 0, "", hashlib.sha256().hexdigest())


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_conversation_repair(spark, sf).collect()), key=str) == brute(rows)
