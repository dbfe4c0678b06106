"""Conversation repair against a search through all edits, cheapest first."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

pytest.importorskip("skillweft.llm")

from skillweft.llm import conversation_repair, queries  # noqa: E402

SHOWN = r"[^\x20\x09-\x0D]"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(turns):
    """(cost, letters, lines) of the cheapest edit, ties to the least letters; ``turns``: (role, text, fault)."""
    heap, done = [(0, "", 0, "")], set()
    sound = re.compile("(s?(ua)+)?")
    while True:
        cost, letters, at, initials = heapq.heappop(heap)
        if at == len(turns) and sound.fullmatch(initials):
            return cost, letters
        # paths that differ only in letters are all followed: ties go by letters
        if not any(sound.fullmatch(initials + rest) for rest in ("", "a", "ua")) or letters.endswith("III"):
            continue
        steps = [("I", 3, 0, role) for role in "ua"]
        if at < len(turns):
            role, _, fault = turns[at]
            steps.append(("D", 4, 1, ""))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                steps += [("K", more, 1, role[:1] or "?"), *(("R", 3 + more, 1, x) for x in "ua")]
        for letter, price, used, initial in steps:
            state = (cost + price, letters + letter, at + used, initials + initial)
            if state not in done:
                done.add(state)
                heapq.heappush(heap, state)


def lines_of(turns, letters):
    out, at, names = [], 0, {"u": "user", "a": "assistant"}
    for letter in letters:
        expected = "a" if out and out[-1][0][:1] == "u" else "u"
        if letter == "I":
            out.append((names[expected], ""))
            continue
        role, text, _ = turns[at]
        at += 1
        if letter == "K":
            out.append((role, text))
        elif letter == "R":
            out.append((names[expected], text))
    return [f"{role}:{text}" for role, text in out]


def brute_rows(rows):
    """conv_id -> the row of the query."""
    result = {}
    damaged = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, turns, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            shown = re.findall(SHOWN, text)
            fault = (
                "blank" if not shown else "duplicate" if (role, text) in seen
                else "truncated" if shown[-1] not in ".!?" else ""
            )
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                count[fault] += 1
        at = [r[1] for r in own if r[1] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, letters = brute_repair(turns)
        lines = lines_of(turns, letters)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (gaps, *count.values(), illegal, cost, letters, digest)
    return result


SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, position int, edit string, copy int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], SCHEMA)


def random_rows(rng, conversations):
    rows = []
    for conv in range(conversations):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "user", "tool", "assistant", ""]])
        for turn in range(rng.randrange(1, 8)):
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", "End. ", "Why?\n", "é", None, f"{turn}."])
            role = None if rng.random() < 0.03 else roles[turn % len(roles)]
            number = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2])
            rows += [(conv, number, role, text)] * rng.choice([1, 1, 1, 1, 2])
    rows += [(None, None, "user", "A."), (None, 1, "assistant", "B."), (None, 1, "assistant", "B")]
    return rows


def answered(spark, folder):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in queries.op11(spark, str(folder)).collect()}


@pytest.mark.parametrize("batch", [2000, 3])
def test_query_equals_a_search_through_all_edits(spark, tmp_path, batch):
    rows = random_rows(random.Random(5), 120)
    turns_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = answered(spark, tmp_path)
    finally:
        spark.conf.set(key, before)
    assert got == brute_rows(rows)
    assert {letter for row in got.values() for letter in row[6]} == set("DIKR")
    assert len({row[5] for row in got.values()}) > 5


def test_table_equals_the_search_on_symbols():
    rng = random.Random(2)
    table = conversation_repair.RepairTable()
    assert all(len(row) == 9**conversation_repair.BLOCK for row in table.to)
    for _ in range(300):
        symbols = bytes(rng.choices(range(9), k=rng.randrange(0, 7)))
        faults = ["blank" if s == 8 else "truncated" if s & 1 else "" for s in symbols]
        turns = [("sua?u"[s >> 1], "", f) for s, f in zip(symbols, faults)]
        assert table.solve(symbols) == brute_repair(turns)


def test_blocks_of_any_size_agree():
    rng = random.Random(4)
    tables = [conversation_repair.RepairTable(size) for size in (1, 2, 3, 4)]
    for size in (5, 40, 401, 5_003):
        symbols = bytes(rng.choices(range(9), weights=[1, 1, 9, 2, 9, 2, 1, 1, 2], k=size))
        answers = {t.solve(symbols) for t in tables}
        assert len(answers) == 1


def test_a_long_conversation_beside_short_ones(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(30_000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    turns = turns_of(spark, rows)
    repairs = conversation_repair.find_repairs(turns)
    assert sorted((r["conv_id"], r["cost"], len(r["audit"]), set(r["audit"]) == {"K"}) for r in repairs.collect()) == [
        (1, 0, 30_000, True), (2, 0, 2, True),
    ]
    repaired = conversation_repair.apply_repairs(turns, repairs)
    assert repaired.count() == 30_002 and repaired.columns == ["conv_id", "position", "role", "text", "edit"]
    text = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:30_000])
    digests = {r["conv_id"]: r["sha256"] for r in conversation_repair.conversation_digests(repaired).collect()}
    assert digests[1] == hashlib.sha256(text.encode()).hexdigest()


def test_repaired_turns_and_their_edits(spark):
    rows = [(7, 0, "assistant", "One."), (7, 1, "user", "Two"), (7, 2, "tool", "Three."), (8, 0, "user", "")]
    turns = turns_of(spark, rows)
    repaired = conversation_repair.apply_repairs(turns, conversation_repair.find_repairs(turns))
    got = [(r["conv_id"], r["position"], r["role"], r["text"], r["edit"]) for r in repaired.collect()]
    cost, letters = brute_repair([("assistant", "One.", ""), ("user", "Two", "truncated"), ("tool", "Three.", "")])
    assert "".join(x[4] for x in got) == letters.replace("D", "") and cost > 0
    assert [x[:2] for x in got] == [(7, k) for k in range(len(got))]
    assert "".join(x[2][0] for x in got) in ("ua", "uaua")


def test_conversations_that_lose_all_turns_and_empty_tables(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns_of(spark, [(dropped, 0, "user", "Hi.")]).write.parquet(str(tmp_path / "a" / "conversations.parquet"))
    empty = hashlib.sha256(b"").hexdigest()
    assert answered(spark, tmp_path / "a") == {dropped: (0, 0, 0, 0, 0, 0, "", empty)}
    turns_of(spark, []).write.parquet(str(tmp_path / "b" / "conversations.parquet"))
    assert answered(spark, tmp_path / "b") == {}
