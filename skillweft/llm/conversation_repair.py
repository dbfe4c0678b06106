r"""Repair of conversation structure by a cheapest, tie-safe edit of the turns.

A sound conversation has the role initials ``(s?(ua)+)?``.  Turns are kept (0), given the
role user or assistant (3), deleted (4; blank and repeated turns have to go) or joined
by inserted empty turns of either role (3); a truncated turn that stays costs 3 more.  Of
the cheapest edits the one whose initials (D, I, K, R in turn order) come first in ASCII
is taken.

The cost of repairing what follows depends on the turns only through four numbers: one
for each of the states nothing yet, after a system turn, after a user turn and after an
assistant turn.  Inserting, deleting and renaming tie these numbers together, so that
after their minimum is subtracted only a few vectors ever occur.  For each of them and
every block of ``BLOCK`` symbols (role and fault of a turn, nine of them) a table holds
the vector before the block and what the minimum grew by (the method of the Four
Russians).  A conversation is read from its end, one lookup a block; then each block is
expanded backward from the vector behind it and walked forward, always by the smallest
letter that stays on a cheapest path.  Every letter leads from a state to exactly one
state, so the walk cannot miss the least of all cheapest edits.

Two sorted passes stream through the turns: the first reads roles, faults and digests and
leaves one row a conversation, the second applies the edits.  A task holds, of one
conversation at a time, a digest per different turn and one letter per turn, never its
texts.

Cases: turns are taken by (turn, role, text), nulls first; null roles and texts are
empty; a null ``conv_id`` is a conversation of its own; repeated rows count as turns (and
are duplicates); roles that begin with none of s, u, a cannot be kept; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from skillweft.llm.worker import bound_batches, process_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where the next user or assistant turn leads from each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Symbol of a turn: twice the place of its initial here, plus one if it is truncated; the last for turns that must go.
INITIALS = "sua"
SYMBOLS = 9
MUST_GO = 8
INFINITE = 1 << 20

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FINE, TRUNCATED, BLANK = range(3)

AUDIT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
)


def kept_state(state: int, symbol: int) -> int | None:
    """Where keeping a turn leads, if it may follow."""
    role = symbol >> 1
    if role == 0 and state == NOTHING:
        return SYSTEM
    return NEXT[state] if role < 3 and INITIALS[role] == ("a" if NEXT[state] == ASSISTANT else "u") else None


def _insertions(costs: np.ndarray) -> np.ndarray:
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[..., NEXT])
    return costs


def before(symbol: int, after: np.ndarray) -> np.ndarray:
    """Costs per state (last axis) in front of a turn, given those behind it."""
    costs = DELETE + after
    if symbol != MUST_GO:
        stays = CUT_OFF * (symbol & 1)
        costs = np.minimum(costs, RENAME + stays + after[..., NEXT])
        for state in range(4):
            to = kept_state(state, symbol)
            if to is not None:
                costs[..., state] = np.minimum(costs[..., state], stays + after[..., to])
    return _insertions(costs)


def at_end() -> np.ndarray:
    return _insertions(np.array([0, INFINITE, INFINITE, 0]))


class RepairTable:
    """Transitions of all blocks between all normalised cost vectors that occur."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = at_end()
        self.vectors = [tuple(map(int, end - end.min()))]
        self.end_cost = int(end.min())
        known = {self.vectors[0]: 0}
        self.to: list[list[int]] = []
        self.grown: list[list[int]] = []
        while len(self.to) < len(self.vectors):
            costs = np.array([self.vectors[len(self.to)]])
            for _ in range(block):  # the symbol nearest the start counts most in a block's number
                costs = np.concatenate([before(symbol, costs) for symbol in range(SYMBOLS)])
            least = costs.min(axis=1)
            rows = []
            for vector in map(tuple, (costs - least[:, None]).tolist()):
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
                rows.append(known[vector])
            self.to.append(rows)
            self.grown.append(least.tolist())
        self.walk = functools.lru_cache(maxsize=200_000)(self._walk)

    def _walk(self, symbols: bytes, behind: tuple[int, ...], state: int) -> tuple[str, int]:
        """Letters of a block and the state behind it, on the least cheapest path that enters in ``state``."""
        costs = [np.array(behind)]
        for symbol in reversed(symbols):
            costs.append(before(symbol, costs[-1]))
        costs = [x.tolist() for x in reversed(costs)]
        letters = []
        for symbol, here, after in zip(symbols, costs, costs[1:]):
            stays = CUT_OFF * (symbol & 1)
            while True:
                if DELETE + after[state] == here[state]:
                    letters.append("D")
                    break
                if INSERT + here[NEXT[state]] == here[state]:
                    letters.append("I")
                    state = NEXT[state]
                    continue
                to = kept_state(state, symbol)
                if to is not None and stays + after[to] == here[state]:
                    letters.append("K")
                    state = to
                else:
                    letters.append("R")
                    state = NEXT[state]
                break
        return "".join(letters), state

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """(cost, letters) of the least cheapest repair."""
        head = len(symbols) % self.block
        places = range(head, len(symbols), self.block)
        vector, cost = 0, self.end_cost
        behind = []
        for at in reversed(places):
            behind.append(vector)
            number = 0
            for symbol in symbols[at:at + self.block]:
                number = number * SYMBOLS + symbol
            cost += self.grown[vector][number]
            vector = self.to[vector][number]
        costs = np.array(self.vectors[vector])
        for symbol in reversed(symbols[:head]):
            costs = before(symbol, costs)
        cost += int(costs[NOTHING])
        letters, state = self.walk(symbols[:head], self.vectors[vector], NOTHING)
        parts = [letters]
        for at, vector in zip(places, reversed(behind)):
            letters, state = self.walk(symbols[at:at + self.block], self.vectors[vector], state)
            parts.append(letters)
        parts.append({NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state])
        return cost, "".join(parts)


def _table() -> RepairTable:
    cache = process_cache("conversation_repair")
    if "table" not in cache:
        cache["table"] = RepairTable()
    return cache["table"]


class _Conversation:
    """What is known of one conversation while its turns pass by."""

    def __init__(self):
        self.symbols = bytearray()
        self.seen: set[bytes] = set()
        self.counts = {BLANK: 0, TRUNCATED: 0}
        self.duplicates = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.initial = None

    def add(self, turn: int | None, initial: str, fault: int, digest: bytes) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        repeated = digest in self.seen
        self.seen.add(digest)
        if fault == BLANK or not repeated:
            if fault != FINE:
                self.counts[fault] += 1
        else:
            self.duplicates += 1
        if fault == BLANK or repeated:
            self.symbols.append(MUST_GO)
        else:
            place = INITIALS.find(initial) if initial else -1
            self.symbols.append(2 * (place if place >= 0 else 3) + (fault == TRUNCATED))

    def result(self, table: RepairTable) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        counts = (gaps, self.counts[BLANK], self.duplicates, self.counts[TRUNCATED], self.illegal)
        return (*counts, *table.solve(bytes(self.symbols)))


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def fault(text: Column) -> Column:
    """Blank before truncated; whether a turn repeats an earlier one needs the others."""
    shown = F.rtrim(text, F.lit(SPACE))
    return F.when(shown == "", BLANK).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)


def _kind(df: DataFrame) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}"


def find_repairs(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, counts of faults, ``cost`` and ``audit`` (the initials of the edits)."""
    bound_batches(turns.sparkSession)
    rows = (
        _turns(turns).repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
        .select(
            "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), fault(F.col("text")).alias("fault"),
            F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        current, open_one = None, None
        names = ["conv_id", *(x.split()[0] for x in AUDIT.split(", "))]

        def out(ids, found):
            columns = list(zip(*found))
            kinds = [pa.int64()] * 6 + [pa.string()]
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

        id_type = None
        for batch in batches:
            done_ids, done = [], []
            id_type = batch.schema.field(0).type
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if open_one is None or conv != current:
                    if open_one is not None:
                        done_ids.append(current)
                        done.append(open_one.result(table))
                    current, open_one = conv, _Conversation()
                open_one.add(*turn)
            if done:
                yield out(pa.array(done_ids, id_type), done)
        if open_one is not None:
            yield out(pa.array([current], id_type), [open_one.result(table)])

    return rows.mapInArrow(run, f"{_kind(turns)}, {AUDIT}")


def _edited(letters: Iterator[str], state: int) -> Iterator[tuple[str, int]]:
    """The letters up to and with the next one for a turn, each with the state it leads to (K: still open)."""
    for letter in letters:
        if letter in "IR":
            state = NEXT[state]
        yield letter, state
        if letter != "I":
            return


def apply_repairs(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id``, ``position`` (from 0), ``role``, ``text`` and ``edit`` (I, K or R).

    ``repairs`` has ``conv_id`` and ``audit`` of the same turns.  The turns of a
    conversation lie together in one partition, in order.
    """
    bound_batches(turns.sparkSession)
    own = _turns(turns).withColumn("audit", F.lit(None).cast("string"))
    edits = repairs.select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), "audit",
    )
    rows = own.unionByName(edits).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("audit").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {USER: "user", ASSISTANT: "assistant"}
        letters: Iterator[str] = iter("")
        conv, state, position, id_type = None, NOTHING, 0, pa.null()
        found: list[tuple] = []

        def add(role, text, letter):
            nonlocal position
            found.append((conv, position, role, text, letter))
            position += 1

        def finish():
            nonlocal state
            for letter in letters:  # behind the last turn there are only insertions
                state = NEXT[state]
                add(names[state], "", letter)

        def flush():
            columns = list(zip(*found))
            found.clear()
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            labels = ["conv_id", "position", "role", "text", "edit"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], labels)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for own_conv, _, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    finish()
                    conv, state, position, letters = own_conv, NOTHING, 0, iter(audit)
                    continue
                for letter, to in _edited(letters, state):
                    if letter == "I":
                        add(names[to], "", letter)
                    elif letter == "R":
                        add(names[to], text, letter)
                    elif letter == "K":
                        to = SYSTEM if to == NOTHING and role[:1] == "s" else NEXT[to]
                        add(role, text, letter)
                    state = to
                if len(found) >= 1_000:
                    yield flush()
        finish()
        if found:
            yield flush()

    return rows.mapInArrow(run, f"{_kind(turns)}, position bigint, role string, text string, edit string")


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of its ``role:text`` lines, newline-joined.

    Takes the rows as :func:`apply_repairs` gives them: in order, nothing shuffled between.
    Conversations without turns have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        conv, digest, id_type = None, None, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, digests = [], []
            for own_conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    if digest is not None:
                        ids.append(conv)
                        digests.append(digest.hexdigest())
                    conv, digest = own_conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(digests, pa.string())], ["conv_id", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], id_type), pa.array([digest.hexdigest()])], ["conv_id", "sha256"]
            )

    rows = repaired.select("conv_id", "position", "role", "text")
    return rows.mapInArrow(run, f"{_kind(repaired)}, sha256 string")
