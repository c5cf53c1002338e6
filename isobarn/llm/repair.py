"""Conversation structure repair by block tables (operator 13).

A conversation's rows, by turn, are edited at least cost so that its roles read as an optional system turn and then pairs
of user and assistant. What matters of a row is one symbol (role, and whether it must go or is cut short), and what matters of the rows
behind it is a vector: the least cost from each of four states of the pattern. Vectors less their minimum are few, so the step
from one to the next is tabulated for every block of BLOCK symbols (the Four Russians' method). A conversation is read from
its end, a lookup a block. Decisions are then taken from the front: each block is expanded backward, from the vector behind it, to
the vectors within, and at each place the least letter among the edits that keep the least cost is taken. So of all cheapest edits
the ASCII-least string is found.

Rows of a conversation meet in one task in order, first without texts and then with them. The task holds two bytes a row, no
texts, whatever the conversation's length.

Defined results: null role, text and parts of the key count as one space; rows of one turn are ordered by role and text;
repeated rows are duplicates; conversations whose rows are all dropped, or that have none that may stay, give an empty audit and the
hash of the empty string; null conv_id is a conversation; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobarn.llm.common import prepare

#: Symbols of a block that is looked up at once.
BLOCK = 4
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. From each: state and role of the next user or assistant turn.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Least cost from each state if no row follows: missing turns are inserted, and a system turn alone is no conversation.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: a row that must go, then each kind of role whole and cut short.
ROLES = "sua?"
GONE, SYMBOLS = 0, 1 + 2 * len(ROLES)


def symbol(initial: str, bad: bool, short: bool) -> int:
    return GONE if bad else 1 + 2 * (ROLES.find(initial) if initial in ("s", "u", "a") else 3) + short


def kept_state(state: int, sign: int) -> int | None:
    """The state after the row is kept, if it may be kept there."""
    role = ROLES[(sign - 1) // 2] if sign else "?"
    if role == "s":
        return 1 if state == 0 else None
    return NEXT[state] if ROLE[state][0] == role else None


def edits(state: int, sign: int) -> list[tuple[str, int, int]]:
    """Edits of a row in the order of their letters: letter, cost, next state. Inserting is apart, as it takes no row."""
    out = [("D", DELETE, state)]
    if sign:
        more = CUT_SHORT * ((sign - 1) % 2)
        if (then := kept_state(state, sign)) is not None:
            out.append(("K", KEEP + more, then))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def _before(behind: tuple[int, ...], sign: int) -> tuple[int, ...]:
    """Least cost from each state when a row of this symbol comes before."""
    own = [min(cost + behind[then] for _, cost, then in edits(q, sign)) for q in range(4)]
    for _ in range(2):  # an inserted turn may need another one
        own = [min(own[q], INSERT + own[NEXT[q]]) for q in range(4)]
    return tuple(own)


class BlockTables:
    """vectors: normalised costs by number. step, gain: number and added cost for one symbol more; block_step, block_gain: for a whole block."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, number = [END], {END: 0}
        step, gain = [], []
        for vector in self.vectors:  # grows until no new vector is found
            found = [_before(vector, sign) for sign in range(SYMBOLS)]
            for full in found:
                own = tuple(x - min(full) for x in full)
                if own not in number:
                    number[own] = len(self.vectors)
                    self.vectors.append(own)
            step.append([number[tuple(x - min(full) for x in full)] for full in found])
            gain.append([min(full) for full in found])
        self.step, self.gain = np.array(step), np.array(gain)
        # the last symbol of a block is the first to be taken, and the lowest digit of its number
        self.block_step, self.block_gain = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(block):
            more = self.gain[self.block_step].transpose(0, 2, 1).reshape(len(self.vectors), -1)
            self.block_gain = np.tile(self.block_gain, SYMBOLS) + more
            self.block_step = self.step[self.block_step].transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self._known: dict[tuple[int, int, int], tuple[str, int]] = {}

    def expanded(self, number: int, signs: bytes, state: int) -> tuple[str, int]:
        """Letters of these rows and the state after them, from `state` on; `number`: the vector behind them."""
        behind = [number]
        for sign in reversed(signs):
            behind.append(int(self.step[behind[-1], sign]))
        letters = []
        for i, sign in enumerate(signs):
            now, after = self.vectors[behind[len(signs) - i]], self.vectors[behind[len(signs) - i - 1]]
            added = int(self.gain[behind[len(signs) - i - 1], sign])
            while True:
                open_ = [(letter, then) for letter, cost, then in edits(state, sign) if cost + after[then] == added + now[state]]
                if open_ and (open_[0][0] == "D" or INSERT + now[NEXT[state]] != now[state]):
                    letters.append(open_[0][0])
                    state = open_[0][1]
                    break
                letters.append("I")
                state = NEXT[state]
        return "".join(letters), state

    def audit(self, signs: bytes) -> tuple[int, str]:
        """Least cost and the ASCII-least edits of that cost."""
        rest = len(signs) % self.block
        blocks = np.frombuffer(signs, np.uint8)[rest:].reshape(-1, self.block)
        codes = (blocks @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))).tolist()
        number, cost, behind = 0, 0, []
        for code in reversed(codes):
            behind.append(number)
            cost += int(self.block_gain[number, code])
            number = int(self.block_step[number, code])
        letters, state = self.expanded(number, signs[:rest], 0)
        for sign in reversed(signs[:rest]):
            cost += int(self.gain[number, sign])
            number = int(self.step[number, sign])
        parts, cost = [letters], cost + self.vectors[number][0]
        for i, code in enumerate(codes):
            key = (behind[-1 - i], code, state)
            if key not in self._known:
                at = rest + i * self.block
                self._known[key] = self.expanded(key[0], signs[at : at + self.block], state)
            letters, state = self._known[key]
            parts.append(letters)
        return cost, "".join(parts) + "I" * (END[state] // INSERT)


@cache
def tables() -> BlockTables:
    return BlockTables()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live: rows damaged by a checksum of conversation and turn; a dropped row stays with live = false."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    case = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    changed = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), case.alias("case"))
    rows = rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), "case")
    return rows.select("*", F.explode(F.expr("CASE WHEN case = 0 THEN array(false) WHEN case = 3 THEN array(true, true) ELSE array(true) END")).alias("live")).drop("case")


_LIGHT = ["conv_id", "phase", "turn", "role", "text", "live", "blank", "short", "seen"]
SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROWS = "conv_id bigint, place bigint, edit string, role string, text string"
#: Repaired rows handed on at a time.
OUT_ROWS = 500


class _Conversation:
    """What a task knows of the conversation that passes through it."""

    def __init__(self, conv_id):
        self.conv_id, self.signs, self.last, self.turn, self.turns, self.first_turn = conv_id, bytearray(), None, None, 0, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.letters, self.cost, self.at, self.state, self.place = None, 0, 0, 0, 0
        self.digest = hashlib.sha256()

    def look(self, turn, initial: str, blank: bool, short: bool, seen: bool) -> None:
        bad = blank or seen
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += short and not bad
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.turn
            self.turn = turn
        self.signs.append(symbol(initial, bad, short))

    def decide(self) -> None:
        if self.letters is None:
            self.cost, self.letters = tables().audit(bytes(self.signs))

    def _give(self, edit: str, role: str, text: str) -> tuple:
        self.digest.update(("\n" if self.place else "").encode() + f"{role}:{text}".encode())
        self.place += 1
        return self.conv_id, self.place - 1, edit, role, text

    def insertions(self) -> Iterator[tuple]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self._give("I", ROLE[self.state], "")
            self.state = NEXT[self.state]

    def take(self, role: str, text: str, sign: int) -> Iterator[tuple]:
        yield from self.insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            yield self._give("K", role, text)
            self.state = kept_state(self.state, sign)
        elif letter == "R":
            yield self._give("R", ROLE[self.state], text)
            self.state = NEXT[self.state]

    def summary(self) -> tuple:
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turn is not None else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.letters, self.digest.hexdigest())


def repair(rows: DataFrame, as_rows: bool = False) -> DataFrame:
    """Repair conversations. rows: conv_id, turn, role, text, live (false: the row isn't there, only its conversation is).

    One row a conversation: its gaps and faults, cost, edits and the hash of the repaired conversation; with `as_rows` the repaired rows,
    numbered by place, with the edit that gave each (K, R or I).
    """
    prepare(rows.sparkSession)
    stripped = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    own = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text", "live", (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("short"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    # dealt by conversation once: that serves both windows and the pass through the rows
    marked = own.repartition("conv_id").withColumn("seen", seen)
    placed = marked.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(~F.col("live"), *order, "seen")))
    # each row twice, and both in order: first what decides, then the text
    twice = placed.withColumn("phase", F.explode(F.when(F.col("live"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("phase") == 1, F.col("text"))
    light = twice.select("conv_id", "phase", "pos", "turn", "role", text.alias("text"), "live", "blank", "short", "seen").sortWithinPartitions("conv_id", "phase", "pos").select(*_LIGHT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in (ROWS if as_rows else SUMMARY).split(", ")))
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "bigint" else pa.string()) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)
        now, out = None, []

        def close() -> Iterator[tuple]:
            now.decide()
            made = list(now.insertions())
            yield from made if as_rows else [now.summary()]

        for batch in batches:
            for conv_id, phase, turn, role, text, live, blank, short, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out += close()
                    now = _Conversation(conv_id)
                if not live:
                    continue
                if not phase:
                    now.look(turn, role[:1], blank, short, seen)
                    continue
                now.decide()
                found = now.take(role, text, symbol(role[:1], blank or seen, short))
                if as_rows:
                    out += found
                else:
                    for _ in found:
                        pass
                if len(out) >= OUT_ROWS:
                    yield give(out)
                    out = []
            if out:
                yield give(out)
                out = []
        if now is not None:
            yield give(list(close()))

    return light.mapInArrow(run, ROWS if as_rows else SUMMARY)
