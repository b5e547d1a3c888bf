"""Repair the turn structure of conversations: cheapest edits found over a secondary-sorted stream.

Rows are dealt by conversation and sorted by turn; a map over the sorted batches walks them and carries
the state of a dynamic program from batch to batch. The program follows the automaton of
``(s?(ua)+)?`` over role initials (nothing yet, after system, after user, after assistant): for each
state the least cost of the edits so far, and the order of the edit strings that reach it, which
settles ties. Costs count relative to the least, so that only a few states of the whole program occur
and its steps are looked up.

A conversation is held until it ends and is then traced back. One of more rows or bytes than the
limits is giant: its texts aren't held, and its back-pointers (24 bits a row) are spilled as rows of the
written table, block by block. A second pass reads the blocks from the last to the first and
writes the edits, a third streams the texts of giant conversations beside their edits.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import map_pandas, materialize, shuffle_partitions

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or rerolled turn leads, and what it is.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: From the cheapest state any future of another state can be followed for so much more at most.
REACH = 2 * INSERT + 1
#: A conversation of more rows, or more characters of text, is giant; its back-pointers are spilled in blocks of so many rows.
HELD_ROWS, HELD_CHARS = 1 << 16, 4 << 20
LETTERS = "DKR"
WHITE_CHARS = " \t\n\x0b\x0c\r"
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

START = ((0, 0), None, None, None)


def _keep(state: int, initial: str) -> int | None:
    """The state after a kept turn, or None where it may not stand."""
    if initial == "s" and state == EMPTY:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


@lru_cache(maxsize=1 << 16)
def step(states: tuple, initial: str, gone: bool, truncated: bool) -> tuple[tuple, int, int]:
    """(states after a row, what the least cost grew by, back-pointers).

    A state is (cost above the least, place of its edits among the states' edits) or None. Edits of two
    states never are one another's beginning, as each ends with its row's own letter; so their order
    decides between any of their continuations. A back-pointer is 6 bits by state: whence (2), letter and inserts (4).
    """
    best: list = [None] * 4
    for came, cell in enumerate(states):
        if cell is None:
            continue
        state = came
        for inserts in range(3):
            cost = cell[0] + inserts * INSERT
            options = [(state, cost + DELETE, 0)]
            if not gone:
                cost += TRUNCATED * truncated
                kept = _keep(state, initial)
                if kept is not None:
                    options.append((kept, cost, 1))
                options.append((NEXT[state], cost + REROLE, 2))
            for to, total, letter in options:
                found = (total, cell[1], "I" * inserts + LETTERS[letter], came << 4 | letter << 2 | inserts)
                if best[to] is None or found < best[to]:
                    best[to] = found
            state = NEXT[state]
    least = min(b[0] for b in best if b)
    order = sorted(b[1:] for b in best if b)
    after = tuple((b[0] - least, order.index(b[1:])) if b and b[0] <= least + REACH else None for b in best)
    return after, least, sum(b[3] << 6 * q for q, b in enumerate(best) if b)


def finish(states: tuple) -> tuple[int, int, int]:
    """(cost above the least, state, closing inserts) of the best end."""
    closing = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    ends = [(cell[0] + INSERT * closing[q], cell[1], q) for q, cell in enumerate(states) if cell]
    cost, _, state = min(ends)
    return cost, state, closing[state]


def trace(pointers: array, state: int) -> tuple[str, int]:
    """The edits of these rows that end in ``state``, and the state before them."""
    out = []
    for p in reversed(pointers):
        p = p >> 6 * state & 63
        out.append("I" * (p & 3) + LETTERS[p >> 2 & 3])
        state = p >> 4
    return "".join(reversed(out)), state


class Edits:
    """Walks rows with their edits: what is left, with the roles that the order asks for."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def _new(self) -> str:
        role = ROLES[self.state]
        self.state = NEXT[self.state]
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._new(), "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _keep(self.state, role[:1])
            yield role, text, letter
        elif letter == "R":
            yield self._new(), text, letter


class _Digest:
    """One output row for each conversation: sha256 of its repaired turns."""

    fields = ("repaired_sha256 string",)

    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str, edit: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def rows(self) -> list[tuple]:
        return [(self.hash.hexdigest(),)]

    taken = 0


class _Turns:
    """One output row for each repaired turn."""

    fields = ("position long", "role string", "text string", "edit string")

    def __init__(self):
        self.n, self.found = 0, []

    def add(self, role: str, text: str, edit: str) -> None:
        self.found.append((self.n, role, text, edit))
        self.n += 1

    @property
    def taken(self) -> int:
        return len(self.found)

    def rows(self) -> list[tuple]:
        out, self.found = self.found, []
        return out


_OUTPUTS = {"digest": _Digest, "turns": _Turns}
_INPUT = ("key", "present", "has_turn", "turn", "role", "text", "gone", "fault")


class _Walk:
    """One conversation on its way through the stream."""

    def __init__(self, key: str):
        self.key, self.states, self.cost = key, START, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.turns, self.low, self.last = 0, None, None
        self.pointers, self.held, self.chars, self.blocks, self.giant = array("I"), [], 0, 0, False

    def add(self, has_turn: bool, turn: int, role: str, text: str, gone: bool, fault: str) -> None:
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if has_turn and (self.last is None or turn != self.last):
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.last = turn
        self.states, grown, pointers = step(self.states, initial if initial in ("s", "u", "a") else "", gone, fault == "truncated")
        self.cost += grown
        self.pointers.append(pointers)
        if not self.giant:
            self.held.append((role, text))
            self.chars += len(text)

    def stats(self, more: int) -> tuple:
        gaps = self.last - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts.values(), self.illegal, self.cost + more)


def _packed(pointers: array) -> bytes:
    return zlib.compress(pointers.tobytes(), 1)


def _unpacked(body: bytes) -> array:
    out = array("I")
    out.frombytes(zlib.decompress(body))
    return out


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame.from_records(rows, columns=columns).astype(object)


def _fields(kind: str) -> list[str]:
    return ["key string", "block long", "pointers binary", "state int", "closing int", "audit string",
            *[f"{c} long" for c in _STATS], *_OUTPUTS[kind].fields]


def _names(fields: list[str]) -> list[str]:
    return [f.split(" ")[0] for f in fields]


def _walk_stream(kind: str, held_rows: int, held_chars: int):
    """Pass 1: whole conversations with their result; of giant ones the blocks of back-pointers."""
    output, columns = _OUTPUTS[kind], _names(_fields(kind))
    nothing = (None,) * len(output.fields)

    def ended(w: _Walk) -> list[tuple]:
        more, state, closing = finish(w.states)
        if w.giant:
            return [(w.key, w.blocks, _packed(w.pointers), state, closing, None, *w.stats(more), *nothing)]
        audit, _ = trace(w.pointers, state)
        edits, out = Edits(audit + "I" * closing), output()
        for role, text in w.held:
            for made in edits.row(role, text):
                out.add(*made)
        for made in edits.inserted():
            out.add(*made)
        return [(w.key, 0, None, None, None, edits.audit, *w.stats(more), *row) for row in out.rows()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, found, size = None, [], 0
        for batch in batches:
            for key, present, *row in zip(*[batch[c].tolist() for c in _INPUT]):
                if walk is None or key != walk.key:
                    if walk is not None:
                        found += ended(walk)
                        size += walk.chars
                    walk = _Walk(key)
                if present:
                    walk.add(*row)
                    if len(walk.pointers) >= held_rows or walk.chars > held_chars:
                        walk.giant, walk.held, walk.chars = True, [], 0
                    if walk.giant and len(walk.pointers) >= held_rows:
                        found.append((walk.key, walk.blocks, _packed(walk.pointers), *[None] * 9, *nothing))
                        walk.blocks, walk.pointers = walk.blocks + 1, array("I")
                if len(found) >= 1000 or size > held_chars:
                    yield _frame(found, columns)
                    found, size = [], 0
        if walk is not None:
            found += ended(walk)
        if found:
            yield _frame(found, columns)

    return run


def _trace_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass 2: the blocks of each giant conversation from the last to the first; the state goes on from block to block."""
    state = 0
    for batch in batches:
        found = []
        for key, block, body, end, closing in zip(*[batch[c].tolist() for c in ("key", "block", "pointers", "end", "closing")]):
            state = end if end >= 0 else state
            audit, state = trace(_unpacked(body), state)
            found.append((key, block, audit + "I" * closing))
        yield _frame(found, ["key", "block", "audit"])


def _giant_stream(kind: str, held_chars: int):
    """Pass 3: first the edits of a giant conversation, block by block, then its texts by turn."""
    output = _OUTPUTS[kind]
    columns = _names(["key string", "audit string", *output.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pieces, edits, out, chars = None, [], None, None, 0

        def rows() -> list[tuple]:
            return [(key, edits.audit, *row) for row in out.rows()]

        def closed() -> Iterator[pd.DataFrame]:
            if out is not None:
                for made in edits.inserted():
                    out.add(*made)
                yield _frame(rows(), columns)

        for batch in batches:
            for own, is_edit, audit, role, text in zip(*[batch[c].tolist() for c in ("key", "is_edit", "audit", "role", "text")]):
                if own != key:
                    yield from closed()
                    key, pieces, edits, out = own, [], None, None
                if is_edit:
                    pieces.append(audit)
                    continue
                if out is None:
                    edits, out, pieces = Edits("".join(pieces)), output(), []
                for made in edits.row(role, text):
                    out.add(*made)
                    chars += len(made[1])
                if out.taken >= 1000 or out.taken and chars > held_chars:
                    yield _frame(rows(), columns)
                    chars = 0
        yield from closed()

    return run


def _faults(turns: DataFrame, present: Column | None, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows with their first fault, dealt by conversation (one exchange; the windows keep to it)."""
    blank = F.lit(" ")
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key"),
        (F.lit(True) if present is None else present).alias("present"),
        F.col(turn_col).isNotNull().alias("has_turn"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"))
    rows = rows.repartition(shuffle_partitions(turns.sparkSession), "key")
    same = Window.partitionBy("key", "present", "role", F.md5(F.col("text").cast("binary"))).orderBy("has_turn", "turn")
    tail = F.rtrim(F.col("text"), F.lit(WHITE_CHARS))
    fault = (F.when(tail == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
             .when(~F.substring(tail, -1, 1).isin(".", "!", "?"), "truncated"))
    rows = rows.withColumn("fault", F.coalesce(fault, F.lit("")))
    return rows.withColumn("gone", F.col("fault").isin("blank", "duplicate")).select(*_INPUT)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("key", "has_turn", "turn", "role", "text", "gone")


def _repaired(turns: DataFrame, kind: str, present: Column | None, conv_col: str, turn_col: str, role_col: str, text_col: str,
              held_rows: int, held_chars: int) -> DataFrame:
    n_parts = shuffle_partitions(turns.sparkSession)
    fields = _fields(kind)
    faulted = _faults(turns, present, conv_col, turn_col, role_col, text_col)
    walked = materialize(map_pandas(_in_order(faulted), _walk_stream(kind, held_rows, held_chars), ", ".join(fields)), "repair")
    out = ["key", *_STATS, "audit", *_names(list(_OUTPUTS[kind].fields))]
    blocks = walked.where("pointers is not null")
    found = walked.where("pointers is null").select(out)
    if not blocks.isEmpty():
        backwards = (blocks.select("key", "block", "pointers", F.coalesce("state", F.lit(-1)).alias("end"), F.coalesce("closing", F.lit(0)).alias("closing"))
                     .repartition(n_parts, "key").sortWithinPartitions("key", F.desc("block")))
        traced = materialize(map_pandas(backwards, _trace_stream, "key string, block long, audit string"), "repair-giant")
        texts = faulted.where("present").join(traced.select("key").distinct(), "key", "left_semi")
        nothing = {"block": F.lit(0), "audit": F.lit(""), "has_turn": F.lit(False), "turn": F.lit(0), "role": F.lit(""), "text": F.lit("")}
        both = (traced.select("key", F.lit(True).alias("is_edit"), "block", "audit", *[nothing[c].alias(c) for c in ("has_turn", "turn", "role", "text")])
                .union(texts.select("key", F.lit(False), *[nothing[c] for c in ("block", "audit")], "has_turn", "turn", "role", "text")))
        ordered = both.repartition(n_parts, "key").sortWithinPartitions("key", F.desc("is_edit"), "block", "has_turn", "turn", "role", "text")
        giant = map_pandas(ordered.select("key", "is_edit", "audit", "role", "text"), _giant_stream(kind, held_chars), ", ".join(["key string", "audit string", *_OUTPUTS[kind].fields]))
        found = found.unionByName(giant.join(blocks.where("state is not null").select("key", *_STATS), "key").select(out))
    conv = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(turns.schema[conv_col].dataType).alias(conv_col)
    return found.select(conv, *out[1:])


def repair_conversations(turns: DataFrame, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS) -> DataFrame:
    """One row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, then by role and text. A row's first fault counts: blank (no
    character but white space), duplicate (its role and text stood earlier in the conversation), truncated
    (its last such character is none of ``.!?``). ``gaps`` are the turn numbers missing between the least and
    the greatest, ``illegal`` the neighbours whose role initials aren't su, ua or au. The edits are Keep,
    Rerole (to user or assistant), Delete (blank and duplicate rows must go) and Insert (an empty user or
    assistant turn) of least total cost, undeleted truncated rows paid for, that leave role initials
    ``(s?(ua)+)?``; of equal ones the ASCII-least. ``audit`` holds their initials in order, the hash is
    of the repaired ``role:text`` lines.

    Null roles and texts and empty roles are one space; a null id is a conversation of its own; rows
    repeated are duplicates. Rows where ``present`` is false only name their conversation: one without
    other rows has zeros, no edits and the hash of nothing. An empty table gives no rows. Other columns
    are not read.
    """
    return _repaired(turns, "digest", present, conv_col, turn_col, role_col, text_col, held_rows, held_chars)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS) -> DataFrame:
    """The repaired conversations: id, position, role, text and edit (K, R or I) of every turn that is left.

    Cases as in ``repair_conversations``.
    """
    found = _repaired(turns, "turns", None, conv_col, turn_col, role_col, text_col, held_rows, held_chars)
    return found.where("position is not null").select(conv_col, "position", "role", "text", "edit")


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults put in by crc32 of ``conversation:turn`` modulo 20 (nulls are one space): 0 drops the row
    (``present`` false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col, role_col, text_col)]
    kind = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text[2].alias("role"), text[3].alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
