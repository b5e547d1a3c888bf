"""Conversation repair against a plain recursive search."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from storecast.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
EDGES = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def damaged(rows):
    out, ids = [], {}
    for conv, turn, role, text in rows:
        ids.setdefault(conv, None)
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out, list(ids)


def brute(rows):
    """Result of one conversation's rows, by trying all edits of every row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, inserts):
        """(cost, audit, turns) from row i on, when the repaired turns so far end in ``last``."""
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for c, name in (("u", "user"), ("a", "assistant")):
                if (last, c) in EDGES:
                    cost, audit, turns = best(i, c, inserts + 1)
                    options.append((3 + cost, "I" + audit, (f"{name}:",) + turns))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, turns = best(i + 1, last, 0)
            options.append((4 + cost, "D" + audit, turns))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for letter, c, name, price in (("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)):
                    if (last, c) in EDGES:
                        cost, audit, turns = best(i + 1, c, 0)
                        options.append((price + extra + cost, letter + audit, (f"{name}:{text}",) + turns))
        return min(options) if options else (10**9, "", ())

    cost, audit, turns = best(0, "", 0)
    known = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def expected(rows):
    after, ids = damaged(rows)
    return {conv: brute([r for r in after if r[0] == conv]) for conv in ids}


def found(spark, rows, **limits):
    df = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    return {r[0]: tuple(r)[1:] for r in repair.repair_conversations(df, present=df["present"], **limits).collect()}


def made_up(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "what?", "cut off", " \t", "", "a. ", "Why so", None]
    roles = ["system", "user", "assistant", "user", "assistant", "user", "tool", None, ""]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(9)):
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 3]) - 2, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{turn}."))
    return rows


@pytest.mark.parametrize("limits", [{}, {"held_rows": 2}, {"held_chars": 6}])
def test_equals_brute_force(spark, limits):
    rows = made_up(5, 150)
    assert found(spark, rows, **limits) == expected(rows)


def test_steps_do_not_depend_on_blocks(spark):
    rows = [(7, t, "user", f"line {t}" + "." * (t % 3)) for t in range(300)] + [(8, t, "user" if t % 2 else "system", f"x{t}!") for t in range(200)]
    whole = found(spark, rows)
    assert found(spark, rows, held_rows=16) == whole
    assert whole.keys() == {7, 8}


def test_known_edits(spark):
    rows = [(1, 0, "assistant", "Hi."), (2, 0, "system", "S."), (3, 0, "user", "Q?"), (3, 1, "assistant", "A."), (4, 0, "user", " ")]
    got = {r.conv_id: (r.cost, r.audit) for r in repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (3, "IK"), 2: (4, "D"), 3: (0, "KK"), 4: (4, "D")}


@pytest.mark.parametrize("limits", [{}, {"held_rows": 2}])
def test_repaired_turns_have_legal_roles(spark, limits):
    rows = [r for r in made_up(11, 60)]
    turns = repair.repaired_turns(spark.createDataFrame(rows, SCHEMA), **limits).collect()
    by_conv = {}
    for r in sorted(turns, key=lambda r: r.position):
        by_conv.setdefault(r.conv_id, []).append(r.role[0])
    assert by_conv and all(re.fullmatch("s?(ua)+", "".join(v)) for v in by_conv.values())


def test_empty_and_clashing_columns(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "Q?", "k", True)], SCHEMA + ", key string, present boolean")
    assert [r.audit for r in repair.repair_conversations(rows).collect()] == ["KI"]
    dropped = spark.createDataFrame([(1, None, None, None, False)], SCHEMA + ", p boolean")
    r = repair.repair_conversations(dropped, present=dropped["p"]).collect()[0]
    assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 1_000_000)]
    assert found(spark, rows, held_chars=1000) == found(spark, rows) == expected(rows)
