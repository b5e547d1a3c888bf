import random
from collections import defaultdict

from storecast.llm import chat, queries
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


def plain(rows):
    convs = defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(rows):
        convs[("c", conv) if conv is not None else ("n", k)].append((turn, role, text))
    order = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    whole = defaultdict(list)
    for key, turns in convs.items():
        whole[tuple(t[1:] for t in sorted(turns, key=order))].append(key)
    out = []
    for turns, keys in whole.items():
        if not any(len(o) > len(turns) and o[:len(turns)] == turns for o in whole):
            ids = [k[1] for k in keys if k[0] == "c"]
            text = "".join(f"<|im_start|>{'user' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in turns)
            out.append((str(min(ids) if ids else None), len(turns), len(keys), text))
    return sorted(out)


def test_equals_plain_collapse(spark):
    rng = random.Random(6)
    rows, k = [], 0
    for _ in range(60):
        turns = [(i, "user" if i % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no"])) for i in range(rng.randint(1, 6))]
        for n in rng.choice([[len(turns)], range(1, len(turns) + 1), [1, len(turns)], [len(turns)] * 3]):
            rows += [(k, *t) for t in turns[:n]]
            k += 1
    rows += [(900, 0, None, None), (901, 0, None, ""), (902, None, "user", "x" * 50_000), (902, None, "user", "x" * 50_000), (903, 1, "b", "t"), (903, 1, "a", "t"), (903, None, "c", "t"),
             (None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 3, "system", None), (904, 0, "user", ""), (905, 0, "", "user")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = sorted((str(r.conv_id), r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(df).collect())
    assert got == plain(rows)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_equals_sql(spark):
    ok, message = compare(spark, duck(SF), "op6", queries.QUERIES["op6_snapshot_collapse"], queries.ORACLE["op6_snapshot_collapse"], SF)
    assert ok, message
