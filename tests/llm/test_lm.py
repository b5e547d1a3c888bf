import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from storecast.llm import lm
from storecast.llm.tokens import lower, text_bytes

WORD = rb"[^\x20\x09-\x0d]+"


def plain_stream(text):
    return b"".join(w.lower() + b" " for w in re.findall(WORD, (text or "").encode())) + b"\n"


def plain_model(train):
    """Node counts of every depth by dictionaries."""
    nodes = {}
    for t in train:
        s = b"\n" * lm.DEPTH + plain_stream(t)
        for p in range(lm.DEPTH, len(s)):
            for i in range(8):
                prefix, bit = 1 << i | s[p] >> (8 - i), s[p] >> (7 - i) & 1
                for d in range(lm.DEPTH + 1):
                    nodes.setdefault((s[p - d:p], prefix), [0, 0])[bit] += 1
    return nodes


def kt(n):
    return math.lgamma(n[0] + .5) + math.lgamma(n[1] + .5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)


def plain_score(text, nodes, children, memo):
    def weight(ctx, prefix):
        if (ctx, prefix) not in memo:
            own = kt(nodes[ctx, prefix])
            if len(ctx) == lm.DEPTH:
                memo[ctx, prefix] = own
            else:
                memo[ctx, prefix] = math.log(.5) + np.logaddexp(own, sum(weight(c, prefix) for c in children[ctx, prefix]))
        return memo[ctx, prefix]
    s, out = b"\n" * lm.DEPTH + plain_stream(text), 0.0
    for p in range(lm.DEPTH, len(s)):
        for i in range(8):
            prefix, bit = 1 << i | s[p] >> (8 - i), s[p] >> (7 - i) & 1

            def predict(d):
                ctx = s[p - d:p]
                n = nodes.get((ctx, prefix), [0, 0])
                own = (n[bit] + .5) / (sum(n) + 1)
                if d == lm.DEPTH or (s[p - d - 1:p], prefix) not in nodes:
                    return own
                stop = math.exp(math.log(.5) + kt(n) - weight(ctx, prefix))
                return stop * own + (1 - stop) * predict(d + 1)
            out += math.log10(predict(0))
    return out


def rows():
    rng = random.Random(7)
    words = ["the", "The", "of", "größe", "a,", "b.", "12", "xyzzy", "tion"]
    out = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(80)]
    return out + [(None, "the of"), (81, None), (82, ""), (83, "  \n"), (5, out[5][1]), (5, out[5][1]), (84, "q" * 300), (85, "the " * 400)]


def test_stream_keys_equal_plain():
    texts = [t for _, t in rows()]
    data, offsets = text_bytes(pa.array(texts))
    keys, owner, _ = lm.stream(lower(data), offsets)
    want = []
    for r, t in enumerate(texts):
        s = b"\n" * lm.DEPTH + plain_stream(t)
        want += [(int.from_bytes(s[p - lm.DEPTH:p][::-1] + s[p:p + 1], "big"), r) for p in range(lm.DEPTH, len(s))]
    assert list(zip(keys.tolist(), owner.tolist())) == want


def test_scores_equal_plain_context_tree_weighting(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lm, "SLICE_BYTES", 300)
    data = rows()
    docs = spark.createDataFrame([(*r, 1.0) for r in data], "doc_id long, text string, score double").repartition(3)
    got = lm.score_documents(docs).collect()
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in data]
    train = [t for (_, t), h in zip(data, held) if not h]
    nodes = plain_model(train)
    children = {}
    for ctx, prefix in nodes:
        if ctx:
            children.setdefault((ctx[1:], prefix), []).append(ctx)
    counts = Counter(w.lower() for t in train for w in re.findall(WORD, (t or "").encode()))
    counts[None] = len(train)
    total, types, memo = sum(counts.values()), len(counts), {}
    want = []
    for (i, t), h in zip(data, held):
        tokens = [w.lower() for w in re.findall(WORD, (t or "").encode())] + [None]
        base = sum(math.log10((counts[w] + .1) / (total + .1 * (types + 1))) for w in tokens)
        want.append((str(i), h, len(tokens), sum(counts[w] > 0 for w in tokens), total, base, plain_score(t, nodes, children, memo)))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(got, sorted(want)):
        assert a[:5] == b[:5]
        assert abs(a[5] - b[5]) < 1e-8 and abs(a[6] - b[6]) < 1e-4 * max(1, abs(b[6])), (a, b)


def test_merging_in_rounds_and_many_places_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60)
    monkeypatch.setattr(lm, "SLICE_BYTES", 30)
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores():
        return sorted((str(r[0]), *r[1:4], round(r[4], 6), round(r[5], 4)) for r in lm.score_documents(docs).select(columns).collect())

    whole = scores()
    monkeypatch.setattr(lm, "GROUP_KEYS", 16)
    monkeypatch.setattr(lm, "FAN", 2)
    assert scores() == whole


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(empty).collect() == []
    wordless = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in lm.score_documents(wordless).collect()} == {(1, 1, 2)}
    held = spark.createDataFrame([(None, "ab")], "doc_id long, text string")
    r = lm.score_documents(held).head()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 2, 0, 0)
    assert abs(r.score - 4 * 8 * math.log10(.5)) < 1e-4
