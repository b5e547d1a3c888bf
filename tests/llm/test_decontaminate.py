"""Benchmark passages against a plain scan of every text."""

import hashlib
import random
import re

import numpy as np
import pytest

from storecast.llm import decontaminate as d

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, near=None):
    out = []
    for doc_id, text in docs:
        own, hit, found, close = words(text), set(), set(), set()
        for item_id, item in items:
            w = words(item)
            windows = [w[i:i + 10] for i in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []
            for window in windows:
                n = len(window)
                for s in range(len(own) - n + 1):
                    if own[s:s + n] == window:
                        hit |= set(range(s, s + n))
                        found.add("" if item_id is None else str(item_id))
                if near and any(set(window) <= set(own[s:s + near]) for s in range(len(own))):
                    close.add(item_id)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit), *([len(close)] if near else [])))
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    return sorted((tuple(r) for r in d.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more).collect()), key=str)


def made_up(seed, n_docs=60, vocabulary=40):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)] + ["Ünï", "of", "THE", "x1", "日本"]
    items = [(i if i else None, " ".join(rng.choice(names) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(14)]
    items += [items[-1], (3, " ".join(rng.choice(names) for _ in range(12))), (99, None), (100, ".,;")]
    docs = []
    for i in range(n_docs):
        parts = []
        for _ in range(rng.randrange(6)):
            own = (items[rng.randrange(len(items))][1] or "").split()
            if rng.random() < 0.5:
                a = rng.randrange(len(own) + 1)
                own = own[a:a + rng.randrange(1, 14)]
            if rng.random() < 0.2:
                rng.shuffle(own)
            parts += own + [rng.choice(names) for _ in range(rng.randrange(5))]
        docs.append((i // 2 if i else None, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs + [(500, None), (501, ""), (502, "...")], items


@pytest.mark.parametrize("near", [None, 12])
def test_equals_a_plain_scan(spark, near):
    docs, items = made_up(3)
    got = found(spark, docs, items, near=near)
    assert got == plain(docs, items, near)
    assert sum(r[5] for r in got) > 20


def test_blocks_and_chunks_do_not_matter(spark, monkeypatch):
    docs, items = made_up(8, n_docs=40, vocabulary=8)
    build, pieces = d.build_index, d.item_pieces
    monkeypatch.setattr(d, "build_index", lambda *a: build(*a, block_bytes=100))
    monkeypatch.setattr(d, "item_pieces", lambda *a: pieces(*a, most=7))
    monkeypatch.setattr(d, "CHUNK_WORDS", 60)
    assert found(spark, docs, items, near=11) == plain(docs, items, 11)


def test_batches_do_not_matter(monkeypatch):
    rng = np.random.default_rng(5)
    code = rng.integers(0, 6, 400)
    lists = d.Lists(np.arange(6, dtype=np.uint64), np.bincount(code, minlength=6).astype(np.uint32), np.argsort(code, kind="stable").astype(np.uint32), np.array([0, 150, 280], np.uint32))
    windows = d.Windows(rng.integers(0, 7, (60, 3)).astype(np.uint64), np.arange(60))
    whole = [d.exact(lists, windows), d.close(lists, windows, 6)]
    monkeypatch.setattr(d, "BATCH", 16)
    assert [[x.tolist() for x in found] for found in (d.exact(lists, windows), d.close(lists, windows, 6))] == [[x.tolist() for x in found] for found in whole]
    assert len(whole[0][0]) and len(whole[1][0])


def test_lists_of_a_block():
    hashes = np.array([5, 7, 5, 9], np.uint64)
    lists = d.Lists(np.array([5, 7, 9], np.uint64), np.array([2, 1, 1], np.uint32), np.array([0, 2, 1, 4], np.uint32), np.array([0, 4], np.uint32))
    w, s = d.exact(lists, d.Windows(np.array([[5, 7], [7, 5], [5, 9], [7, 9]], np.uint64), np.zeros(4, np.int64)))
    assert sorted(zip(w.tolist(), s.tolist())) == [(0, 0), (1, 1)]  # 5 at 2 and 9 at 4 lie in two texts
    assert [x.tolist() for x in d.close(lists, d.Windows(hashes[None, :3], np.zeros(1, np.int64)), 3)] == [[0], [0], [2]]


def test_passages(spark):
    text = "It was said that one two three four five six seven eight nine ten eleven was a count"
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "a count"), (3, "count a")]
    index = d.build_index(spark.createDataFrame([(1, text)], DOCS))
    rows = d.find_passages(index, spark.createDataFrame(items, ITEMS), near=20).collect()
    assert sorted((r.item_id, r.start, r.n_words, r.exact) for r in rows) == [
        ("1", 4, 10, False), ("1", 4, 11, True), ("2", 16, 2, False), ("2", 16, 2, True), ("3", 16, 2, False)]


def test_long_texts_and_empty_tables(spark):
    filler = "Ab cd,ef " * 400_000
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs, items = [(1, filler + passage + " " + filler), (2, "z" * 3_000_000 + " " + passage)], [(7, passage)]
    got = found(spark, docs, items)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, 2_400_010, 10, 1), (2, 11, 10, 1)]
    assert found(spark, [], items) == []
    assert [r[1:4] for r in found(spark, [(1, "one two")], [])] == [(2, 0, 0)]


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 0, 0, "x")], DOCS + ", block long, at long, id string")
    items = spark.createDataFrame([(1, "a b", "q")], ITEMS + ", words string")
    assert [(r.doc_id, r.n_hit) for r in d.contamination(docs, items).collect()] == [(1, 2)]
