import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from storecast.llm import common, minhash
from storecast.llm.components import components


def words(rng, n):
    return ["w" + "".join(rng.choices("abcdefghijkl", k=5)) for _ in range(n)]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        text[rng.randrange(len(text))] = "e" + str(rng.random())
    return text


def corpus():
    rng = random.Random(4)
    texts, passage = [], words(rng, 40)
    for g in range(25):
        base = words(rng, 200)
        texts += [base] + [edited(rng, base, rng.choice([1, 2, 3, 6, 15])) for _ in range(rng.randint(0, 6))]
    chain = words(rng, 300)
    for _ in range(12):  # each step is similar to the last, the ends are not
        texts.append(chain)
        chain = edited(rng, chain, 5)
    texts += [words(rng, 100) + passage for _ in range(30)]
    texts += [words(rng, n) for n in (1, 2, 3, 4, 5, 6)]
    return [" ".join(t) for t in texts]


def plain_sets(texts, idf):
    """Weighted shingle sets by plain Python over the operator's word hashes."""
    out = []
    for t in texts:
        h, rows = minhash._word_hashes(*_bytes(t))
        w = idf(h)
        sets = defaultdict(float)
        n = len(h)
        for i in range(max(n - 4, 1) if n else 0):
            sets[tuple(h[i:i + 5].tolist())] += round(float(w[i:i + 5].mean()), 6)
        out.append(sets)
    return out


def _bytes(t):
    from storecast.llm.tokens import text_bytes
    return text_bytes(pa.array([t]))


def plain_jaccard(a, b):
    keys = a.keys() | b.keys()
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 0.0


def test_weighted_sets_equal_plain_python():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "C", "dd"], k=rng.randint(0, 30))) for _ in range(40)] + ["", None, " x\ty ", "Q"]
    idf = minhash.Idf(np.zeros(0, np.uint64), np.zeros(0, np.int64), 50, 1)
    got = {}
    for first, n, owner, keys, weights in minhash.weighted_shingles(pa.array(texts), idf, most=50):
        for r in range(n):
            got[first + r] = keys[owner == r], weights[owner == r]
    sets = plain_sets(texts, idf)
    for i, t in enumerate(texts):
        assert len(got[i][0]) == len(sets[i]) and np.isclose(got[i][1].sum(), sum(sets[i].values()))
    for i in range(len(texts)):
        for j in range(i):
            assert minhash.jaccard(got[i], got[j]) == pytest.approx(plain_jaccard(sets[i], sets[j]))


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(3)
    for s in (0.9, 0.6, 0.3):
        same = int(800 * s / (1 + s))
        agree, true = [], []
        for _ in range(12):
            keys = np.sort(rng.integers(0, 1 << 48, 800 - same, dtype=np.uint64))
            a, b = keys[:400], np.sort(np.r_[keys[400 - same:400], keys[400:]])
            w = dict(zip(keys.tolist(), rng.uniform(0.7, 7, len(keys))))
            wa, wb = np.array([w[x] for x in a.tolist()]), np.array([w[x] * rng.choice([1, 2]) for x in b.tolist()])
            drawn = minhash.samples(np.r_[a, b], np.r_[wa, wb], np.array([0, len(a)]))
            agree.append((drawn[0] == drawn[1]).mean())
            true.append(minhash.jaccard((a, wa), (b, wb)))
        assert abs(np.mean(agree) - np.mean(true)) < 0.05


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(i, i + 1) for i in range(500, 700)] + [(900, x) for x in range(901, 990)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_equal_brute_force(spark, monkeypatch):
    texts = corpus()
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, rng.choice(texts)) for i in range(60)] + [(3, texts[3])] * 5
    rows += [(None, texts[0]), (2000, None), (2001, ""), (2001, ""), (2002, " \n"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, class_id int, uid string").repartition(4)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)

    idf = minhash.document_frequencies(docs)
    distinct = sorted({t for _, t in rows if t and t.strip()})
    sets = plain_sets(distinct, idf)
    group = {t: {t} for t in distinct}
    for i in range(len(distinct)):
        for j in range(i):
            if group[distinct[i]] is not group[distinct[j]] and plain_jaccard(sets[i], sets[j]) >= 0.8:
                merged = group[distinct[i]] | group[distinct[j]]
                group.update({t: merged for t in merged})
    least = {}
    for i, t in rows:
        if t and t.strip():
            key = min(group[t])
            least[key] = min(least.get(key, 1 << 60), 1 << 60 if i is None else i)
    want = sorted((i is None, i or 0, least[min(group[t])] if t and t.strip() else i if i is not None else -1) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, -1 if r.class_id is None else r.class_id) for r in got) == want
    by_class = defaultdict(list)
    for r in got:
        if r.class_size > 1:
            by_class[r.class_id].append(r.kept)
    assert all(sum(kept) == 1 for kept in by_class.values())

    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert len(out) == len(least) + 5
    assert {r.doc_id for r in out if r.text and r.text.strip()} == set(least.values())
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_a_hot_bucket_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_CHUNK", 7)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(common, "LEAST_SPLIT", 2)
    rng = random.Random(2)
    base = words(rng, 300)
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 3, 6, 8])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = minhash.document_frequencies(docs)
    sets = plain_sets([t for _, t in rows], idf)
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if plain_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(label))


@pytest.mark.parametrize("least", [1, 5, 64])
def test_join_counted_equals_the_plain_join(spark, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_SPLIT", least)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(0, 7)] * 4, "k long, v long")
    counted = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 6")
    for total in (None, 304):
        got = sorted(map(tuple, common.join_counted(rows, counted, ["k"], "v", total).select("k", "v", "n").collect()))
        assert got == sorted(map(tuple, rows.join(counted, "k").select("k", "v", "n").collect()))
    nothing = rows.limit(0)
    assert common.join_counted(nothing, counted.limit(0), ["k"], "v").collect() == []
