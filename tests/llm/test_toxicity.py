import random

import numpy as np
import pyarrow as pa

from storecast.llm import tokens, toxicity


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "house", "green", "walk", "over", "light"]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "blarg" + rng.choice(words)]))
        rows.append((i, " ".join(text), rng.choice(["en", "de", None]), toxic))
    return rows


def test_words_and_hashes_equal_plain_splitting():
    texts = ["Hello, World", "", "  a\n\tb  ", "été ÉTÉ", "x", None, "hello"]
    column = pa.array(texts)
    data, offsets = tokens.text_bytes(column)
    data = tokens.lower(data, latin=True)
    s, e, rows = tokens.word_bounds(data, offsets, tokens.PUNCTUATION)
    assert [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(s, e, rows)] == [
        (0, "hello"), (0, "world"), (2, "a"), (2, "b"), (3, "été"), (3, "été"), (4, "x"), (6, "hello")]
    h = tokens.Hasher(data)(s, e)
    assert h[0] == h[7] and h[4] == h[5] and len(set(h.tolist())) == 6


def test_held_out_accuracy_and_gradient_free_scores():
    rows = corpus()
    model = toxicity.fit([r[1] for r in rows[:400]], [r[3] for r in rows[:400]], [r[2] for r in rows[:400]])
    scores = model.scores(pa.array([r[1] for r in rows[400:]]))
    y = np.array([r[3] for r in rows[400:]])
    assert ((scores >= 0.5) == y).mean() >= 0.95
    # a text's score doesn't depend on its neighbours in the batch
    alone = [model.scores(pa.array([r[1]]))[0] for r in rows[400:410]]
    assert np.allclose(alone, scores[:10], atol=1e-6)


def test_frames(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:3] + ("z",) for r in rows] + [(0, rows[0][1], None, "z"), (None, None, None, None), (999, "", "xx", None), (998, "idiot " * 20_000, "en", None)],
                                 "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (5, None), (0, rows[0][3])], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model, lang_col="lang").collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id == 998} > {0.5} or max(r.score for r in got if r.doc_id == 998) > 0.5
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    kept = toxicity.toxicity_filter(docs, model)
    assert kept.columns == docs.columns and 150 < kept.count() < 304
    assert toxicity.score_documents(docs.limit(0), model).collect() == []
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 1e-9 for r in toxicity.score_documents(docs, nothing).collect())
