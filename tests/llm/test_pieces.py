import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from storecast.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world\nfoo \t x", "", " ", "   lead and trail  ", "größe façade niño", "12345 + 67", "emoji 😀 中文 ქარ", "a\r\nb", "x" * 400, "thereading ofthehouse tionandre",
         "\n\n", "\u0000 ​", "The quick brown fox jumps over the lazy dog."]


@pytest.fixture(scope="module")
def model():
    return pieces.piece_model(PATH)


def ids(model, text):
    return np.frombuffer(model.encode(text), "<i4").tolist()


def plain_best(model, text):
    """Highest total score over all segmentations of the whole text, by plain dynamic programming over all substrings."""
    s = pieces.SPACE + text.replace(" ", pieces.SPACE)
    table = {p: v[1] for p, v in model.automaton.items()}
    longest = max(map(len, table))
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - longest), e):
            if s[b:e] in table:
                best[e] = max(best[e], best[b] + table[s[b:e]])
        if s[e - 1] not in table:
            best[e] = max(best[e], best[e - 1] + model.unknown_score)
    return best[-1]


def score(model, text):
    table = {v[2]: v[1] for v in model.automaton.values()}
    s = pieces.SPACE + text.replace(" ", pieces.SPACE)
    missing = sum(c not in model.single for c in s)
    return sum(table.get(i, 0.0) for i in ids(model, text)) + missing * model.unknown_score


def test_best_path_and_round_trip(model):
    rng = random.Random(3)
    parts = ["the", "tion", "er", " ", "  ", "\n", "é", "Zürich", "12", ".", ",", "ha", "在", "q", "\t"]
    for text in TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(300)]:
        assert model.decode(ids(model, text)) == text
        if text and len(text) < 200:
            assert score(model, text) == pytest.approx(plain_best(model, text), rel=1e-12)


def test_decoding_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in TEXTS:
        assert model.decode(library.encode(text)) == text == library.decode(library.encode(text))


def test_frames(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a", 1), (3, None, 1), (3, None, 1), (99, "word " * 20_000, 1), (100, "a▁b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    encoded = pieces.encode_documents(df, PATH)
    got = encoded.collect()
    assert len(got) == len(rows) and all(len(r.ids) == r.n_tokens and r.round_trip == (r.doc_id != 100) for r in got)
    decoded = {(r.doc_id, r.text) for r in pieces.decode_documents(encoded, PATH).collect()}
    assert decoded == {(i, (t or "").replace("▁", " ")) for i, t, _ in rows}
    assert pieces.encode_documents(df.limit(0), PATH).collect() == []
