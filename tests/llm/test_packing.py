import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storecast.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_plan_uses_every_piece_once_and_fits(lengths):
    patterns = packing.minimum_bin_slack(Counter(lengths), 60)
    used = Counter()
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 60 and times > 0
        for k, n in pattern.items():
            used[k] += n * times
    assert used == Counter(lengths)


def test_first_window_is_the_fullest_with_the_largest_piece():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randint(3, 40) for _ in range(9)]
        rest = sorted(lengths)[:-1]
        best = max(s for m in range(1 << 8) if (s := sum(x for i, x in enumerate(rest) if m >> i & 1)) <= 40 - max(lengths))
        pattern, _ = packing.minimum_bin_slack(Counter(lengths), 40)[0]
        assert sum(k * n for k, n in pattern.items()) == max(lengths) + best


def test_words_encode_as_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", "  ", "Hello, World's end\n\tit's 123 É é x́", "a\x1cb c", "<|endoftext|> x<|startoftext|>y", " a b　", "ΣΑΣ İi ẞ", "x" * 3000, "ab\x00c d​e"]
    assert packing.encode_texts(texts, PATH) == [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_word_ids_equal_the_tokenizer_on_many_words():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(11)
    letters = "etaoinshrdlucméüßñçÉÄ'.,!?0123456789-_*<|>~²½ªµĀſƒ"
    vocabulary = [t.removesuffix("</w>") for t in tokenizer.get_vocab()]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(8000)]
    words += ["".join(rng.choices(vocabulary, k=rng.randint(1, 3))) for _ in range(8000)]
    words = [w for w in words if w.split() == [w]]
    assert packing.encode_texts(words, PATH) == [np.asarray(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


def test_every_token_is_what_its_merges_give():
    """Merging by rank then equals merging by the listed pairs, whatever stands around a token."""
    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    ids = sorted((i, t) for t, i in model["vocab"].items())
    merged = [a + b for a, b in rank]
    assert len(set(merged)) == len(merged)
    assert [t for _, t in ids[512:512 + len(merged)]] == merged
    for token in merged:
        core = token.removesuffix("</w>")
        parts = [*core[:-1], core[-1] + "</w>"] if core != token else list(core)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token], token


def test_packed_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "on", "12"], k=rng.randint(0, 30))), "x") for i in range(300)]
    rows += [(7, "the cat", "x")] * 40 + [(900, None, None), (901, "", None), (None, "cat", None), (902, "dog " * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(5)
    got = packing.pack_documents(docs, PATH, 64, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 64):
            want[doc_id, s, len(ids[s:s + 64]), zlib.crc32(np.array(ids[s:s + 64], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for spans in windows.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    assert sorted(windows) == list(range(len(windows)))
    assert sum(r.length for r in got) > 0.98 * 64 * (len(windows) - 1)
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
    whole = packing.sequences(packing.pack_documents(docs, PATH, 64, keep_ids=True)).collect()
    assert all(len(r.ids) == r.length <= 64 for r in whole)
