"""Token alignment against a plain walk over byte offsets, with the libraries' own encoders."""

import hashlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from storecast.llm import alignment as al  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def groups(text, libraries):
    """[(ids of A, ids of B)] by walking both sides' token ends."""
    t, sp = libraries
    if not text:
        return []
    table_a, table_b = al.BytePairs(A).bytes if not hasattr(groups, "a") else groups.a, al.Pieces(B).bytes if not hasattr(groups, "b") else groups.b
    groups.a, groups.b = table_a, table_b
    ids = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    ends = []
    for own, table in zip(ids, (table_a, table_b)):
        if b"".join(table[i] for i in own) != (" " + text).encode():
            return []
        at, e = 0, []
        for i in own:
            at += len(table[i])
            e.append(at)
        ends.append(e)
    out, own = [], ([], [])
    common = set(ends[0]) & set(ends[1])
    cuts = sorted(common)
    for cut in cuts:
        pair = tuple([i for i, e in zip(ids[s], ends[s]) if e <= cut and e > own[0]] if own[0] else [i for i, e in zip(ids[s], ends[s]) if e <= cut] for s in (0, 1))
        out.append(pair)
        own = (cut, None)
    return out


def plain(docs, libraries):
    found = [(d, groups(t, libraries)) for d, t in docs]
    held = Counter()
    for _, g in found:
        held.update({(a, b) for x, y in g for a in x for b in y})
    highest = {}
    for (a, _), n in held.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for d, g in found:
        links = [(a, b) for x, y in g for a in x for b in y]
        body = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(held[p] == highest[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(body.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def found(spark, docs, **sizes):
    return sorted((tuple(r) for r in al.align_documents(spark.createDataFrame(docs, SCHEMA), A, B, **sizes).collect()), key=str)


TEXTS = ["Hello world", "It's 12345 tokens, isn't it?", "  leading  and   trailing  ", "tab\tand\nnewline\r\n\r\n", "ünïcödé çava", "日本語のテキスト", "emoji 🎉🎉 zwj 👩‍👩‍👧", "a▁b", "<s> </s> <unk> <0x41>",
         "<|endoftext|> inside", "x" * 500, "supercalifragilisticexpialidocious" * 7, "\x00 nul \x07", "nbsp and em line", "mixed 東京 tower №5 ½", " ", "\n", "ﬁ ligature é", "0123456789" * 30,
         None, "", "Hello world", "AbCdEfGhIjKlMnOp" * 20, "\u0085next", "x\n \ny", "x \ny", "x\n\n y", "a\u00a0 \u00a0b", "a\u2003 b \u3000c", "one  two", "q\x1c \x1dr", "don't we'll I'VE"]


def test_equals_a_plain_walk(spark, libraries):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "Hello world"), (3, "the the the the")]
    got = found(spark, docs)
    assert got == plain(docs, libraries)
    assert [r[1:] for r in got if r[0] == TEXTS.index("a▁b")] == [(0, 0, 0, 0, 0, 0, "")]


def test_documents(spark, libraries):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    docs = [(r.doc_id, r.text) for r in rows]
    assert found(spark, docs) == plain(docs, libraries)


def test_parts_slices_and_blocks_do_not_matter(spark, libraries):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"word number {i} and some more words that go on {'▁' * (i == 3)} {i} " * (i % 5)) for i in range(20)]
    assert found(spark, docs, part_chars=40, slice_chars=90, block_chars=300) == plain(docs, libraries)


def test_wide_groups(monkeypatch):
    aligned = al.align(["x" * 500, "日本語", "one two", "ab" * 90], al.tokenizers(A, B))
    tallies = []
    for wide in (1, 1 << 40):
        monkeypatch.setattr(al, "WIDE", wide)
        tally = Counter()
        for text, x, y, n in zip(*(v.tolist() for v in al.linked_ids(aligned))):
            tally[text, x, y] += n
        tallies.append(tally)
    assert tallies[0] == tallies[1] and tallies[0]


def test_fast_encoder_is_the_tokenizer(libraries):
    a = al.BytePairs(A)
    assert a.ranks is not None
    plain_chars = [c for c in map(chr, [*range(0x250), *range(0x2010, 0x2028)]) if not al._BEYOND(c)]
    texts = [f"{before}{c}{after}" for c in plain_chars for before, after in (("", ""), ("x", "y"), (" ", "1"), ("  ", "  "), (".", "'s"), (f"{c} ", f" {c}"))]
    assert [list(x) for x in a.encode(texts)] == [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_overlaps(spark):
    rows = al.aligned_tokens(spark.createDataFrame([(1, "unbelievable tokenization"), (2, None), (3, "Hello")], SCHEMA), A, B).collect()
    a, b = al.BytePairs(A).bytes, al.Pieces(B).bytes
    for r in rows:
        ends = [[sum(len(t[j]) for j in ids[:i + 1]) for i in range(len(ids))] for ids, t in ((r.ids_a, a), (r.ids_b, b))]
        spans = [list(zip([0, *e], e)) for e in ends]
        wanted = {(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]}
        assert set(zip(r.overlap_a, r.overlap_b)) == wanted and len(r.overlap_a) == len(wanted)
        assert all(r.group_a[i] == r.group_b[j] for i, j in wanted)
    assert rows[1].ids_a == [] and len(rows) == 3


def test_long_text_and_empty_table(spark, libraries):
    docs = [(1, "many words in a row " * 60_000), (2, "y" * 20_000), (3, " " * 30_000)]
    got = {r[0]: r for r in found(spark, docs)}
    t, sp = libraries
    assert [got[i][1:3] for i in (1, 2, 3)] == [(len(t.encode(" " + x, add_special_tokens=False).ids), len(sp.encode(x))) for _, x in docs]
    assert found(spark, []) == []


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "one two", 5, 6, "x")], SCHEMA + ", block long, kind int, id string")
    assert al.align_documents(docs, A, B).count() == 1
