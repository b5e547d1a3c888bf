"""Alignment of two tokenizers: which tokens of one cover which tokens of the other.

Both tokenizers encode the same bytes, so their tokens lie on one line of byte offsets. For a batch of
texts, ``pandas.merge_asof`` by document gives each token start the other side's token that covers it;
both directions together are all overlaps. Overlapping tokens with equal ends close a group; inside a
group every token of one side is linked to every one of the other.

Texts are taken in blocks of about 16 MB. A block writes the ids linked in its documents: a table of id
pairs with the number of its documents that hold them, and for each document the places of its pairs in
that table. The pair counts are summed over all blocks and sent back to the blocks that hold the pair.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import map_arrow, materialize, shuffle_partitions

SPACE = "▁"
BLOCK_CHARS, SLICE_CHARS = 16 << 20, 1 << 20
#: Long texts are encoded in parts of at least so many characters.
PART_CHARS = 1 << 16
#: In a group of more links, equal ids are counted before they are paired.
WIDE = 256
#: Letters above this may be split otherwise by the two libraries' patterns; such texts go to the tokenizer itself.
_BEYOND = re.compile("[^\x00-\x84\x86-\x9f\xa1-ɏ‐-‧]").search
#: Kept ids of words: so many words at most, and so many characters, besides those of one slice.
KEPT, KEPT_CHARS = 400_000, 8 << 20
#: New words are encoded in lines of so many.
LINE_WORDS = 1000
#: A space amid other white space: a word need not begin there.
_AMID_WHITE = re.compile(r"\s \s").search
#: A place where a word ends for both tokenizers, whatever else stands in the text.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
# Fixed value: the pattern by which byte-level BPE cuts a text.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairs:
    """Byte-level BPE (a ``tokenizers`` file without normalizer): ids of space + text, and every token's bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken._tiktoken import CoreBPE
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        level = config["pre_tokenizer"] or {}
        if config["normalizer"] is not None or level.get("type") != "ByteLevel" or level.get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers without normalizer and prefix space are supported")
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"] for t in config["added_tokens"]}
        ids = {token: i for token, i in config["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(config["model"]["vocab"].values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        #: Merges in the order of their ids give the same tokens as ranks; then the faster library does them.
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in config["model"]["merges"]]
        made = [ids[a + b] for a, b in merges]
        ranked = made == sorted(made) and len(ids) == len(made) + 256 and level.get("use_regex", True)
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.ranks = CoreBPE({self.bytes[i]: i for i in ids.values()}, {}, _PATTERN) if ranked else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.ranks is None or _BEYOND(text):
                rest.append(i)
            else:
                out[i] = self.ranks.encode_ordinary(" " + text)
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False)):
            out[i] = found.ids
        return out


class Pieces:
    """A SentencePiece model that puts a space before a text: ids, and every piece's bytes."""

    def __init__(self, path: str):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.splits_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class WordTokens:
    """Both sides' ids of texts, word by word; words are kept while they are few.

    A single space is where a word begins on both sides: no piece goes on over a space, and byte-level BPE
    takes a space with what follows. Texts with other runs of white space around spaces are one word.
    """

    def __init__(self, a: BytePairs, b: Pieces):
        self.sides = (a, b)
        self.by_word = a.ranks is not None and b.splits_words
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        #: By word: whether both sides' bytes are the word's; by side the count of its ids, and all ids one after the other.
        self.good, self.counts, self.ids = np.zeros(0, bool), [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.uint32)] * 2

    def words(self, text: str) -> list[str]:
        if not self.by_word or text[:1] == " " or text[-1:] == " " or "  " in text or _AMID_WHITE(text):
            return [text]
        return text.split(" ")

    def learn(self, words: set[str]) -> None:
        if len(self.number) > KEPT or self.chars > KEPT_CHARS:
            self._forget()
        words = words - self.number.keys()
        self.chars += sum(map(len, words))
        line = [w for w in words if w and not w[0].isspace() and not w[-1].isspace() and not _BEYOND(w) and SPACE not in w] if self.by_word else []
        found = self._encoded_lines(line)
        if found:
            self._add(line, np.ones(len(line), bool), found)
            words = words.difference(line)
        rest = list(words)
        ids = [side.encode(rest) for side in self.sides]
        written = [b" " + w.encode() for w in rest]
        good = [all(b"".join(map(side.bytes.__getitem__, x[i])) == w for side, x in zip(self.sides, ids)) for i, w in enumerate(written)]
        self._add(rest, np.array(good, bool), [(np.array([len(x) for x in own], np.int64), np.fromiter(chain.from_iterable(own), np.uint32)) for own in ids])

    def _add(self, words: list[str], good: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.number.update(zip(words, range(len(self.good), len(self.good) + len(words))))
        self.good = np.concatenate([self.good, good])
        self.counts = [np.concatenate([x, counts]) for x, (counts, _) in zip(self.counts, found)]
        self.ids = [np.concatenate([x, ids]) for x, (_, ids) in zip(self.ids, found)]

    def _encoded_lines(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Encodes many words as lines and cuts the tokens at the words' ends; nothing if some don't end there."""
        lines = [" ".join(words[i:i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)]
        written = "".join(f" {x}" for x in lines).encode()
        word_ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        found = []
        for side in self.sides:
            ids = list(chain.from_iterable(side.encode(lines)))
            if b"".join(map(side.bytes.__getitem__, ids)) != written:
                return []
            ids = np.array(ids, np.uint32)
            ends = np.cumsum(side.lengths[ids])
            last = np.searchsorted(ends, word_ends)
            if not np.array_equal(ends[last], word_ends):
                return []
            found.append((np.diff(last, prepend=-1), ids))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(whether each text has tokens, by side the text and id of each token): empty texts and those whose
        bytes differ on a side have none."""
        split = [self.words(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        n_words = np.array([len(x) for x in split], np.int64)
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        text = np.repeat(np.arange(len(texts)), n_words)
        ok = (np.bincount(text, ~self.good[word], len(texts)) == 0) & np.array([bool(t) for t in texts], bool)
        word, text = word[ok[text]], text[ok[text]]
        out = []
        for counts, ids in zip(self.counts, self.ids):
            n = counts[word]
            first = np.cumsum(counts) - counts
            out.append((np.repeat(text, n), ids[np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].astype(np.int64)))
        return ok, out


_loaded: dict[tuple, WordTokens] = {}


def tokenizers(path_a: str, path_b: str) -> WordTokens:
    """The worker's two tokenizers."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = WordTokens(BytePairs(path_a), Pieces(path_b))
    return _loaded[path_a, path_b]


def text_parts(text: str, least: int = PART_CHARS) -> list[str]:
    """A long text in parts between which both tokenizers have a token end; each lost the space before it."""
    parts, a = [], 0
    while cut := _CUT.search(text, a + least):
        parts.append(text[a:cut.start()])
        a = cut.end()
    return [*parts, text[a:]]


@dataclass
class Aligned:
    """Tokens of a batch of texts: ids, text and group of each token, by side; overlaps as pairs of token numbers."""

    ok: np.ndarray  # of each text: both sides' bytes are the text's
    ids: tuple[np.ndarray, np.ndarray]
    text: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    last: tuple[np.ndarray, np.ndarray]  # whether a token is its group's last on its side
    overlaps: tuple[np.ndarray, np.ndarray]
    group_text: np.ndarray


def align(texts: list[str], tokens: WordTokens) -> Aligned:
    """Aligns each text's tokens; a text whose joined bytes differ on a side has none."""
    ok, found = tokens.encode(texts)
    frames = []
    for tokenizer, (text, ids) in zip(tokens.sides, found):
        length = tokenizer.lengths[ids]
        end = np.cumsum(length)
        frames.append(pd.DataFrame({"text": text, "start": end - length, "end": end, "id": ids, "token": np.arange(len(ids))}))
    left, right = frames
    covering = [pd.merge_asof(x[["text", "start", "end", "token"]], y[["text", "start", "end", "token"]], on="start", by="text", suffixes=("", "_other"))
                for x, y in ((left, right), (right, left))]
    # Where both start together the pair is found twice; it stays in the first direction.
    starts = np.isin(right["start"].to_numpy(), left["start"].to_numpy())
    second = covering[1][~starts]
    over_a = np.concatenate([covering[0]["token"].to_numpy(), second["token_other"].to_numpy()])
    over_b = np.concatenate([covering[0]["token_other"].to_numpy(), second["token"].to_numpy()])
    equal = np.concatenate([c["end"].to_numpy() == c["end_other"].to_numpy() for c in (covering[0], second)])
    ids, text, group, last = [], [], [], []
    for frame, over in ((left, over_a), (right, over_b)):
        ends = np.zeros(len(frame), bool)
        ends[over[equal]] = True
        ids.append(frame["id"].to_numpy())
        text.append(frame["text"].to_numpy())
        last.append(ends)
        group.append(np.cumsum(ends) - ends)
    order = np.argsort(over_a + over_b, kind="stable")
    return Aligned(ok, tuple(ids), tuple(text), tuple(group), tuple(last), (over_a[order], over_b[order]), text[0][last[0]])


_DIGITS: dict[int, np.ndarray] = {}


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1, right-aligned bytes with zeros before."""
    if n not in _DIGITS:
        width = len(str(n - 1))
        _DIGITS[n] = np.array([str(i).rjust(width, "\0").encode() for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)
    return _DIGITS[n]


def written_groups(found: Aligned, sizes: tuple[int, int]) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;``, and where each text's begin (the last place: the end)."""
    n_a, n_b = len(found.ids[0]), len(found.ids[1])
    n_groups = len(found.group_text)
    in_group = [np.bincount(g, minlength=n_groups) for g in found.group]
    place = [np.arange(n_a) + (np.cumsum(in_group[1]) - in_group[1])[found.group[0]], np.arange(n_b) + np.cumsum(in_group[0])[found.group[1]]]
    width = max(_digits(s).shape[1] for s in sizes)
    table = np.zeros((n_a + n_b, width + 1), np.uint8)
    for side, closing in ((0, "|"), (1, ";")):
        digits = _digits(sizes[side])
        table[place[side], width - digits.shape[1]:width] = digits[found.ids[side]]
        table[place[side], width] = np.where(found.last[side], ord(closing), ord(","))
    flat = table.ravel()
    body = flat[flat != 0]
    lengths = np.zeros(len(found.ok), np.int64)
    used = (table != 0).sum(1)
    for side in (0, 1):
        lengths += np.bincount(found.text[side], used[place[side]], len(found.ok)).astype(np.int64)
    return body.tobytes(), np.concatenate([[0], np.cumsum(lengths)])


def linked_ids(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, id of A, id of B, links) of all links, equal ones perhaps in several rows."""
    n_groups = len(found.group_text)
    size_a, size_b = (np.bincount(g, minlength=n_groups) for g in found.group)
    first_b = np.cumsum(size_b) - size_b
    wide = size_a * size_b > WIDE
    plain = np.flatnonzero(~wide[found.group[0]]) if n_groups else np.zeros(0, np.int64)
    many = size_b[found.group[0][plain]]
    at_a = np.repeat(plain, many)
    at_b = np.repeat(first_b[found.group[0][plain]] - np.cumsum(many) + many, many) + np.arange(len(at_a))
    out = [(found.text[0][at_a], found.ids[0][at_a], found.ids[1][at_b], np.ones(len(at_a), np.int64))]
    first_a = np.cumsum(size_a) - size_a
    for g in np.flatnonzero(wide):
        (ids_a, n_a), (ids_b, n_b) = (np.unique(ids[f:f + n], return_counts=True) for ids, f, n in ((found.ids[0], first_a[g], size_a[g]), (found.ids[1], first_b[g], size_b[g])))
        n = len(ids_a) * len(ids_b)
        out.append((np.full(n, found.group_text[g]), np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a)), np.outer(n_a, n_b).ravel()))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    if not len(keys):
        return keys, values
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def _text_batches(batches: Iterator[pa.RecordBatch], part_chars: int, slice_chars: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[int]]]:
    """(rows, parts of their texts, row of each part), of about ``slice_chars`` characters. Only the last row of
    one result may go on: then the next result's first parts belong to it too, and its rows are empty."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        first, parts, rows, size = 0, [], [], 0
        for i, text in enumerate(texts):
            for part in text_parts(text or "", part_chars):
                if size + len(part) > slice_chars and parts:
                    yield batch.slice(first, max(i, rows[-1] + 1) - first), parts, [r - first for r in rows]
                    first, parts, rows, size = max(i, rows[-1] + 1), [], [], 0
                parts.append(part)
                rows.append(i)
                size += len(part)
        if parts:
            yield batch.slice(first, len(texts) - first), parts, [r - first for r in rows]


@dataclass
class _Document:
    """What is known of one document so far."""

    hash: object
    sums: np.ndarray  # n_a, n_b, n_groups, n_links
    ok: bool = True
    first: bool = True


_DOC = ("n_a", "n_b", "n_groups", "n_links")


def _pack(values: np.ndarray) -> bytes:
    """32-bit numbers, each byte place together, compressed."""
    places = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(places.tobytes(), "zstd", asbytes=True)


def _unpack(body: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    places = np.frombuffer(pa.decompress(body, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(places.T).view("<u4").reshape(n)


class _Block:
    """The documents and linked id pairs of one block."""

    def __init__(self, number: int):
        self.number, self.chars, self.docs, self.ids, self.links = number, 0, [], [], []

    def add(self, rows: pa.RecordBatch, parts: list[str], part_rows: list[int], tokens: WordTokens, sizes: tuple[int, int]) -> None:
        base = len(self.docs)
        self.docs += [_Document(hashlib.sha256(), np.zeros(4, np.int64)) for _ in range(rows.num_rows)]
        self.ids.append(rows.column(0))
        self.chars += 64 * rows.num_rows
        owners = [base + r for r in part_rows]
        found = align(parts, tokens)
        body, bounds = written_groups(found, sizes)
        size_a, size_b = (np.bincount(g, minlength=len(found.group_text)) for g in found.group)
        n = len(parts)
        sums = np.stack([*(np.bincount(t, minlength=n) for t in found.text), np.bincount(found.group_text, minlength=n),
                         np.bincount(found.group_text, size_a * size_b, n).astype(np.int64)], 1)
        for i, at in enumerate(owners):
            doc = self.docs[at]
            doc.ok &= bool(found.ok[i])
            if doc.ok:
                doc.hash.update(body[bounds[i]:bounds[i + 1] - 1] if doc.first else b";" + body[bounds[i]:bounds[i + 1] - 1])
                doc.first = False
                doc.sums += sums[i]
            self.chars += len(parts[i])
        text, id_a, id_b, links = linked_ids(found)
        n_pairs = np.uint64(sizes[0] * sizes[1])
        key = np.array(owners, np.uint64)[text] * n_pairs + (id_a * sizes[1] + id_b).astype(np.uint64)
        self.links.append(_summed(key, links))

    def closed(self, sizes: tuple[int, int], names: list[str], id_type) -> Iterator[pa.RecordBatch]:
        n = len(self.docs)
        key, links = _summed(*(np.concatenate([x[i] for x in self.links]) for i in (0, 1)))
        n_pairs = np.uint64(sizes[0] * sizes[1])
        doc, pair = (key // n_pairs).astype(np.int64), (key % n_pairs).astype(np.int64)
        good = np.array([d.ok for d in self.docs], bool)
        own = good[doc]
        doc, pair, links = doc[own], pair[own], links[own]
        table, place = np.unique(pair, return_inverse=True)
        if links.size and links.max() >= 1 << 32:
            raise OverflowError("a document links one pair of ids over 2**32 times")
        ids = pa.concat_arrays(self.ids)
        nothing = {"id": id_type, "groups_sha256": pa.string(), "body": pa.binary(), "a": pa.int32(), "b": pa.int32()}

        def batch(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, nothing.get(c, pa.int64())) for c in names], names=names)

        number = np.full(max(n, len(table), 1), self.number)
        stats = np.stack([d.sums if d.ok else np.zeros(4, np.int64) for d in self.docs], 1)
        yield batch(n, kind=pa.array(np.full(n, DOC)), block=pa.array(number[:n]), at=pa.array(np.arange(n)), id=ids,
                    groups_sha256=pa.array([d.hash.hexdigest() if d.ok else "" for d in self.docs], pa.string()), **{c: pa.array(v) for c, v in zip(_DOC, stats)})
        step = np.diff(place.astype(np.uint32), prepend=np.uint32(0))
        packed = [_pack(np.bincount(doc, minlength=n)), _pack(step), _pack(links)]
        body = b"".join(len(p).to_bytes(8, "little") + p for p in packed)
        yield batch(1, kind=pa.array([LINKS]), block=pa.array(number[:1]), body=pa.array([body], pa.binary()), n_docs=pa.array([n]), n_pairs=pa.array([len(place)]))
        holders = np.bincount(place, minlength=len(table))
        for a in range(0, len(table), 1 << 16):
            own = slice(a, a + (1 << 16))
            m = len(table[own])
            yield batch(m, kind=pa.array(np.full(m, PAIR)), block=pa.array(number[:m]), a=pa.array((table[own] // sizes[1]).astype(np.int32)),
                        b=pa.array((table[own] % sizes[1]).astype(np.int32)), holders=pa.array(holders[own]))


DOC, LINKS, PAIR = range(3)


def _blocks(docs: DataFrame, path_a: str, path_b: str, sizes: tuple[int, int, int]) -> DataFrame:
    """One pass over the texts, written by kind: documents, a block's links, and its id pairs."""
    long = T.LongType()
    schema = T.StructType([T.StructField("kind", long), T.StructField("block", long), T.StructField("at", long), T.StructField("id", docs.schema["id"].dataType),
                           *[T.StructField(c, long) for c in _DOC], T.StructField("groups_sha256", T.StringType()), T.StructField("body", T.BinaryType()),
                           T.StructField("n_docs", long), T.StructField("n_pairs", long), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
                           T.StructField("holders", long)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_chars, slice_chars, block_chars = sizes
        tokens = tokenizers(path_a, path_b)
        vocabulary = tuple(len(side.bytes) for side in tokens.sides)
        block, id_type = _Block(TaskContext.get().partitionId() << 32), None
        for rows, parts, part_rows in _text_batches(batches, part_chars, slice_chars):
            id_type = rows.schema.field(0).type
            if block.chars >= block_chars and part_rows[0] >= 0:
                yield from block.closed(vocabulary, names, id_type)
                block = _Block(block.number + 1)
            block.add(rows, parts, part_rows, tokens, vocabulary)
        if block.docs:
            yield from block.closed(vocabulary, names, id_type)

    return map_arrow(docs.select("id", "text"), run, schema)


def _score_blocks(names: list[str]):
    """(block, at, n_best, count_sum) of the documents of each block, whose pairs' counts come before its links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts, best = None, [], []
        for batch in batches:
            blocks, is_links = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, counts, best = blocks[a], [], []
                own = slice(a, b - int(is_links[b - 1]))
                counts.append(batch.column(2).to_numpy()[own])
                best.append(batch.column(3).to_numpy(zero_copy_only=False)[own])
                if is_links[b - 1]:
                    row = batch.slice(b - 1, 1).to_pylist()[0]
                    yield scored(block, np.concatenate(counts), np.concatenate(best), row["body"], row["n_docs"], row["n_pairs"])

    def scored(block: int, counts: np.ndarray, best: np.ndarray, body: bytes, n: int, n_pairs: int) -> pa.RecordBatch:
        packed, at = [], 0
        for _ in range(3):
            size = int.from_bytes(body[at:at + 8], "little")
            packed.append(body[at + 8:at + 8 + size])
            at += 8 + size
        sizes, step, links = _unpack(packed[0], n).astype(np.int64), _unpack(packed[1], n_pairs), _unpack(packed[2], n_pairs).astype(np.int64)
        place = np.cumsum(step, dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])]) for v in (links * best[place], links * counts[place])]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n)), *map(pa.array, sums)], names=names)

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS,
                    slice_chars: int = SLICE_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a byte-level BPE file) encodes space + text, B (a SentencePiece file) the text, to which it puts the
    space. Byte offsets where tokens of both end cut them into groups; all tokens of a group are linked. The
    count of a pair of ids is the number of documents in which it is linked; ``n_best`` are the links whose
    count is the highest of their A id (ties too), ``count_sum`` is over all links. The hash is of
    ``a1,a2|b1;...``. Null and empty texts, and those whose joined token bytes differ from space + text on
    either side, have no tokens: zeros and ''. Each repeated row is a document; a null id stays null; other
    columns are not read. The sizes of parts, slices and blocks bound memory and don't change the result.
    """
    n_parts = shuffle_partitions(docs.sparkSession)
    written = materialize(_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path_a, path_b, (part_chars, slice_chars, block_chars)), "align")
    pairs = written.where(F.col("kind") == PAIR).select("block", "a", "b", "holders")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("holders").alias("n")), "align-counts")
    # One row for each id of A's vocabulary at most.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("highest")))
    counts = counts.join(highest, "a").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))
    valued = pairs.join(counts, ["a", "b"]).select("block", F.lit(False).alias("is_links"), "n", "best", "a", "b", F.lit(None).cast("binary").alias("body"), F.lit(0).cast("long").alias("n_docs"),
                                                   F.lit(0).cast("long").alias("n_pairs"))
    links = written.where(F.col("kind") == LINKS).select("block", F.lit(True), F.lit(0).cast("long"), F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("int"), "body", "n_docs", "n_pairs")
    ordered = valued.union(links).repartition(n_parts, "block").sortWithinPartitions("block", "is_links", "a", "b")
    schema = "block long, at long, n_best long, count_sum long"
    sums = map_arrow(ordered.drop("a", "b"), _score_blocks([f.split(" ")[0] for f in schema.split(", ")]), schema)
    rows = written.where(F.col("kind") == DOC).select("block", "at", "id", *_DOC, "groups_sha256")
    return rows.join(sums, ["block", "at"]).select(F.col("id").alias(id_col), *_DOC, "n_best", "count_sum", "groups_sha256")


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, the token ids of both sides, the group of each token, and the
    overlaps as pairs of token numbers. Cases as in ``align_documents``; without tokens the lists are empty."""
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           *[T.StructField(c, numbers) for c in ("ids_a", "ids_b", "group_a", "group_b", "overlap_a", "overlap_b")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizers(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j = i + 1
                while j < len(texts) and sum(map(len, texts[i:j + 1])) <= SLICE_CHARS and j - i < 64:
                    j += 1
                yield listed(batch.column(0).slice(i, j - i), align(texts[i:j], tokens))
                i = j

    def listed(ids: pa.Array, found: Aligned) -> pa.RecordBatch:
        n = len(ids)
        first = [np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n))]) for t in found.text]
        first_group = np.concatenate([[0], np.cumsum(np.bincount(found.group_text, minlength=n))])
        over_text = found.text[0][found.overlaps[0]]
        first_over = np.concatenate([[0], np.cumsum(np.bincount(over_text, minlength=n))])
        values = [(found.ids[0], first[0]), (found.ids[1], first[1]), *[(g - first_group[t], f) for g, t, f in zip(found.group, found.text, first)],
                  *[(o - f[over_text], first_over) for o, f in zip(found.overlaps, first)]]
        return pa.RecordBatch.from_arrays([ids, *[pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.array(v, pa.int32())) for v, f in values]], names=schema.fieldNames())

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)
