"""Pack token pieces into fixed windows by minimum bin slack.

Documents are tokenized where they lie and cut into pieces: full windows and one remainder each.
The remainders are packed by length: the histogram of lengths (at most ``capacity`` numbers, however
many documents there are) is all that the plan needs. For each window the plan takes the largest
length left and, by bitset subset-sum, the multiset of other lengths left that fills the window
closest to its capacity; the same pattern is repeated as often as the counts allow. Pieces then find
their window by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import map_arrow, materialize

CAPACITY = 4096
END_ID = 2
#: Kept token ids of words: so many at most, of words of so many characters at most.
KEPT_WORDS, KEPT_CHARS = 400_000, 64

# The normalizer and the pre-tokenizer pattern of a lower-casing word BPE with word ends.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
_END_BYTE = b"\xff"  # stands for the word end; UTF-8 has no such byte
#: Up to this character every letter is its own normal form and lower case goes letter by letter.
_LAST_PLAIN = "\u024f"


class WordEncoder(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, for a word BPE; frequent words are kept.

    Words of plain letters are merged by their ranks; all others, and words with a special token in
    them, go through the tokenizer itself. Both ways give the same ids.
    """

    def __init__(self, tokenizer, vocabulary: dict[str, int], specials: list[str]):
        from tiktoken._tiktoken import CoreBPE
        super().__init__()
        self.tokenizer = tokenizer
        self.specials = specials
        self.find = regex.compile(_PATTERN).findall
        self.merge = CoreBPE(_byte_ranks(vocabulary, specials), {}, r"\S+").encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if word and max(word) <= _LAST_PLAIN and not any(s in word for s in self.specials):
            ids = [i for piece in self.find(word.lower()) for i in self.merge(piece.encode() + _END_BYTE)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < KEPT_WORDS and len(word) <= KEPT_CHARS:
            self[word] = out
        return out


def _byte_ranks(vocabulary: dict[str, int], specials: list[str]) -> dict[bytes, int]:
    """Tokens as bytes, from the printable letters that byte-level BPE writes for bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    out = {}
    for token, i in vocabulary.items():
        if token not in specials:
            core = token.removesuffix(_WORD_END)
            out[bytes(byte_of[c] for c in core) + (_END_BYTE if core != token else b"")] = i
    return out


_encoders: dict[str, tuple] = {}


def _encoder(path: str):
    """The worker's tokenizer of that file, and its word encoder if it is a word BPE of the known kind."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        split = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = ((config.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and config["model"].get("end_of_word_suffix") == _WORD_END
                 and split[0].get("pattern") == {"Regex": _PATTERN} and [x.get("type") for x in split] == ["Split", "ByteLevel"])
        words = WordEncoder(tokenizer, config["model"]["vocab"], [t["content"] for t in config["added_tokens"]]) if known else None
        _encoders[path] = tokenizer, words
    return _encoders[path]


_TO_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _words(text: str) -> list[str]:
    """Words by white space; separators that only Python's split knows stay inside their word."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in text.translate(_TO_SPACES).split(" ") if w]
    return text.split()


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without special tokens.

    A word BPE drops white space and never joins words, so its texts are encoded word by word.
    """
    tokenizer, words = _encoder(path)
    if words is None:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return [b"".join(map(words.__getitem__, _words(t))) for t in texts]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of each row of ``docs``: every full window, then the remainder.

    A null text counts as empty and still has the end id; a null id stays null; each repeated row has
    pieces of its own; other columns are not read. ``part`` and ``at`` number the rows (for ranks).
    With ``keep_ids`` the ids themselves are kept too.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "part", "at")],
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                encoded = encode_texts([t or "" for t in batch.column(1).to_pylist()], tokenizer_path)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, body in enumerate(encoded):
                    body += end
                    n = len(body) // 4
                    for s in range(0, n, capacity):
                        piece = body[4 * s:4 * (s + capacity)]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if keep_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                numbers = [start, length, crc, total, [part] * len(row), range(at, at + len(row))]
                at += len(row)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in numbers]]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return map_arrow(docs.select(id_col, text_col), run, schema)


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Windows as patterns ({length: pieces of it in each window}, number of such windows) using every piece once."""
    left = {k: n for k, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    patterns = []
    while order:
        largest = order[0]
        room = capacity - largest
        mask, reach = (1 << (room + 1)) - 1, 1
        steps = []  # (length, pieces, reachable sums before)
        for size in order:
            if size > room:
                continue
            most = min(left[size] - (size == largest), room // size)
            part = 1
            while most > 0 and not reach >> room & 1:
                part = min(part, most)
                steps.append((size, part, reach))
                reach |= reach << (part * size) & mask
                most -= part
                part *= 2
            if reach >> room & 1:
                break
        filled = reach.bit_length() - 1
        used = {largest: 1}
        for size, part, before in reversed(steps):
            if not before >> filled & 1:
                used[size] = used.get(size, 0) + part
                filled -= part * size
        times = min(left[size] // n for size, n in used.items())
        patterns.append((used, times))
        for size, n in used.items():
            left[size] -= n * times
        order = [size for size in order if left[size]]
    return patterns


def _slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a window, first sequence, offset), by length and first rank."""
    rows, rank, sequence = [], {}, 0
    for used, times in patterns:
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            first = rank.get(size, 0)
            rows.append((size, first, n, sequence, offset))
            rank[size] = first + n * times
            offset += n * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written ``pieces`` (rows with length, part and at).

    The driver sees one count for each length. Ranks are made within (length, part), so a length
    that a third of all pieces has is still spread over all parts.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots = _slots(minimum_bin_slack(counts, capacity))
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("at")) - 1 + F.col("__first")
    ranked = pieces.join(firsts, ["length", "part"]).withColumn("__rank", rank.cast("long"))
    out = T.StructType([f for f in pieces.schema.fields if f.name not in ("part", "at")]
                       + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    kept = [f.name for f in out.fields[:-2]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            slot = slots[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(slot[:, 3] + nth // slot[:, 2]), pa.array(slot[:, 4] + nth % slot[:, 2] * length)], names=out.fieldNames())

    return map_arrow(ranked.select(*kept, "__rank"), place, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece with its sequence and offset.

    The pieces are written once to the shared folder. An empty table gives no rows. For null and
    empty texts, repeated rows and other columns see :func:`token_pieces`.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole windows from pieces that kept their ids: sequence_id, length and ids in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most a window of ids
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")).withColumn("length", F.size("ids"))
