"""SentencePiece encoding and decoding: Aho-Corasick automaton over the pieces, single-pass Viterbi.

The automaton reads a text once; at each position its output links name every piece that ends there,
and each relaxes the best score of that position. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import map_arrow

SPACE = "▁"
#: Kept ids of segments: so many at most, of so many characters at most.
KEPT, KEPT_CHARS = 400_000, 64
#: What a character without a piece costs below the least score.
UNKNOWN_PENALTY = 10.0
_LONE = "\n\t\r"


class PieceModel(dict):
    """Segment -> its ids as little-endian 32-bit integers; frequent segments are kept.

    Texts are cut into segments at places that no piece spans: before the first of a run of spaces,
    and around line breaks and tabs. Cutting there doesn't change the best path.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        super().__init__()
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normalizer that keep white space are supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = processor.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.output: list[bytes] = [b""] * n
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        least, spans_space, spans_lone = 0.0, False, False
        for i in range(n):
            if processor.is_control(i) or processor.is_unused(i):
                continue
            piece = processor.id_to_piece(i)
            if processor.is_unknown(i):
                self.unknown = i
                self.output[i] = " ⁇ ".encode()
            elif processor.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.output[i] = bytes([int(piece[3:5], 16)])
            else:
                score = processor.get_score(i)
                least = min(least, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                self.output[i] = piece.replace(SPACE, " ").encode()
                if len(piece) == 1:
                    self.single.add(piece)
                spans_space |= SPACE in piece.lstrip(SPACE)
                spans_lone |= len(piece) > 1 and any(c in piece for c in _LONE)
        self.automaton.make_automaton()
        self.unknown_score = least - UNKNOWN_PENALTY
        lone = "" if spans_lone else _LONE
        self.cut = (lambda text: [text] if text else []) if spans_space else re.compile(rf"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else "")).findall

    def best_path(self, segment: str) -> list[int]:
        """Ids of the pieces of the highest total score; of equal scores the path whose last differing piece is longest."""
        n = len(segment)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        filled, single, unknown = 0, self.single, self.unknown_score
        for last, (length, score, i) in self.automaton.iter(segment):
            end = last + 1
            while filled < end:
                if segment[filled] not in single:
                    best[filled + 1], back[filled + 1] = best[filled] + unknown, (filled, -1)
                filled += 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (end - length, i)
        for p in range(filled, n):
            best[p + 1], back[p + 1] = best[p] + unknown, (p, -1)
        out: list[int] = []
        end = n
        while end:
            start, i = back[end]
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(segment[start:end].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            end = start
        return out[::-1]

    def __missing__(self, segment: str) -> bytes:
        ids = self.best_path(segment)
        packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(self) < KEPT and len(segment) <= KEPT_CHARS:
            self[segment] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; an empty text has none."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.cut(self.prefix + text.replace(" ", SPACE))))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces one after another, byte pieces as UTF-8 (broken bytes become U+FFFD), without the prefix space."""
        body = b"".join([self.output[i] for i in ids])
        if self.prefix and body.startswith(b" "):
            body = body[1:]
        return body.decode("utf-8", "replace")


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The worker's model of that file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, ``ids`` and ``round_trip`` (the decoded ids are the text).

    A null text counts as empty and has no ids; a null id stays null; repeated rows give repeated
    results; other columns are not read. round_trip is false only for texts with U+2581, which
    decodes to a space as in the library. No shuffle; texts are encoded whole.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                packed = [model.encode(t) for t in texts]
                lengths = np.array([len(p) // 4 for p in packed], np.int64)
                ids = np.frombuffer(b"".join(packed), "<i4")
                offsets = np.r_[0, np.cumsum(lengths)]
                plain = ids.tolist()
                same = [model.decode(plain[a:b]) == t for a, b, t in zip(offsets, offsets[1:], texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(same)], names=schema.fieldNames())

    return map_arrow(docs.select(id_col, text_col), run, schema)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: its id and the text of its ids (null ids: null; ids out of range: an error)."""
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.fieldNames())

    return map_arrow(encoded.select(F.col(id_col), F.col(ids_col)), run, schema)
