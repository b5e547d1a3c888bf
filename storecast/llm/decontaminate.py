"""Benchmark passages in training texts, by a distributed positional inverted index.

The index is a written table of blocks: every block of about 16 MB of text holds, for each of its terms,
the sorted list of the term's positions (words counted through the block, with a gap of one between
texts, so that a phrase never runs on into the next text). The windows of the benchmark go over the
blocks in bounded chunks. In each block a window starts from the list of its rarest term, shifted by
the term's place in the window, and intersects it with the shifted lists of the other terms from rare to
frequent: what is left are the exact occurrences. For proximity the lists must meet within a span of words,
in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import map_arrow, materialize
from storecast.llm.tokens import PUNCTUATION, Hasher, lower, slices, word_bounds

#: Consecutive words of a benchmark item that make a window.
WINDOW = 10
#: A window's words within so many words, in any order, are a proximity match.
NEAR = 20
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Words of benchmark items in one chunk, and in one piece of a long item.
CHUNK_WORDS, PIECE_WORDS = 1 << 18, 1 << 16
#: Candidates that are intersected at once.
BATCH = 1 << 20


@dataclass
class Index:
    """A written index: ``rows`` has a row for each text (block, at, id, n_words), ``blocks`` the lists of each block."""

    rows: DataFrame
    blocks: DataFrame


def _pack(values: np.ndarray) -> bytes:
    """Differences of the values, each byte place together, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    width = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, width).T).tobytes(), "zstd", asbytes=True)


def _unpack(body: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    places = np.frombuffer(pa.decompress(body, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.cumsum(np.ascontiguousarray(places.T).view(dtype).reshape(n), dtype=dtype)


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end where a word can't go on."""
    a = 0
    while a < len(data):
        b = min(len(data), a + SLICE_BYTES)
        while b < len(data):
            cuts = np.flatnonzero(PUNCTUATION[data[b:b + SLICE_BYTES]])
            if len(cuts):
                b += int(cuts[0])
                break
            b = min(len(data), b + SLICE_BYTES)
        yield data[a:b]
        a = b


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, row of each word) of a text column, slice by slice; words are runs of
    ASCII letters and digits and of other characters beyond ASCII, with A-Z in lower case."""
    for first, data, offsets in slices(column, SLICE_BYTES):
        n = len(offsets) - 1
        if n == 1 and len(data) > 2 * SLICE_BYTES:
            found = []
            for part in _parts(data):
                part = lower(part)
                s, e, _ = word_bounds(part, np.array([0, len(part)]), PUNCTUATION)
                found.append(Hasher(part)(s, e))
            words = np.concatenate(found)
            yield first, n, words, np.zeros(len(words), np.int64)
            continue
        data = lower(data)
        s, e, rows = word_bounds(data, offsets, PUNCTUATION)
        yield first, n, Hasher(data)(s, e), rows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Index:
    """The positional index of all texts (null: no words), written to the shared folder.

    Every row is a text of its own, whatever its id; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("id", id_type), T.StructField("n_words", T.LongType()),
                           T.StructField("n_rows", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("n_places", T.LongType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("terms", "sizes", "places", "firsts")]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, words, places, counts, arrow_id = TaskContext.get().partitionId() << 32, 0, [], [], [], None
        n_rows = n_places = 0

        def closed() -> pa.RecordBatch:
            code, terms = pd.factorize(np.concatenate(words))
            order = np.argsort(terms)
            rank = np.empty(len(terms), np.uint64)
            rank[order] = np.arange(len(terms), dtype=np.uint64)
            lists = np.sort(rank[code] << np.uint64(32) | np.concatenate(places).astype(np.uint64))
            per_row = np.concatenate(counts)
            firsts = (np.cumsum(per_row + 1) - per_row - 1).astype(np.uint32)
            sizes = np.bincount((lists >> np.uint64(32)).astype(np.int64), minlength=len(terms)).astype(np.uint32)
            packed = [_pack(terms[order]), _pack(sizes), _pack((lists & np.uint64(0xFFFFFFFF)).astype(np.uint32)), _pack(firsts)]
            values = [pa.array([block]), *[pa.nulls(1, t) for t in (pa.int64(), arrow_id, pa.int64())],
                      *[pa.array([n]) for n in (n_rows, len(terms), len(lists))], *[pa.array([b], pa.binary()) for b in packed]]
            return pa.RecordBatch.from_arrays(values, names=names)

        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for first, n, found, rows in word_hashes(batch.column(1)):
                per_row = np.bincount(rows, minlength=n)
                words.append(found)
                places.append((n_places + n_rows + rows + np.arange(len(found))).astype(np.uint32))
                counts.append(per_row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(n_rows, n_rows + n)), batch.column(0).slice(first, n), pa.array(per_row),
                     *[pa.nulls(n, pa.int64())] * 3, *[pa.nulls(n, pa.binary())] * 4], names=names)
                n_rows, n_places = n_rows + n, n_places + len(found)
                size += 9 * len(found) + n
                if size >= block_bytes:
                    yield closed()
                    block, size, words, places, counts, n_rows, n_places = block + 1, 0, [], [], [], 0, 0
        if n_rows:
            yield closed()

    written = materialize(map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema), "index")
    return Index(written.where("at is not null").select("block", "at", "id", "n_words"), written.where("at is null").drop("at", "id", "n_words"))


class Lists:
    """The lists of one block, unpacked."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, places: np.ndarray, firsts: np.ndarray):
        self.terms, self.sizes, self.firsts = terms, sizes.astype(np.int64), firsts.astype(np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.keys = np.repeat(np.arange(len(terms), dtype=np.uint64) << np.uint64(32), self.sizes) | places  # term << 32 | place, sorted

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term in this block, -1 where it has none."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def row(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, side="right") - 1

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of the term at or after ``place`` (a huge one if there is none)."""
        at = np.searchsorted(self.keys, term.astype(np.uint64) << np.uint64(32) | np.maximum(place, 0).astype(np.uint64))
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        there = (at < len(self.keys)) & (key >> np.uint64(32) == term.astype(np.uint64))
        return np.where(there, (key & np.uint64(0xFFFFFFFF)).astype(np.int64), 1 << 40)


@dataclass
class Windows:
    """Windows of one length: term hashes [window, place] and the number of each window's item."""

    hashes: np.ndarray
    items: np.ndarray


def windows_of(pieces: list[tuple[int, np.ndarray]], size: int) -> list[Windows]:
    """All windows of the pieces (item number, word hashes), by length."""
    by_length: dict[int, tuple[list, list]] = {}
    for item, words in pieces:
        if len(words):
            own = np.lib.stride_tricks.sliding_window_view(words, min(size, len(words)))
            hashes, items = by_length.setdefault(own.shape[1], ([], []))
            hashes.append(own)
            items.append(np.full(len(own), item))
    return [Windows(np.concatenate(h), np.concatenate(i)) for h, i in by_length.values()]


def _batches(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of windows with about BATCH candidates together (one window at least)."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BATCH, side="right")))
        yield slice(a, b)
        a = b


def _candidates(lists: Lists, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of all places of each window's rarest term."""
    n = lists.sizes[rarest]
    window = np.repeat(np.arange(len(rarest)), n)
    ramp = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    return window, (lists.keys[np.repeat(lists.begin[rarest], n) + ramp] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def exact(lists: Lists, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, first place) of every occurrence of a window in the block."""
    terms = lists.find(windows.hashes)
    whole = np.flatnonzero((terms >= 0).all(1))
    terms = terms[whole]
    order = np.argsort(lists.sizes[terms], axis=1, kind="stable")
    by_rarity = np.take_along_axis(terms, order, 1)
    found = [(np.zeros(0, np.int64),) * 2]
    for run in _batches(lists.sizes[by_rarity[:, 0]]) if len(whole) else ():
        window, place = _candidates(lists, by_rarity[run, 0])
        window += run.start
        start = place - order[window, 0]
        for k in range(1, terms.shape[1]):
            own = start >= 0
            window, start = window[own], start[own]
            wanted = by_rarity[window, k].astype(np.uint64) << np.uint64(32) | (start + order[window, k]).astype(np.uint64)
            at = np.searchsorted(lists.keys, wanted)
            there = lists.keys[np.minimum(at, len(lists.keys) - 1)] == wanted
            window, start = window[there], start[there]
        found.append((whole[window[start >= 0]], start[start >= 0]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def close(lists: Lists, windows: Windows, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first place, words) of the spans of at most ``near`` words in one text that hold all terms of a window;
    of the spans around one place of its rarest term the shortest, then the first."""
    terms = lists.find(windows.hashes)
    whole = np.flatnonzero((terms >= 0).all(1))
    terms = terms[whole]
    by_rarity = np.take_along_axis(terms, np.argsort(lists.sizes[terms], axis=1, kind="stable"), 1)
    found = [(np.zeros(0, np.int64),) * 3]
    for run in _batches(near * lists.sizes[by_rarity[:, 0]]) if len(whole) else ():
        window, place = _candidates(lists, by_rarity[run, 0])
        window += run.start
        for k in range(1, terms.shape[1]):
            there = lists.next(by_rarity[window, k], place - near + 1) < place + near
            window, place = window[there], place[there]
        best, first = np.full(len(window), near + 1), np.zeros(len(window), np.int64)
        row = lists.row(place)
        for back in range(near):
            start = np.maximum(place - back, 0)
            end = np.max([lists.next(by_rarity[window, k], start) for k in range(terms.shape[1])], axis=0) if len(window) else start
            words = np.where((place >= back) & (lists.row(start) == row), np.maximum(end, place) - start + 1, near + 1)
            inside = lists.row(start + words - 1) == row
            better = inside & (words <= near) & (words <= best)
            best, first = np.where(better, words, best), np.where(better, start, first)
        some = best <= near
        found.append((whole[window[some]], first[some], best[some]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _merged(row: np.ndarray, item: np.ndarray, start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching occurrences of one item in one text as one passage (their windows are of one length)."""
    order = np.lexsort((start, item, row))
    row, item, start, words = row[order], item[order], start[order], words[order]
    if not len(row):
        return row, item, start, words
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + words[:-1])])
    last = np.r_[first[1:], len(row)] - 1
    return row[first], item[first], start[first], start[last] + words[last] - start[first]


def _tightest(row: np.ndarray, item: np.ndarray, start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The shortest, then first, span of each item in each text."""
    order = np.lexsort((start, words, item, row))
    row, item, start, words = row[order], item[order], start[order], words[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]) if len(row) else []
    return row[first], item[first], start[first], words[first]


def item_pieces(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text", most: int = PIECE_WORDS) -> DataFrame:
    """Word hashes of each item (id as a string, null: empty) in pieces that overlap by a window less a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, words, rows in word_hashes(batch.column(1)):
                bounds = np.searchsorted(rows, np.arange(n + 1))
                own = [(first + r, words[a:min(b, a + most + size - 1)]) for r in range(n) for b in (bounds[r + 1],)
                       for a in range(bounds[r], max(bounds[r] + 1, b - size + 1), most) if b > bounds[r]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in own], pa.int64())), pa.array([w.tobytes() for _, w in own], pa.binary())],
                                                 names=["item", "words"])

    return map_arrow(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")), run, "item string, words binary")


def _chunks(pieces: DataFrame) -> Iterator[tuple[list[str], list[tuple[int, np.ndarray]]]]:
    """The items' pieces in chunks of at most CHUNK_WORDS words (and one piece), one after the other."""
    names, own, size = {}, [], 0
    for row in pieces.toLocalIterator():
        words = np.frombuffer(row.words, np.uint64)
        if size + len(words) > CHUNK_WORDS and own:
            yield list(names), own
            names, own, size = {}, [], 0
        own.append((names.setdefault(row.item, len(names)), words))
        size += len(words)
    if own:
        yield list(names), own


_FOUND = "block long, at long, item_id string, start long, n_words long, exact boolean"


def find_passages(index: Index, items: DataFrame, size: int = WINDOW, near: int | None = None, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(block, at, item_id, start, n_words, exact): passages of the items in the indexed texts.

    Exact rows are maximal runs of words covered by occurrences of an item's windows: ``size`` consecutive
    words, or the whole item where it has fewer. With ``near``, further rows (``exact`` false) give, for each
    text and item, the tightest span of at most ``near`` words that holds all words of one of its windows, in
    any order. Items without words match nothing; rows of one item_id are one item; a null id is the
    item ''. The items are taken in bounded chunks, one pass over the index each.
    """
    spark = index.blocks.sparkSession
    found = None
    for names, pieces in _chunks(item_pieces(items, size, id_col, text_col)):
        shared = spark.sparkContext.broadcast((names, pieces))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            labels, windows = pa.array(shared.value[0], pa.string()), windows_of(shared.value[1], size)
            for batch in batches:
                for b in batch.to_pylist():
                    lists = Lists(_unpack(b["terms"], b["n_terms"], np.uint64), _unpack(b["sizes"], b["n_terms"], np.uint32),
                                  _unpack(b["places"], b["n_places"], np.uint32), _unpack(b["firsts"], b["n_rows"], np.uint32))
                    for is_exact, group in ((True, _merged), (False, _tightest)):
                        rows = []
                        for w in windows if len(lists.keys) and (is_exact or near) else ():
                            hit = (*exact(lists, w), None) if is_exact else close(lists, w, near)
                            words = np.full(len(hit[0]), w.hashes.shape[1]) if is_exact else hit[2]
                            rows.append(group(lists.row(hit[1]), w.items[hit[0]], hit[1], words))
                        if rows:
                            row, item, start, words = (np.concatenate([r[i] for r in rows]) for i in range(4))
                            n = len(row)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b["block"])), pa.array(row), labels.take(pa.array(item)), pa.array(start - lists.firsts[row]),
                                                              pa.array(words), pa.array(np.full(n, is_exact))], names=["block", "at", "item_id", "start", "n_words", "exact"])

        one = map_arrow(index.blocks, run, _FOUND)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], _FOUND) if found is None else found


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit (words inside an exact passage), n_items, items_sha256 (of
    their ids, sorted as strings, comma-joined), contaminated; with ``near`` also n_near_items (items with all
    words of a window within so many words).

    Null and empty texts have no words; each repeated row counts for itself; a null id stays null. Without
    items nothing is hit. Other columns are not read.
    """
    index = build_index(docs, id_col, text_col)
    found = materialize(find_passages(index, items, size, near, item_col, item_text_col), "passages")
    ahead = Window.partitionBy("block", "at").orderBy("start", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n_words")
    hits = (found.where("exact").withColumn("covered", F.coalesce(F.max(end).over(ahead), F.lit(0)))
            .groupBy("block", "at").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered"))).alias("n_hit"),
                                        F.array_sort(F.collect_set("item_id")).alias("own")))
    if near:
        hits = hits.join(found.groupBy("block", "at").agg(F.count_distinct("item_id").alias("n_near_items")), ["block", "at"], "full")
    n_hit, own = F.coalesce("n_hit", F.lit(0)), F.coalesce("own", F.array().cast("array<string>"))
    return index.rows.join(hits, ["block", "at"], "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(own, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        *([F.coalesce("n_near_items", F.lit(0)).alias("n_near_items")] if near else []))
