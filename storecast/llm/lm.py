"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space, then one end byte. Every byte is eight
binary decisions; each decision has a tree of contexts, the preceding bytes up to ``DEPTH``. A node
estimates its next bit by Krichevsky-Trofimov; the weight of stopping at a node or going on to its
children is the posterior of the training counts (half each before any). The mixture over all depths
gives a probability for every byte, and so the code length of a text.

The counts of all training texts are gathered: tasks count (context, byte) pairs and words of blocks
of texts and send them, packed, by ranges of the context. A range's tables are merged in rounds of
bounded groups, and its subtrees are weighted in one task, whose load grows with the different
contexts alone; only the two top levels (at most 256 nodes of 255 decisions) pass through the driver.
The probabilities of a block's pairs then go back to the block, where its texts are summed up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import fold, map_arrow, materialize, shuffle_partitions
from storecast.llm.tokens import SPACES, Hasher, lower, mix, slices, word_bounds

DEPTH = 5
#: Levels of the tree that are shared out by context; those above pass through the driver.
TOP = 2
SPACE, END = 0x20, 0x0A
BLOCK_BYTES = 16 << 20
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 15
#: Keys that a task merges or looks up at once (more where a range has more different ones), and tables merged at once where they are large.
GROUP_KEYS, FAN = 4 << 20, 8
GRAMS, WORDS = 0, 1
_CODEC = "zstd"


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair key, row) of every byte of the rows' streams, and the words' hashes by word with their rows.

    A key is the DEPTH preceding bytes, nearest first, then the byte itself, eight bits each.
    Before a text stand end bytes.
    """
    n = len(offsets) - 1
    s, e, word_rows = word_bounds(data, offsets)
    inside = ~SPACES[data]
    kept = inside.copy()  # the words' bytes and one byte after each
    after = e[e < len(data)]
    kept[after[~np.isin(after, offsets)]] = True
    before = np.r_[0, np.cumsum(kept, dtype=np.int64)]
    letters = before[offsets[1:]] - before[offsets[:-1]]
    open_end = np.zeros(n, np.int64)  # a text that ends in a word lacks its space
    some = offsets[1:] > offsets[:-1]
    open_end[some] = inside[offsets[1:][some] - 1]
    size = DEPTH + letters + open_end + 1
    begin = np.cumsum(size) - size
    total = int(size.sum())
    real = np.ones(total, bool)
    for j in range(DEPTH):
        real[begin + j] = False
    own = real.copy()
    own[begin + size - 1] = False
    own[(begin + size - 2)[open_end > 0]] = False
    out = np.full(total + 8, END, np.uint8)
    out[(begin + size - 2)[open_end > 0]] = SPACE
    out[:total][own] = np.where(inside, data, SPACE)[kept]
    at = np.flatnonzero(real)
    eight = np.ndarray((total,), "<u8", out, strides=(1,))  # the eight bytes from each place on
    key = eight[at - DEPTH] << np.uint64(64 - 8 * DEPTH) >> np.uint64(56 - 8 * DEPTH) | out[at].astype(np.uint64)
    return key, np.repeat(np.arange(n), size - DEPTH), word_rows


def _tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])


def _summed(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted table of keys and summed counts."""
    k, c = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(c, first)


def part_of(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """The range a key belongs to: for pairs a hash of the TOP nearest bytes, for words a hash of the word."""
    h = mix(keys >> np.uint64(8 * (DEPTH + 1 - TOP))) if kind == GRAMS else keys
    return (h >> np.uint64(32)) % np.uint64(parts)


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), _CODEC, asbytes=True)


def _unpack(body: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, n * np.dtype(dtype).itemsize, _CODEC, asbytes=True), dtype) if n else np.zeros(0, dtype)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as bytes of their differences, each byte place together (high ones are mostly 0)."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _pack(steps.view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(body: bytes, n: int) -> np.ndarray:
    places = _unpack(body, 8 * n, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(places.T).view("<u8").reshape(n).astype(np.uint64), dtype=np.uint64)


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0 by Stirling's series after shifting x by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence of n0 zeros and n1 ones."""
    return _ln_gamma(n0 + 0.5) + _ln_gamma(n1 + 0.5) - _ln_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """All nodes of one depth: tables of (context, byte) counts and, by decision, the nodes' counts and weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys  # context << 8 | byte, sorted
        self.byte = (keys & np.uint64(0xFF)).astype(np.int64)
        self.nodes, self.run, self.n, self.weight, self.stop = [], [], [], [], []
        for i in range(8):
            node = keys >> np.uint64(8 - i)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
            run = np.cumsum(np.r_[False, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
            bit = (self.byte >> (7 - i)) & 1
            ones = np.bincount(run, counts * bit, len(first))
            both = np.bincount(run, counts, len(first))
            self.nodes.append(node[first])
            self.run.append(run)
            self.n.append((both - ones, ones))

    def weigh(self, below: "Level | None") -> None:
        """Node weights ln Pw and posteriors of stopping, from the children's."""
        for i in range(8):
            n0, n1 = self.n[i]
            own = kt_block(n0, n1)
            if below is None:
                self.weight.append(own)
                self.stop.append(np.ones(len(own)))
                continue
            child = below.nodes[i]
            low = child & np.uint64((1 << i) - 1)
            parent = (child >> np.uint64(i + 8) << np.uint64(i)) | low
            rest = np.bincount(np.searchsorted(self.nodes[i], parent), below.weight[i], len(own))
            self._mixed(own, rest)

    def _mixed(self, own: np.ndarray, rest: np.ndarray) -> None:
        weight = np.log(0.5) + np.logaddexp(own, rest)
        self.weight.append(weight)
        self.stop.append(np.exp(np.log(0.5) + own - weight))

    def predict(self, i: int, at: np.ndarray, deeper: np.ndarray | None, deeper_seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of decision i of the entries at rows ``at``, and whether their node was seen in training."""
        run = self.run[i][at]
        n0, n1 = self.n[i][0][run], self.n[i][1][run]
        bit = (self.byte[at] >> (7 - i)) & 1
        own = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0)
        if deeper is not None:
            stop = self.stop[i][run]
            own = np.where(deeper_seen, stop * own + (1 - stop) * deeper, own)
        return own, n0 + n1 > 0


def _levels(keys: np.ndarray, counts: np.ndarray, least: int, weigh: bool = True) -> dict[int, Level]:
    """Levels from DEPTH up to depth ``least`` of the subtrees whose pairs these are."""
    tables = {DEPTH: (keys, counts)}
    for d in range(DEPTH - 1, least - 1, -1):
        k, c = tables[d + 1]
        byte = k & np.uint64(0xFF)
        tables[d] = _summed([((k >> np.uint64(16) << np.uint64(8)) | byte, c)])
    levels: dict[int, Level] = {}
    for d in range(DEPTH, least - 1, -1):
        levels[d] = Level(*tables[d])
        levels[d].weigh(levels.get(d + 1))
    return levels


class TopTree:
    """The levels above TOP as dense tables [decision prefix] and [nearest byte, decision prefix]."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, rest: np.ndarray):
        # level 1: contexts of one byte; level 0: no context
        self.n = [(n0.sum(0), n1.sum(0)), (n0, n1)]
        own1 = kt_block(n0, n1)
        weight1 = np.log(0.5) + np.logaddexp(own1, rest)
        own0 = kt_block(*self.n[0])
        weight0 = np.log(0.5) + np.logaddexp(own0, weight1.sum(0))
        self.stop = [np.exp(np.log(0.5) + own0 - weight0), np.exp(np.log(0.5) + own1 - weight1)]

    def predict(self, near: np.ndarray, prefix: np.ndarray, bit: np.ndarray, deeper: np.ndarray, seen: np.ndarray) -> np.ndarray:
        for d, at in ((1, (near, prefix)), (0, (prefix,))):
            n0, n1, stop = self.n[d][0][at], self.n[d][1][at], self.stop[d][at]
            own = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0)
            deeper = np.where(seen, stop * own + (1 - stop) * deeper, own)
            seen = n0 + n1 > 0
        return deeper


def log_probabilities(keys: np.ndarray, levels: dict[int, Level], top: TopTree) -> np.ndarray:
    """log10 probability of each pair's byte after its context."""
    out = np.zeros(len(keys))
    byte = (keys & np.uint64(0xFF)).astype(np.int64)
    near = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
    rows = {d: np.searchsorted(levels[d].keys, (keys >> np.uint64(8 * (DEPTH + 1 - d)) << np.uint64(8)) | byte.astype(np.uint64)) for d in levels}
    for i in range(8):
        p, seen = None, None
        for d in range(DEPTH, TOP - 1, -1):
            p, seen = levels[d].predict(i, rows[d], p, seen)
        prefix, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
        out += np.log10(top.predict(near, prefix, bit, p, seen))
    return out


def _gather(docs: DataFrame, parts: int) -> DataFrame:
    """One pass over the texts, written by row_kind: 'text' rows (block, id, held, text) and 'count' rows (block, kind,
    part, n, keys, counts) with the block's sorted keys and their counts in training texts."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("row_kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("id", id_type),
                           T.StructField("held", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("kind", T.IntegerType()),
                           T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("keys", T.BinaryType()),
                           T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        tables: tuple[list, list] = ([], [])
        arrow_id = None
        for whole in batches:
            arrow_id = whole.schema.field(0).type
            text_type = whole.schema.field(2).type
            for first, data, offsets in slices(whole.column(2), SLICE_BYTES):
                for a in range(0, len(offsets) - 1, SLICE_ROWS):
                    own = offsets[a:a + SLICE_ROWS + 1]
                    n = len(own) - 1
                    held = whole.column(1).slice(first + a, n).to_numpy(zero_copy_only=False)
                    for table, keys, rows in zip(tables, *_slice_keys(data[own[0]:own[-1]], own - own[0])):
                        train = ~held[rows]
                        k, c = _tallied(keys[train])
                        unseen = _tallied(keys[~train])[0]
                        table.append(_summed([(k, c), (unseen, np.zeros(len(unseen), np.int64))]))
                    rows = whole.slice(first + a, n)
                    yield _rows(schema, n, arrow_id, text_type, row_kind=pa.array(["text"] * n), block=pa.array(np.full(n, block)), id=rows.column(0), held=rows.column(1), text=rows.column(2))
                    size += int(own[-1] - own[0])
                    if len(tables[0]) >= 8:
                        tables = tuple([_summed(t)] for t in tables)
                    if size >= BLOCK_BYTES:
                        yield from counted(block, tables, arrow_id, text_type)
                        block, size, tables = block + 1, 0, ([], [])
        if tables[0]:
            yield from counted(block, tables, arrow_id, text_type)

    def counted(block: int, tables, arrow_id, text_type) -> Iterator[pa.RecordBatch]:
        for kind, table in enumerate(tables):
            keys, counts = _summed(table)
            part = part_of(keys, kind, parts)
            order = np.argsort(part.astype(np.uint16), kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            some = [p for p in range(parts) if bounds[p + 1] > bounds[p]]
            own = [order[bounds[p]:bounds[p + 1]] for p in some]
            m = len(some)
            if m:
                yield _rows(schema, m, arrow_id, text_type, row_kind=pa.array(["count"] * m), block=pa.array(np.full(m, block)), kind=pa.array([kind] * m, pa.int32()),
                            part=pa.array(some, pa.int32()), n=pa.array([len(x) for x in own], pa.int64()),
                            keys=pa.array([_pack_keys(keys[x]) for x in own], pa.binary()), counts=pa.array([_pack(counts[x]) for x in own], pa.binary()))

    return map_arrow(docs.select("id", "held", "text"), run, schema)


def _rows(schema: T.StructType, size: int, arrow_id, text_type, **columns) -> pa.RecordBatch:
    kinds = {"row_kind": pa.string(), "block": pa.int64(), "id": arrow_id, "held": pa.bool_(), "text": text_type, "kind": pa.int32(), "part": pa.int32(), "n": pa.int64(),
             "keys": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kinds[c]) for c in schema.fieldNames()], names=schema.fieldNames())


def _slice_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Keys and rows of a slice's pairs and words, as (keys, keys), (rows, rows)."""
    data = lower(data)
    grams, gram_rows, _ = stream(data, offsets)
    s, e, word_rows = word_bounds(data, offsets)
    return (grams, Hasher(data)(s, e)), (gram_rows, word_rows)


def _part_table(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n = table.column("n").to_pylist()
    return ([_unpack_keys(b, k) for b, k in zip(table.column("keys").to_pylist(), n)],
            [_unpack(b, k, np.int64) for b, k in zip(table.column("counts").to_pylist(), n)])


def _by_range(tables: DataFrame, run, schema: str) -> DataFrame:
    """A map over tables that are one for each range, dealt by range."""
    return map_arrow(tables.repartition(shuffle_partitions(tables.sparkSession), "kind", "part"), run, schema)


def _merged(counts: DataFrame) -> DataFrame:
    """(kind, part, n, keys, counts, moved): one table for each range, with the keys its blocks hold in all.

    Blocks are merged in groups of at most GROUP_KEYS keys, or of about FAN tables where these are large, and
    the groups again, until each range has one table: a task's load doesn't grow with the number of blocks.
    """
    def merge(table: pa.Table) -> pa.Table:
        keys, n = _summed(list(zip(*_part_table(table))))
        return pa.table({"kind": table.column("kind")[:1], "part": table.column("part")[:1], "place": table.column("place")[:1], "n": pa.array([len(keys)], pa.int64()),
                         "keys": pa.array([_pack_keys(keys)], pa.binary()), "counts": pa.array([_pack(n)], pa.binary()), "moved": pa.array([sum(table.column("moved").to_pylist())], pa.int64())})

    spark = counts.sparkSession
    current = counts.select("kind", "part", F.xxhash64("block").alias("place"), "n", "keys", "counts", F.col("n").alias("moved"))
    while True:
        groups = F.least(F.ceil(F.sum("n") / GROUP_KEYS), F.ceil(F.count("*") / FAN)).cast("long")
        sizes = current.groupBy("kind", "part").agg(F.greatest(groups, F.lit(1)).alias("groups")).toArrow()  # a row for each range
        rounds = spark.createDataFrame(sizes, "kind int, part int, groups long")
        dealt = current.join(F.broadcast(rounds), ["kind", "part"]).withColumn("place", F.pmod("place", "groups"))
        dealt = dealt.select(*current.columns).repartition(shuffle_partitions(spark), "kind", "part", "place")
        current = materialize(dealt.groupBy("kind", "part", "place").applyInArrow(merge, "kind int, part int, place long, n long, keys binary, counts binary, moved long"), "lm-merged")
        if not sizes.num_rows or max(sizes.column("groups").to_pylist()) == 1:
            return current.drop("place")


def _top_tree(merged: DataFrame) -> TopTree:
    """Sums of the subtrees under each nearest byte: 65,280 rows at most."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _tables(batches):
            level = _levels(keys, n, TOP)[TOP]
            near, prefix, values = [], [], [[], [], []]
            for i in range(8):
                node = level.nodes[i]
                near.append((node >> np.uint64(8 + i)).astype(np.int64) & 0xFF)
                prefix.append((1 << i) | (node & np.uint64((1 << i) - 1)).astype(np.int64))
                for v, x in zip(values, (*level.n[i], level.weight[i])):
                    v.append(x)
            at = np.concatenate(near) << 8 | np.concatenate(prefix)
            out = [np.bincount(at, np.concatenate(v), 1 << 16) for v in values]
            some = np.flatnonzero(np.bincount(at, minlength=1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(x[some]) for x in out]], names=["at", "n0", "n1", "rest"])

    rows = (_by_range(merged.where(F.col("kind") == GRAMS).select("kind", "part", "n", "keys", "counts"), sums, "at long, n0 double, n1 double, rest double")
            .groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("rest").alias("rest")).toArrow())
    dense = [np.zeros(1 << 16) for _ in range(3)]
    for d, c in zip(dense, ("n0", "n1", "rest")):
        d[rows.column("at").to_numpy()] = rows.column(c).to_numpy()
    return TopTree(*[d.reshape(256, 256) for d in dense])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys, n = _part_table(pa.Table.from_batches([batch.slice(i, 1)]))
            yield keys[0], n[0]


def _model(merged: DataFrame, top: TopTree) -> DataFrame:
    """(kind, part, n, keys, values, moved, types, tokens): the log probability of every pair, the count of every word."""
    shared = merged.sparkSession.sparkContext.broadcast(top)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, n = next(_tables([row]))
                values = log_probabilities(keys, _levels(keys, n, TOP), shared.value).astype(np.float32) if row.column("kind")[0].as_py() == GRAMS else n
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("kind", "part", "n", "keys")], pa.array([_pack(values)], pa.binary()), row.column("moved"),
                                                  pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                                                 names=["kind", "part", "n", "keys", "values", "moved", "types", "tokens"])

    return _by_range(merged, value, "kind int, part int, n long, keys binary, values binary, moved long, types long, tokens long")


def _valued(counts: DataFrame, model: DataFrame) -> DataFrame:
    """(block, kind, part, values): the model's values of a block's keys, in the order of the keys.

    A range's table goes to as many places as its blocks hold so many keys as the table (GROUP_KEYS at
    least), so that no place looks up for all blocks and the tables sent stay below the keys of the blocks.
    """
    spark = counts.sparkSession
    places = F.greatest(F.ceil(F.col("moved") / F.greatest(F.col("n"), F.lit(GROUP_KEYS))), F.lit(1)).cast("int")
    sizes = spark.createDataFrame(model.select("kind", "part", places.alias("places")).toArrow(), "kind int, part int, places int")  # a row for each range
    tables = (model.join(F.broadcast(sizes), ["kind", "part"]).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
              .select("kind", "part", "place", F.lit(None).cast("long").alias("block"), "n", "keys", "values"))
    blocks = (counts.join(F.broadcast(sizes), ["kind", "part"]).withColumn("place", F.pmod(F.xxhash64("block"), F.col("places")).cast("int"))
              .select("kind", "part", "place", "block", "n", "keys", F.lit(None).cast("binary").alias("values")))
    both = tables.unionByName(blocks).repartition(shuffle_partitions(spark), "kind", "part", "place").sortWithinPartitions("kind", "part", "place", F.col("block").asc_nulls_first())

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = None
        for batch in batches:
            for i in range(batch.num_rows):
                kind, n = batch.column(0)[i].as_py(), batch.column(4)[i].as_py()
                own = _unpack_keys(batch.column(5)[i].as_py(), n)
                if not batch.column(3)[i].is_valid:
                    keys, values = own, _unpack(batch.column(6)[i].as_py(), n, np.float32 if kind == GRAMS else np.int64)
                    continue
                found = _pack(values[np.searchsorted(keys, own)])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, 1) for c in (3, 0, 1)] + [pa.array([found], pa.binary())], names=["block", "kind", "part", "values"])

    return map_arrow(both, look_up, "block long, kind int, part int, values binary")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """One row per row of ``docs``: its id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows with ``held_out`` true (default: crc32 of the id as text is 0 modulo 10; a null id is held
    out) aren't learnt from. Tokens are lower-cased words and one end; base_score is the unigram
    score, score the log10 probability of the text's bytes, bits_per_byte its code length. A null or
    empty text is the end alone. Repeated rows are learnt from and scored one by one. With no training
    rows every decision has probability 1/2. Other columns are not read.
    """
    spark = docs.sparkSession
    n_parts = shuffle_partitions(spark)
    parts = 1 << min(12, max(5, (n_parts - 1).bit_length()))
    held = fold(F.col(id_col), 10) == 0 if held_out is None else held_out
    source = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gathered = materialize(_gather(source, parts), "lm")
    texts = gathered.where("row_kind = 'text'").select("block", "id", "held", "text")
    counts = gathered.where("row_kind = 'count'").select("block", "kind", "part", "n", "keys", "counts")
    merged = _merged(counts)
    model = materialize(_model(merged, _top_tree(merged)), "lm-model")
    valued = materialize(_valued(counts, model), "lm-values")
    found = model.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).head()
    ends = texts.where("not held").count()
    n_types, n_train = int(found[0]) + (ends > 0), int(found[1]) + ends

    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("id", docs.schema[id_col].dataType), ("held", "boolean"), ("text", "string"))]
    rows = (valued.select("block", "kind", "part", "values", *nothing)
            .unionByName(texts.select("block", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("values"), "id", "held", "text"))
            .repartition(n_parts, "block").sortWithinPartitions("block", F.col("kind").asc_nulls_last(), "part"))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held", T.BooleanType()), T.StructField("n_words", T.LongType()),
                        T.StructField("n_known", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("log_counts", T.DoubleType()),
                        T.StructField("score", T.DoubleType())])
    scored = map_arrow(rows, _score_blocks(parts, out.fieldNames()), out)
    log_total = float(np.log10(n_train + 0.1 * (n_types + 1)))
    end = float(np.log10(ends + 0.1))
    n_tokens = F.col("n_words") + 1
    return scored.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), n_tokens.alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("log_counts") + F.lit(end) - n_tokens * F.lit(log_total)).alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))


def _score_blocks(parts: int, names: list[str]):
    """Scores the texts of each block, whose values come first in its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, packed, pending, size = None, {}, [], 0
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            kinds = batch.column(1).to_pylist()
            cuts = [0, *[i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]], len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != block:
                    yield from scored(packed, pending)
                    block, packed, pending = blocks[a], {}, []
                i = a
                while i < b and kinds[i] is not None:
                    packed[kinds[i], batch.column(2)[i].as_py()] = batch.column(3)[i].as_py()
                    i += 1
                if i < b:
                    pending.append(batch.slice(i, b - i))
        yield from scored(packed, pending)

    def scored(packed: dict, pending: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's keys are found anew, in the order in which their values were packed."""
        if not pending:
            return
        found: tuple[list, list] = ([], [])
        for batch in pending:
            for _, data, offsets in slices(batch.column(6), SLICE_BYTES):
                for table, keys in zip(found, _slice_keys(data, offsets)[0]):
                    table.append(_tallied(keys)[0])
        tables = []
        for kind, own in enumerate(found):
            keys = _tallied(np.concatenate(own))[0]
            part = part_of(keys, kind, parts)
            values = np.zeros(len(keys), np.float64)
            for p in range(parts):
                at = np.flatnonzero(part == p)
                if len(at):
                    values[at] = _unpack(packed[kind, p], len(at), np.float32 if kind == GRAMS else np.int64)
            tables.append((keys, values))
        for batch in pending:
            for first, data, offsets in slices(batch.column(6), SLICE_BYTES):
                n = len(offsets) - 1
                (grams, words), (gram_rows, word_rows) = _slice_keys(data, offsets)
                counts = tables[WORDS][1][np.searchsorted(tables[WORDS][0], words)]
                numbers = [np.bincount(word_rows, minlength=n), np.bincount(word_rows, counts > 0, n).astype(np.int64), np.bincount(gram_rows, minlength=n),
                           np.bincount(word_rows, np.log10(counts + 0.1), n).astype(np.float64), _row_sums(grams, gram_rows, n, *tables[GRAMS])]
                own = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([own.column(4), own.column(5), *map(pa.array, numbers)], names=names)

    return run


def _row_sums(keys: np.ndarray, rows: np.ndarray, n: int, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum over each row of its keys' values. Rows are sorted with the keys, so that lookups go through the table in order."""
    out = np.zeros(n)
    room = 64 - 8 * (DEPTH + 1)
    if not room:  # no room for the row beside the key
        order = np.argsort(keys)
        return np.bincount(rows[order], values[np.searchsorted(table, keys[order])], n)
    shift, most = np.uint64(room), 1 << room
    for a in range(0, n, most):
        x, y = np.searchsorted(rows, [a, a + most])
        both = np.sort(keys[x:y] << shift | (rows[x:y] - a).astype(np.uint64))
        k = both >> shift
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        each = np.repeat(values[np.searchsorted(table, k[first])], np.diff(np.r_[first, len(k)]))
        out[a:a + most] += np.bincount((both & np.uint64(most - 1)).astype(np.int64), each, min(n - a, most))
    return out
