"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

A document is its set of five-word shingles (lower-cased words), each weighted by its count in the
document times the mean inverse document frequency of its words. Consistent samples of the weighted
set agree between two documents with the probability of their weighted Jaccard similarity; bands of
samples propose pairs, and the exact weighted Jaccard similarity of the whole texts decides.

Exact copies are one node. Pairs are not all spelled out: each node is first held against the best
matching of its buckets' hubs (the least node of each bucket); only nodes of a bucket that are then
still in different components are compared further. Every pair of a bucket that could still join two
components is thereby decided exactly, if its samples agree as pairs of the threshold do (see
``LEAST_AGREEMENT``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import counting
from storecast.llm.common import join_counted, map_arrow, materialize, shuffle_partitions
from storecast.llm.components import components
from storecast.llm.tokens import Hasher, lower, mix, shingles, slices, word_bounds

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Pairs whose samples agree less often are not verified: at similarity 0.8 the share that agrees is
#: 0.8 with a standard deviation of 0.058, so this lies four deviations below.
LEAST_AGREEMENT = 0.57
#: Words in more than 1 / COMMON of the documents have an IDF of their own, at most MAX_TERMS words;
#: all rarer words share the largest. The table is small whatever the corpus: the sum of the document
#: frequencies is the number of different words of an average document times the documents.
COMMON, MAX_TERMS = 1000, 200_000
#: Rows of one block of a bucket in pairwise comparison, and pairs verified against one hub by one task.
BLOCK, HUB_CHUNK = 512, 256
SLICE_BYTES = 512 << 10


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal shares."""
    x = np.concatenate([np.geomspace(1e-5, 1, 60_000), np.linspace(1, 25, 60_000)[1:]])
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x)


_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        gamma = _gamma_quantiles()
        _tables["r"] = gamma.astype(np.float32)
        _tables["ln_c"] = np.log(gamma).astype(np.float32)
    return _tables[name]


def samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """ICWS of weighted sets that lie one after another from ``starts`` on: (sets, SAMPLES) 32-bit sample ids.

    For each sample, element x of weight w has Gamma(2, 1) variates r, c and a uniform beta, all from
    a hash of x; t = floor(ln w / r + beta), y = exp(r (t - beta)), a = c / (y exp(r)). The element of
    least a is drawn; its id is a hash of x and t.
    """
    out = np.zeros((len(starts), SAMPLES), np.uint32)
    first = 0
    while first < len(starts):  # sets of some thousand elements at a time stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + 16_000)) - 1)
        end = int(starts[last]) if last < len(starts) else len(keys)
        span = slice(int(starts[first]), end)
        out[first:last] = _samples(keys[span], weights[span], starts[first:last] - starts[first])
        first = last
    return out


def _samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    r_table, c_table = _table("r"), _table("ln_c")
    log_w = np.log(weights).astype(np.float32)
    n = len(keys)
    out = np.zeros((len(starts), SAMPLES), np.uint32)
    h, shifted, packed = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty((n, 2), np.uint32)
    for k in range(SAMPLES):
        np.multiply(keys, np.uint64(2 * k + 0x9E3779B97F4A7C15), out=h)
        h += np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        h ^= np.right_shift(h, np.uint64(29), out=shifted)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= np.right_shift(h, np.uint64(32), out=shifted)
        quarters = h.view(np.uint16).reshape(n, 4)
        r, beta = r_table.take(quarters[:, 0]), quarters[:, 3] * np.float32(1 / 65536)
        t = np.floor(log_w / r + beta)
        ln_a = c_table.take(quarters[:, 1]) - r * (t - beta + np.float32(1))
        bits = ln_a.view(np.int32)
        packed[:, 1] = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.uint32) ^ np.uint32(0x80000000)  # order of the floats
        packed[:, 0] = quarters.view(np.uint32)[:, 0] * np.uint32(0x94D049BB) + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        out[:, k] = (np.minimum.reduceat(packed.view(np.uint64)[:, 0], starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


class Idf:
    """Inverse document frequency of word hashes: ln(1 + N / max(df, floor)), the largest for words not listed."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n_docs: int, floor: int):
        self.keys = keys
        self.values = np.log1p(n_docs / np.maximum(df, floor))
        self.rare = float(np.log1p(max(n_docs, 1) / floor))

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(words), self.rare)
        at = np.searchsorted(self.keys, words)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == words, self.values[at], self.rare)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lower(data)
    s, e, rows = word_bounds(data, offsets)
    return Hasher(data)(s, e), rows


def weighted_shingles(column: pa.Array, idf: Idf, size: int = SHINGLE, most: int = SLICE_BYTES
                      ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, shingle, weight) by slices: distinct shingles of each text, by row and hash (48 bits).

    A text of fewer words than ``size`` has one shingle of all its words; one without words has none.
    """
    for first, data, offsets in slices(column, most):
        words, rows = _word_hashes(data, offsets)
        n = len(offsets) - 1
        hashes, owner = shingles(words, rows, n, size)
        if not len(hashes):
            yield first, n, owner, hashes, np.zeros(0)
            continue
        sums = np.r_[0.0, np.cumsum(idf(words))]
        counts = np.bincount(rows, minlength=n)
        begins = np.cumsum(counts) - counts
        per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        at = begins[owner] + nth
        length = np.minimum(counts[owner], size)
        mean = (sums[at + length] - sums[at]) / length
        packed = (owner.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
        if n < 1 << 16:
            order = np.argsort(packed)
            packed, owner = packed[order], owner[order]
        else:
            order = np.lexsort((hashes, owner))
            packed, owner = (hashes >> np.uint64(16))[order], owner[order]
        new = np.flatnonzero(np.r_[True, (packed[1:] != packed[:-1]) | (owner[1:] != owner[:-1])])
        tf = np.diff(np.r_[new, len(packed)])
        yield first, n, owner[new], packed[new] & np.uint64((1 << 48) - 1), tf * np.round(mean[order][new], 6)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted keys, weights): sum of lesser over sum of greater weights."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    both = kb[at] == ka
    least = np.minimum(wa[both], wb[at[both]]).sum()
    return float(least / (wa.sum() + wb.sum() - least))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> Idf:
    """IDF of the common words from all documents: only words above the documented share reach the driver."""
    spark = docs.sparkSession
    parts = counting.parts_for(shuffle_partitions(spark))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def words() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for _, data, offsets in slices(batch.column(0)):
                    h, rows = _word_hashes(data, offsets)
                    order = np.argsort(h, kind="stable")  # equal words stay in order of their rows
                    h, rows = h[order], rows[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])] if len(h) else np.zeros(0, bool)
                    h = h[new]
                    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                    yield h[first], np.diff(np.r_[first, len(h)])
        yield from counting.count_in_task(words(), parts)

    n_docs = docs.count()
    floor = max(1, n_docs // COMMON)

    def total(table: pa.Table) -> pa.Table:
        k, c = counting.merged(*counting.read_blocks(table))
        common = c > floor
        return pa.table({"word": pa.array(k[common].view(np.int64)), "df": pa.array(c[common])})

    counted = map_arrow(docs.select(text_col), count, counting.SCHEMA).groupBy("part").applyInArrow(total, "word long, df long")
    listed = counted.orderBy(F.desc("df"), "word").limit(MAX_TERMS).toArrow()
    words, df = listed.column("word").to_numpy().view(np.uint64), listed.column("df").to_numpy()
    if len(words) == MAX_TERMS:
        floor = max(floor, int(df.min()))
    order = np.argsort(words)
    return Idf(words[order], df[order], n_docs, floor)


def signatures(docs: DataFrame, idf: Idf, id_col: str, text_col: str) -> DataFrame:
    """(id, uid, node, samples, bands) of each row. node: hash of the text, null without words; uid numbers the rows."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("uid", T.LongType()), T.StructField("node", T.LongType()),
                           T.StructField("samples", T.ArrayType(T.IntegerType())), T.StructField("bands", T.ArrayType(T.LongType()))])
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            drawn = np.zeros((n, SAMPLES), np.uint32)
            some = np.zeros(n, bool)
            for first, _, owner, keys, weights in weighted_shingles(batch.column(1), shared.value):
                if len(owner):
                    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    drawn[first + owner[starts]] = samples(keys, weights, starts)
                    some[first + owner[starts]] = True
            folded = _fold_bands(drawn)
            without = pa.array(~some)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.arange(uid, uid + n)),
                pa.array(batch.column(2).to_numpy(zero_copy_only=False), pa.int64(), mask=~some),
                _lists(drawn.view(np.int32), without), _lists(folded.view(np.int64), without)], names=schema.fieldNames())
            uid += n

    return map_arrow(docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__node")), run, schema)


def _lists(values: np.ndarray, without: pa.Array) -> pa.Array:
    n, width = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)[:n + 1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))


def _agreement(a: str, b: str):
    """Share of the samples that two sample arrays have in common."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SAMPLES))


def verify(pairs: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Exact similarity of ``pairs`` (a, b): (a, b, similar). ``texts``: (node, text), one row per node.

    The texts of b go to a's text; a hub's pairs are split over chunks, each of which gets the hub's text.
    """
    parts = shuffle_partitions(pairs.sparkSession)
    hub_sizes = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")), "hubs")
    chunks = hub_sizes.withColumn("chunks", F.ceil(F.col("n") / HUB_CHUNK).cast("int"))
    sides = join_counted(pairs, chunks, ["a"], "b").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    sides = sides.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "text")
    hubs = (chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
            .join(texts.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "text"))
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for first, n, owner, keys, weights in weighted_shingles(batch.column(3), shared.value):
                bounds = np.searchsorted(owner, np.arange(n + 1))
                for i in range(n):
                    own = keys[bounds[i]:bounds[i + 1]], weights[bounds[i]:bounds[i + 1]]
                    if b[first + i] is None:
                        hub, hub_set = a[first + i], own
                    else:
                        assert hub == a[first + i]
                        out.append((hub, b[first + i], jaccard(hub_set, own) >= threshold))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))],
                                             names=["a", "b", "similar"])

    rows = hubs.unionByName(sides).repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return map_arrow(rows, run, "a long, b long, similar boolean")


def _open_buckets(members: DataFrame) -> DataFrame:
    """Of bucket members (band, value, node, comp) those in buckets of several components, with ``minor`` (not of the
    bucket's largest component) and the bucket's numbers of chunks."""
    by_comp = members.groupBy("band", "value", "comp").agg(F.count("*").alias("own"))
    buckets = by_comp.groupBy("band", "value").agg(F.count("*").alias("comps"), F.sum("own").alias("n"), F.max_by("comp", F.struct("own", "comp")).alias("main"),
                                                  F.max("own").alias("most"))
    found = join_counted(members, materialize(buckets, "buckets"), ["band", "value"], "node").where("comps > 1")
    size = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    return found.select("band", "value", "node", "comp", size(F.col("n")).alias("all_chunks"), size(F.col("n") - F.col("most")).alias("minor_chunks"),
                        (F.col("comp") != F.col("main")).alias("minor"))


def _blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (band, value, i, j, left, node, comp, samples) that put every two members of a bucket that lie in
    different components together in some block: (some members, left) x (some minor members, not left).

    No block grows with its bucket. Rows of a block lie together in one partition.
    """
    parts = shuffle_partitions(members.sparkSession)
    open_members = _open_buckets(members).join(nodes, "node")
    chunk = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    columns = [*_BLOCK_KEY, "left", "node", "comp", "samples"]
    left = (open_members.withColumn("i", chunk(F.col("all_chunks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("minor_chunks") - 1)))
            .withColumn("left", F.lit(True)).select(columns))
    right = (open_members.where("minor").withColumn("j", chunk(F.col("minor_chunks"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("all_chunks") - 1)))
             .withColumn("left", F.lit(False)).select(columns))
    return left.unionByName(right).repartition(parts, *_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)


_BLOCK_KEY = ("band", "value", "i", "j")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of a partition sorted by block."""
    key, group = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
        changes = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for x, y in zip(changes, changes[1:]):
            if x == y:
                continue
            if keys[x] != key and group:
                yield pa.Table.from_batches(group).combine_chunks()
                group = []
            key = keys[x]
            group.append(batch.slice(x, y - x))
    if group:
        yield pa.Table.from_batches(group).combine_chunks()


def _fold_bands(drawn: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS samples."""
    bands = drawn.reshape(len(drawn), BANDS, ROWS).astype(np.uint64)
    folded = np.zeros((len(drawn), BANDS), np.uint64)
    for j in range(ROWS):
        folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j] + np.uint64(1))
    return folded


class _Block:
    """The two sides of one block, and which of its pairs are to be decided in it."""

    def __init__(self, table: pa.Table):
        self.side = table.column("left").to_numpy()
        self.node, self.comp = table.column("node").to_numpy(), table.column("comp").to_numpy().copy()
        self.drawn = table.column("samples").combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES)
        self.band = table.column("band")[0].as_py()
        self.folded = _fold_bands(self.drawn.view(np.uint32))[:, :self.band]
        self.left, self.right = np.flatnonzero(self.side), np.flatnonzero(~self.side)

    def rivals(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Left rows in other components that agree enough with row r and share no earlier band (else decided there)."""
        at = self.left[self.comp[self.left] != self.comp[r]]
        agree = (self.drawn[at] == self.drawn[r]).sum(1)
        near = agree >= LEAST_AGREEMENT * SAMPLES
        at, agree = at[near], agree[near]
        new = ~(self.folded[at] == self.folded[r]).any(1)
        return at[new], agree[new]


def _cross_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Links (a, b) that join different components, found by deciding every pair of a bucket that could.

    First the blocks' samples tell which members have a pair to decide, then their texts decide. A pair
    that other links of its block have joined already needs no decision, so a block yields at most as
    many links as it has rows.
    """
    spark = members.sparkSession
    blocks = materialize(_blocks(members, nodes), "blocks")
    parts = shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(idf)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            block = _Block(table)
            needed = np.zeros(len(block.side), bool)
            for r in block.right:
                at, _ = block.rivals(r)
                if len(at):
                    needed[at] = needed[r] = True
            if needed.any():
                yield from table.filter(pa.array(needed)).combine_chunks().to_batches()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            block = _Block(table)
            sets = {}
            for first, n, owner, keys, weights in weighted_shingles(table.column("text").combine_chunks(), shared.value):
                bounds = np.searchsorted(owner, np.arange(n + 1))
                sets.update((first + i, (keys[bounds[i]:bounds[i + 1]], weights[bounds[i]:bounds[i + 1]])) for i in range(n))
            found = []
            for r in block.right:
                at, agree = block.rivals(r)
                for o in at[np.argsort(-agree, kind="stable")]:
                    if block.comp[o] != block.comp[r] and jaccard(sets[r], sets[o]) >= threshold:
                        found.append((block.node[r], block.node[o]))
                        block.comp[block.comp == block.comp[o]] = block.comp[r]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sorted_blocks = lambda df: df.repartition(parts, *_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
    some = materialize(map_arrow(sorted_blocks(blocks), wanted, blocks.schema), "undecided")
    return map_arrow(sorted_blocks(some.join(texts, "node").select(*_BLOCK_KEY, "left", "node", "comp", "samples", "text")), decide, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id``, ``class_size`` (rows) and ``kept`` (true for one row of each class).

    Classes are the components of the links between texts of weighted Jaccard similarity of at least
    ``threshold``; equal texts are in one class. class_id is the least id of the class (nulls last),
    and the kept row is one of that id. A null, empty or blank text has no shingles: such a row is a
    class of its own, kept, with its own id. A null id is allowed anywhere. Repeated rows are copies
    like any others. Other columns are not read.
    """
    signed, nodes = _classes(docs, id_col, text_col, threshold)
    groups = nodes.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("size"))
    by_node = materialize(nodes.select("node", "class").join(groups, "class").select("node", "first", "size"), "by-node")
    joined = signed.select("id", "uid", "node").join(by_node, "node", "left")  # a node of many copies is a skewed key that Spark splits
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("first.uid") == F.col("uid"), F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows (node null without words), and per node its class (the least node of its component), its
    first row (least id, nulls last) and its number of rows."""
    idf = document_frequencies(docs, text_col)
    signed = materialize(signatures(docs, idf, id_col, text_col), "signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("samples").alias("samples"), F.first("bands").alias("bands"), least)
    nodes = materialize(nodes, "nodes")
    exploded = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    hubs = exploded.groupBy("band", "value").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = join_counted(exploded, materialize(hubs, "buckets"), ["band", "value"], "node")
    members = materialize(members.select("band", "value", "node", "hub"), "members")
    needed = materialize(members.select("node").distinct().join(nodes.select("node", "samples", F.col("least.id").alias("id")), "node"), "involved")
    involved = needed.select("node", "samples")

    star = members.where("node <> hub").select("node", "hub").distinct()
    star = star.join(involved, "node").withColumnRenamed("samples", "s").join(involved.withColumnRenamed("node", "hub"), "hub")
    star = star.select("node", "hub", _agreement("s", "samples").alias("agreement")).where(F.col("agreement") >= LEAST_AGREEMENT)
    star = star.groupBy("node").agg(F.max_by("hub", F.struct("agreement", "hub")).alias("a"))
    pairs = materialize(star.select("a", F.col("node").alias("b")), "pairs")

    texts = _texts(docs, needed.select("node", "id"), id_col, text_col)
    links = materialize(verify(pairs, texts, idf, threshold).where("similar").select("a", "b"), "links")
    comps = materialize(components(links), "components")
    labelled = members.select("band", "value", "node").join(comps, "node", "left").select(
        "band", "value", "node", F.coalesce("component", "node").alias("comp"))
    crossing = materialize(_cross_links(labelled, involved, texts, idf, threshold), "links")
    comps = components(links.unionByName(crossing))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid", "node")).alias("first")
    per_node = signed.where("node is not null").groupBy("node").agg(first, F.count("*").alias("n"))
    labelled = per_node.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "first", "n")
    return signed, materialize(labelled, "classes")


def _texts(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text): one text for each of ``needed`` (node, id), from the row of that id, so that copies of a text don't move."""
    own = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__node"), F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    rows = own.join(needed, (F.col("__node") == F.col("node")) & F.col("__id").eqNullSafe(F.col("id")), "left_semi")
    return materialize(rows.groupBy(F.col("__node").alias("node")).agg(F.first("text").alias("text")), "texts")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The kept rows of :func:`near_duplicates`, with all columns of ``docs``: one row of each class."""
    _, nodes = _classes(docs, id_col, text_col, threshold)
    keep = nodes.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__id"), F.col("first.node").alias("__node"))
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).alias("__own"), node.alias("__key"), F.col(text_col).alias("__text"))
    blank = rows.where(~F.coalesce(F.col("__text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("__doc")
    first_rows = (rows.join(keep, (F.col("__key") == F.col("__node")) & F.col("__own").eqNullSafe(F.col("__id")), "left_semi")
                  .groupBy("__key", "__own").agg(F.first("__doc").alias("__doc")).select("__doc"))
    return first_rows.unionByName(blank).select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
