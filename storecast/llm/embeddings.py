"""Near-duplicate vectors by an exact metric range join.

On unit vectors cosine >= c means a Euclidean distance of at most r = sqrt(2 - 2c). Pivots cut each
label's vectors into cells (every vector's home is its nearest pivot). The triangle inequality tells
which other cells may hold a vector within r: only those get a copy. Every home vector then finds all
its links inside its own cell, so cells join independently, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.llm.common import map_arrow, materialize, shuffle_partitions
from storecast.llm.components import components

THRESHOLD = 0.93
#: One pivot for so many distinct vectors, and so many pivots at most (they go to every task).
CELL, MAX_PIVOTS = 2048, 1024
#: Vectors on each side of one block.
BLOCK = 1024
#: Rounding slack of the distance bounds, and the band around the threshold that is computed exactly.
SLACK, EXACT_BAND = 1e-9, 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine with exactly rounded sums (products of single-precision components are exact)."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: cosine of row i of x and row j of y is at least ``threshold``."""
    cos = _unit(x) @ _unit(y).T
    out = cos >= threshold
    for i, j in zip(*np.nonzero(np.abs(cos - threshold) < EXACT_BAND)):
        out[i, j] = exact_cosine(x[i], y[j]) >= threshold
    return out


def _cells(nodes: DataFrame, threshold: float) -> DataFrame:
    """(group, cell, home, node, copies, vector): every node in its home cell, and in each cell that may hold a neighbour."""
    n = nodes.count()
    wanted = min(MAX_PIVOTS, n // CELL)
    chosen = nodes.orderBy("node").limit(wanted).select("group", "vector").toArrow() if wanted else None
    pivots: dict[str, np.ndarray] = {}
    if chosen is not None and chosen.num_rows:
        groups = chosen.column("group").to_pylist()
        vectors = chosen.column("vector").combine_chunks()
        for g in set(groups):
            pivots[g] = _unit(_matrix(vectors.take(pa.array([i for i, x in enumerate(groups) if x == g]))))
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            for g in dict.fromkeys(group.tolist()):
                rows = np.flatnonzero(group == g)
                own = batch.take(pa.array(rows))
                if g not in pivots:
                    cells, at, home = np.zeros(len(rows), np.int64), np.arange(len(rows)), np.ones(len(rows), bool)
                else:
                    p = pivots[g]
                    x = _unit(_matrix(own.column(3)))
                    d = np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))
                    nearest = d.argmin(1)
                    least = d[np.arange(len(x)), nearest][:, None]
                    between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[nearest]
                    # y of cell q within r of x: d(x, q) <= d(x, p) + 2r, and x lies within r of the border between p and q
                    near = d <= least + 2 * radius + SLACK
                    near &= d * d - least * least <= 2 * radius * between + 4 * SLACK
                    near[np.arange(len(x)), nearest] = True
                    at, cells = np.nonzero(near)
                    home = cells == nearest[at]
                moved = own.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([moved.column(0), pa.array(cells.astype(np.int32)), pa.array(home), *moved.columns[1:]],
                                                 names=["group", "cell", "home", "node", "copies", "vector"])

    return map_arrow(nodes.select("group", "node", "copies", "vector"), 
        place, f"group string, cell int, home boolean, node long, copies long, vector {nodes.schema['vector'].dataType.simpleString()}")


_KEY = ("group", "cell", "i", "j")


def _block_links(cells: DataFrame, threshold: float) -> DataFrame:
    """(node, links, joined): links of home nodes found in each block, and a node each node is joined with."""
    parts = shuffle_partitions(cells.sparkSession)
    sizes = cells.groupBy("group", "cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("ni"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nj"))
    sized = cells.join(sizes.where("ni > 0"), ["group", "cell"])
    chunk = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    columns = [*_KEY, "left", "node", "copies", "vector"]
    left = sized.where("home").withColumn("i", chunk(F.col("ni"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("left", F.lit(True))
    right = sized.withColumn("j", chunk(F.col("nj"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("left", F.lit(False))
    blocks = left.select(columns).unionByName(right.select(columns)).repartition(parts, *_KEY).sortWithinPartitions(*_KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            changes = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for x, y in zip(changes, changes[1:]):
                if x < y:
                    if keys[x] != key and group:
                        yield _join_block(group, threshold)
                        group = []
                    key = keys[x]
                    group.append(batch.slice(x, y - x))
        if group:
            yield _join_block(group, threshold)

    return map_arrow(blocks, run, "node long, links long, joined long")


def _join_block(group: list[pa.RecordBatch], threshold: float) -> pa.RecordBatch:
    table = pa.Table.from_batches(group).combine_chunks()
    side = table.column("left").to_numpy()
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    vectors = _matrix(table.column("vector").combine_chunks())
    a, b = node[side], node[~side]
    near = linked(vectors[side], vectors[~side], threshold) & (a[:, None] != b[None, :])
    links = near @ copies[~side]
    some_a, some_b = near.any(1), near.any(0)
    a_label, b_label = a.copy(), b.copy()
    rows, columns = np.nonzero(near)  # within one block
    while len(rows):
        before = a_label.sum(dtype=object), b_label.sum(dtype=object)
        np.minimum.at(a_label, rows, b_label[columns])
        np.minimum.at(b_label, columns, a_label[rows])
        if before == (a_label.sum(dtype=object), b_label.sum(dtype=object)):
            break
    moved = b_label != b
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[a[some_a], b[some_b & moved]]), pa.array(np.r_[links[some_a], np.zeros((some_b & moved).sum(), np.int64)].astype(np.int64)),
         pa.array(np.r_[a_label[some_a], b_label[some_b & moved]])], names=["node", "links", "joined"])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                           threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links``, ``component_id`` and ``kept`` (id = component_id).

    Rows are linked when their labels are equal and their cosine, in double precision, is at least
    ``threshold`` (0 < threshold <= 1). n_links counts the other rows linked directly; component_id is
    the least id reachable by links, the own one included. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without a label, link with nothing; nor do vectors of
    different lengths. Equal vectors are one node, so copies are counted and not paired. A null id
    never becomes a component id unless it stands alone; repeated rows are separate rows. Other
    columns are not read.
    """
    v = F.col(vector_col)
    fine = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        F.col(id_col).alias("id"), F.when(fine, F.xxhash64(F.lit(1), F.col(label_col), v)).alias("node"),
        F.concat_ws(":", F.col(label_col).cast("string"), F.size(v).cast("string")).alias("group"), F.when(fine, v).alias("vector"))
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(
        F.first("group").alias("group"), F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector")), "vectors")
    found = materialize(_block_links(materialize(_cells(nodes, threshold), "cells"), threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("joined").alias("b")))
    labelled = nodes.select("node", "copies", "least").join(links, "node", "left").join(comps, "node", "left")
    labelled = labelled.select("node", F.coalesce("component", "node").alias("component"), "least",
                               (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    labelled = materialize(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = labelled.join(least, "component").select("node", "n_links", "component_id")
    out = rows.select("id", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
