"""Counts of 64-bit hashes over a whole table, moved as packed blocks.

Tasks count in numpy and send, for each of ``parts`` ranges of the hash, one row with the sorted
hashes and their counts as bytes. A range is then summed by whichever task gets its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: A task merges what it has counted from so many entries on.
MERGE = 1_000_000

SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def parts_for(shuffle_partitions: int) -> int:
    """A power of two near the number of shuffle partitions, from 32 to 4096."""
    return 1 << min(12, max(5, (shuffle_partitions - 1).bit_length()))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def blocks(keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each range of the hash that has keys."""
    bits = np.uint64(64 - (parts.bit_length() - 1))
    edges = np.searchsorted(keys, np.arange(1, parts, dtype=np.uint64) << bits)
    bounds = [0, *edges.tolist(), len(keys)]
    rows = [(p, keys[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes()) for p, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                                      names=SCHEMA.fieldNames())


def count_in_task(batches: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of what one task has counted; ``batches`` gives keys and counts, in any order, repeats allowed."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size, least = 0, MERGE
    for k, c in batches:
        keys.append(k)
        counts.append(c)
        size += len(k)
        if size >= least:
            k, c = merged(keys, counts)
            keys, counts, size = [k], [c], len(k)
            if size > MERGE:
                yield blocks(k, c, parts)
                keys, counts, size = [], [], 0
            least = max(MERGE, 2 * size)
    k, c = merged(keys, counts)
    if len(k):
        yield blocks(k, c, parts)


def read_blocks(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return ([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()],
            [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
