import math

import numpy as np
import pytest

from storecast.llm import embeddings


def brute(rows, threshold):
    def fine(label, v):
        return label is not None and v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v)
    n = len(rows)
    ok = [fine(r[2], r[1]) for r in rows]
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if embeddings.exact_cosine(x, y) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            stack, seen = [i], {i}
            while stack:
                for y in near[stack.pop()]:
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
            ids = [rows[x][0] for x in seen if rows[x][0] is not None]
            for x in seen:
                comp[x] = (min(ids) if ids else None,)
    return sorted((str(rows[i][0]), len(near[i]), str(comp[i][0]), comp[i][0] == rows[i][0]) for i in range(n))


def data():
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, 2, None):
        for _ in range(12):
            base = rng.normal(size=8)
            for _ in range(rng.integers(1, 9)):
                v = (base + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.25, 0.4])).astype(np.float32)
                rows.append((k, [float(x) for x in v], label))
                k += 1
    rows += [(k + i, rows[5][1], 0) for i in range(20)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] + [1.0] * 7, 1), (904, [float("inf")] + [1.0] * 7, 1),
             (905, [None] + [1.0] * 7, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, rows[0][1], None), (None, rows[0][1], 0),
             (None, [9.0, -9.0], 2), (3, rows[3][1], 0), (909, [1e-30] * 8, 2), (910, [1e30] * 8, 2)]
    return rows


@pytest.mark.parametrize("cell,block,threshold", [(2048, 1024, 0.93), (10, 1024, 0.93), (6, 5, 0.93), (6, 5, 0.8), (20, 7, 0.999)])
def test_equals_brute_force(spark, monkeypatch, cell, block, threshold):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = data()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(3)
    got = embeddings.near_duplicate_vectors(df, threshold=threshold).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows, threshold)


def test_empty(spark):
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
