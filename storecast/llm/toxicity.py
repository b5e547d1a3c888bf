"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed vectors: of the whole word and of its prefixes (so inflected
forms share their stem's vector). Filters of several widths slide over the words; each filter's
largest response in the whole text (max pooling) goes into a logistic layer. The model is fitted in
one task on a bounded sample of labelled rows; scoring is one pass over all texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import map_arrow

from storecast.llm.counting import merged
from storecast.llm.tokens import PUNCTUATION, Hasher, lower, mix, slices, word_bounds
from storecast.session import ship_package

#: The classifier is fitted on so many labelled documents at most (those of the smallest id hashes).
SAMPLE = 6000
#: A hashed feature gets a vector when so many documents of the sample have it.
MIN_DOCS = 8
DIM, FILTERS, WIDTHS = 8, 12, (1, 2, 3)
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, RATE = 12, 32, 0.02
SEED = 17


def word_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word rows, feature hashes (words, 1 + prefixes)) by slices; 0 is no feature."""
    for first, data, offsets in slices(column):
        data = lower(data, latin=True)
        s, e, rows = word_bounds(data, offsets, PUNCTUATION)
        h = Hasher(data)
        columns = [h(s, e)]
        for n in PREFIXES:
            longer = e - s > n
            prefix = np.zeros(len(s), np.uint64)
            prefix[longer] = mix(h(s[longer], s[longer] + n) + np.uint64(n))
            columns.append(prefix)
        yield first, len(offsets) - 1, rows, np.stack(columns, 1)


@dataclass
class Model:
    """keys: sorted feature hashes; embedding: their vectors and a zero row; one filter bank for each width."""

    keys: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def index(self, features: np.ndarray) -> np.ndarray:
        """Rows of the embedding; the zero row for unknown features."""
        if not len(self.keys):
            return np.zeros(features.shape, np.int32)
        at = np.searchsorted(self.keys, features)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == features, at, len(self.keys)).astype(np.int32)

    def pooled(self, index: np.ndarray, rows: np.ndarray, n_rows: int, where: bool = False):
        """Largest response of every filter in each row, at least 0; with ``where`` also its window's first word."""
        words = self.embedding[index[:, 0]]
        for j in range(1, index.shape[1]):
            words += self.embedding[index[:, j]]
        out = np.zeros((n_rows, FILTERS * len(WIDTHS)), np.float32)
        at = np.full(out.shape, -1, np.int64)
        for k, width in enumerate(WIDTHS):
            last = len(rows) - width + 1
            if last <= 0:
                continue
            response = words[:last] @ self.filters[k][0]
            for j in range(1, width):
                response += words[j:last + j] @ self.filters[k][j]
            whole = rows[:last] == rows[width - 1:]
            firsts = np.flatnonzero(whole)
            response, owner = response[firsts], rows[firsts]
            if not len(owner):
                continue
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            out[owner[begin], part] = np.maximum(np.maximum.reduceat(response, begin, axis=0) + self.filter_bias[k], 0)
            if where:
                for b, e in zip(begin, [*begin[1:], len(owner)]):
                    at[owner[b], part] = firsts[b + response[b:e].argmax(0)]
        return (out, at, words) if where else out

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.float64)
        for first, n, rows, features in word_features(column):
            z = self.pooled(self.index(features), rows, n).astype(np.float64) @ self.weights + self.bias
            out[first:first + n] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit(texts: list[str | None], toxic: list[int], langs: list[str | None]) -> Model:
    """Train on four fifths of the rows and calibrate a threshold for each language on the rest.

    Without rows of both labels the model scores every text 0.
    """
    rng = np.random.default_rng(SEED)
    y = np.asarray(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros((1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                     [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), -30.0)
    column = pa.array(texts, pa.large_string())
    held = np.arange(len(y)) % 5 == 4
    keys, n_docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for first, n, rows, features in word_features(column):  # twice over the texts: the features of all of them are never held
        bounds = np.searchsorted(rows, np.arange(n + 1))
        own = [np.unique(features[bounds[i]:bounds[i + 1]]) for i in range(n) if not held[first + i]]
        found, n_found = np.unique(np.concatenate([*own, keys[:0]]), return_counts=True)
        keys, n_docs = merged([keys, found], [n_docs, n_found])
    keys = keys[(n_docs >= MIN_DOCS) & (keys != 0)]
    v = len(keys)
    embedding = rng.normal(0, 0.02, (v + 1, DIM)).astype(np.float32)
    embedding[v] = 0
    filters = [rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(keys, embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0, 0.3, FILTERS * len(WIDTHS)), float(np.log(max(y.mean(), 1e-3) / (1 - min(y.mean(), 0.999)))))
    index = [np.zeros((0, 1 + len(PREFIXES)), np.int32)] * len(texts)
    for first, n, rows, features in word_features(column):
        bounds = np.searchsorted(rows, np.arange(n + 1))
        at = model.index(features)
        index[first:first + n] = [at[bounds[i]:bounds[i + 1]].copy() for i in range(n)]
    train = np.flatnonzero(~held)
    dense = [model.weights, *model.filters, *model.filter_bias]
    first_moment, second_moment = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    squares = np.full(v + 1, 1e-8, np.float32)
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for b in range(0, len(train), BATCH):
            batch = train[b:b + BATCH]
            step += 1
            _train_step(model, [index[i] for i in batch], y[batch], dense, first_moment, second_moment, squares, step)
    held_at = np.flatnonzero(held)
    scores = model.scores(pa.array([texts[i] for i in held_at], pa.large_string()))
    model.thresholds = _thresholds(scores, y[held_at], [langs[i] for i in held_at])
    return model


def _train_step(model, index, y, dense, first_moment, second_moment, squares, step) -> None:
    lengths = [len(i) for i in index]
    rows = np.repeat(np.arange(len(index)), lengths)
    flat = np.concatenate(index)
    pooled, at, words = model.pooled(flat, rows, len(index), where=True)
    z = pooled @ model.weights + model.bias
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    grad_pooled = np.where((pooled > 0) & (at >= 0), error[:, None] * model.weights[None, :], 0).astype(np.float32)
    grads = [pooled.T @ error + 1e-5 * model.weights]
    filter_grads, bias_grads = [], []
    grad_words: list[tuple[np.ndarray, np.ndarray]] = []
    for k, width in enumerate(WIDTHS):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        g, a = grad_pooled[:, part], at[:, part]
        r, f = np.nonzero(g)
        grad = np.zeros_like(model.filters[k])
        for j in range(width):
            where = a[r, f] + j
            np.add.at(grad[j].T, f, g[r, f][:, None] * words[where])
            grad_words.append((where, g[r, f][:, None] * model.filters[k][j].T[f]))
        filter_grads.append(grad)
        bias_grads.append(g.sum(0))
    grads += filter_grads + bias_grads
    for p, g, m, s in zip(dense, grads, first_moment, second_moment):
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        p -= (RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)).astype(p.dtype)
    model.bias -= 0.1 * float(error.sum())
    zero = len(model.keys)
    where = np.concatenate([w for w, _ in grad_words])
    if len(where):
        at_words, inverse = np.unique(where, return_inverse=True)
        by_word = np.zeros((len(at_words), DIM), np.float32)
        np.add.at(by_word, inverse, np.concatenate([g for _, g in grad_words]))
        features = flat[at_words]
        touched, inverse = np.unique(features, return_inverse=True)
        total = np.zeros((len(touched), DIM), np.float32)
        np.add.at(total, inverse.reshape(-1), np.repeat(by_word, features.shape[1], 0))
        total[touched == zero] = 0
        squares[touched] += (total ** 2).mean(1)
        model.embedding[touched] -= RATE * total / np.sqrt(squares[touched])[:, None]
        model.embedding[zero] = 0


def _thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """For each language with enough toxic rows the threshold of best F1, as near 0.5 as ties allow, from 0.2 to 0.8."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        s, t = scores[own], y[own] > 0
        if t.sum() < 5 or (~t).sum() < 5:
            continue
        best = max(((2 * (t & (s >= c)).sum() / max(1, t.sum() + (s >= c).sum()), -abs(c - 0.5), c) for c in np.linspace(0.2, 0.8, 25)))
        out[lang] = round(float(best[2]), 3)
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents: those with the smallest hash of their id.

    ``learn`` limits the labels that may be learnt from. Null labels and ids are left out; an id with
    several labels counts as toxic if one is. Only the chosen ids are joined with the texts.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        usable = usable.where(learn)
    chosen = (usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
              .orderBy(F.xxhash64("__id"), "__id").limit(sample))
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
            .join(F.broadcast(chosen), "__id").dropDuplicates(["__id"])
            .select(F.lit(1).alias("one"), F.xxhash64("__id").alias("h"), F.col("__id").cast("string").alias("id"), "t", "l", F.col("__y").alias("y")))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("id", "ascending")])
        return pa.table({"model": pa.array([pickle.dumps(fit(*[table.column(c).to_pylist() for c in ("t", "y", "l")]))], pa.binary())})

    ship_package(docs.sparkSession)
    fitted = rows.groupBy("one").applyInArrow(run, "model binary").collect()  # one task for the bounded sample, a model of some megabytes
    return pickle.loads(fitted[0]["model"]) if fitted else fit([], [], [])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, score (0 to 1), predicted (score >= 0.5) and flagged (score >= its language's threshold).

    A null text counts as empty and is scored like it; a null or unknown language has threshold 0.5;
    repeated rows give repeated results. No shuffle; the model is a bounded few megabytes.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("flagged", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thresholds = shared.value.thresholds
        for batch in batches:
            score = np.round(shared.value.scores(batch.column(1)), 9)
            limit = np.array([thresholds.get(x, 0.5) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= limit)], names=schema.fieldNames())

    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    return map_arrow(docs.select(F.col(id_col), F.col(text_col), lang.alias("__lang")), run, schema)


def toxicity_filter(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose score is below their language's threshold, with the same columns."""
    names = docs.columns
    at, lang_at = names.index(text_col), names.index(lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = np.array([shared.value.thresholds.get(x, 0.5) for x in batch.column(lang_at).to_pylist()])
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < limit))

    return map_arrow(docs, run, docs.schema)
