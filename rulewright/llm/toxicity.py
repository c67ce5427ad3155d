"""Toxicity by classifier chains.

Categories are predicted one after the other by logistic regressions over the presence of words and word beginnings (4, 5 and
6 bytes, A-Z lower-cased); each later model is also given the probabilities of the earlier categories. In training these are
out-of-fold: every row's come from models that have not seen it, so that a later model learns how far an earlier one can be
trusted on new text. At prediction they come from models fitted on all training rows.

The models are fitted on at most ``sample`` labelled rows (those with the least hash of their id; the documented bound of what
training reads and what it sends to the driver, with ``n_features`` features by the gain of their presence about the last
category). Prediction covers every whole text, in one pass without a shuffle.

``labels`` tells quality and toxicity, each yes or no; the chain's categories are the combinations that this gives: ``poor``,
``poor_toxic`` and ``toxic``. Others can be given as conditions over the columns of labels; no word is listed anywhere.

Defined results: null or empty texts have no features and get the models' base rates; labels without a document, nulls among
labels and repeated labels of one document beyond its first are no training rows; with fewer than ``MIN_CLASS`` rows of either
class a category's model is the share of its positive rows; each of repeated rows is answered; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X

U = np.uint64
SAMPLE, FEATURES, FOLDS, MIN_CLASS = 10_000, 768, 5, 8
PREFIXES = (0, 4, 5, 6)  # 0: the whole word
BYTES = 1 << 20


def text_features(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) for each word and for each beginning of longer words."""
    start, end = X.word_places(data, offs, X.ALNUM)
    c = X.prefix_hash(data, X.LOWER_VALUES)
    row = np.searchsorted(offs, start, "right") - 1
    for k in PREFIXES:
        some = slice(None) if not k else np.flatnonzero(end - start > k)
        s = start[some]
        yield row[some], X.mix(X.range_hash(c, s, s + k if k else end) + U(k))


def distinct_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = list(text_features(data, offs))
    row, f = np.concatenate([r for r, _ in got]), np.concatenate([x for _, x in got])
    order = np.lexsort((f, row))
    row, f = row[order], f[order]
    keep = np.ones(len(f), bool)
    keep[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])
    return row[keep], f[keep]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights, the last one of a constant; accelerated gradient descent on the mean loss."""
    p = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w = np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = np.log(p / (1 - p))
    if min(y.sum(), len(y) - y.sum()) < MIN_CLASS:
        return w
    a = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    v = np.ones(a.shape[1], np.float32)  # the largest eigenvalue, by power iteration, bounds the step
    for _ in range(10):
        v = a.T @ (a @ (v / np.linalg.norm(v)))
    step = 1 / (np.linalg.norm(v) / len(a) / 4 + l2)
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        g = a.T @ (sigmoid(a @ z) - y) / len(a)
        g[:-1] += l2 * z[:-1]
        new, t_new = z - step * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    features: np.ndarray  # ascending hashes
    weights: tuple[np.ndarray, ...]  # of features, earlier categories, a constant

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            out = np.hstack([out, sigmoid(np.hstack([x, out]) @ w[:-1] + w[-1])[:, None]])
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, categories: tuple[str, ...], features: np.ndarray, folds: int = FOLDS) -> Chain:
    fold = np.arange(len(x)) % folds
    earlier, weights = np.zeros((len(x), 0), np.float32), []
    for k in range(len(categories)):
        own = np.hstack([x, earlier]).astype(np.float32)
        weights.append(logistic(own, y[:, k]))
        held = np.zeros(len(x), np.float32)
        for i in range(folds):
            w = logistic(own[fold != i], y[fold != i, k])
            held[fold == i] = sigmoid(own[fold == i] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, held[:, None]])
    return Chain(categories, features, tuple(weights))


def sparse_rows(row: np.ndarray, f: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((n, len(features)), np.float32)
    if len(features) and len(f):
        k = np.minimum(np.searchsorted(features, f), len(features) - 1)
        hit = features[k] == f
        x[row[hit], k[hit]] = 1
    return x


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, n_features: int = FEATURES) -> Chain:
    """categories: conditions, in the chain's order, over the columns of labels and the text (column ``text``)."""
    labels = labels.drop(*({"text", text_col} - {id_col}))
    some = labels.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), id_col)
    told = rows.select(id_col, "text", F.array(*(c.cast("int") for c in categories.values())).alias("told")).where(~F.exists("told", lambda v: v.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = X.utf8(b.column(1))
            for i, j in X.pieces(offs, BYTES):
                row, f = distinct_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(f.view(np.int64)))], names=["id", "told", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    from .scratch import Scratch

    work = Scratch(docs.sparkSession, "toxicity")
    table = work.save(told.mapInArrow(run, f"id {kind}, told array<int>, f array<long>"), "sample")
    n, pos = (int(v or 0) for v in table.agg(F.count("*"), F.sum(F.element_at("told", -1))).first())
    y_last = F.element_at("told", -1)
    counts = table.select(F.explode("f").alias("f"), y_last.alias("y")).groupBy("f").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("q")).where(F.col("p") + F.col("q") >= 3)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    share = pos / max(n, 1)
    df = F.col("p") + F.col("q")
    gain = term(F.col("p"), df * max(share, 1e-9)) + term(F.col("q"), df * max(1 - share, 1e-9))
    top = [r["f"] for r in counts.select("f", gain.alias("gain")).orderBy(F.desc("gain"), "f").limit(n_features).collect()]
    features = np.sort(np.array(top, np.int64).view(U))
    chosen = table.select("id", "told", F.array_intersect("f", F.array(*map(F.lit, top)).cast("array<bigint>")).alias("f")).orderBy(F.xxhash64("id"), "id").collect()
    row = np.repeat(np.arange(len(chosen)), [len(r["f"]) for r in chosen])
    f = np.array([v for r in chosen for v in r["f"]], np.int64).view(U)
    y = np.array([r["told"] for r in chosen], np.float32).reshape(len(chosen), len(categories))
    work.drop(table)
    return fit_chain(sparse_rows(row, f, features, len(chosen)), y, tuple(categories), features)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``p_<category>`` of every document."""
    told = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        for b in batches:
            data, offs = X.utf8(b.column(1))
            for i, j in X.pieces(offs, BYTES):
                x = np.zeros((j - i, len(own.features)), np.float32)
                for row, f in text_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    np.maximum(x, sparse_rows(row, f, own.features, j - i), out=x)
                p = own.predict(x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(p[:, k].astype(np.float64)) for k in range(p.shape[1]))], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} double" for n in names)]))


def label_categories() -> dict[str, Column]:
    """The chain's categories as the labels tell them: poor text, poor and toxic text, toxic text."""
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"poor": poor, "poor_toxic": poor & toxic, "toxic": toxic}
