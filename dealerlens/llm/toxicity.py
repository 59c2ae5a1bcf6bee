"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text (lower case, white space as one space, a space at both ends) is the set of its character
n-grams, hashed to a fixed number of features.  From labelled texts come the log-count
ratios r of the features in toxic against other texts; a logistic regression is then fitted
on the presence of each feature times r, over minibatches of texts.  Features whose presence hardly
depends on the label (log-likelihood ratio statistic of the 2x2 table under ``evidence``) get no weight; a feature
of one class alone keeps one from 3 texts on where classes are of equal size.  Scoring reads whole texts and needs one table of
weights, whose size is fixed by ``bits``.

The fit uses at most ``rows_per_class`` labelled texts of each class, chosen by a hash of
their id; every text is scored.

Defined results: null and empty texts score as the empty text; a document with several
label rows counts as toxic if one of them says so; labels other than 0 and 1 are left out;
with no labelled text of one class the score is the share of toxic ones (0.5 without any); very long
texts are scored whole; ties of the sample's hash go by id; repeated rows are scored each; an
empty table gives no rows; extra columns are ignored by the query and kept by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import chosen_by_hash, every_column, fold, lean, table

ORDERS = (3, 4, 5, 6)
BITS = 20
ROWS_PER_CLASS = 3000
BATCH = 512
#: Feature numbers that a fit holds; those of further texts are made again in each pass.
HELD = 50_000_000


def ngrams(text: str | None, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Feature numbers of all n-grams of a text, with repetitions."""
    data = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, rolling = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(data) < n:
            break
        rolling = rolling[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + data[n - 1 :] + np.uint64(1)
        if n in orders:
            mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _distinct(features: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each feature once; ``seen`` is scratch space, a number per feature."""
    places = np.arange(len(features), dtype=np.int32)
    seen[features] = places
    return features[seen[features] == places]


def likelihood_ratio(a: np.ndarray, b: np.ndarray, toxic: float, other: float) -> np.ndarray:
    """G of the tables of features in ``a`` of ``toxic`` and ``b`` of ``other`` texts; it holds for rare features too."""
    share = (a + b) / (toxic + other)
    part = lambda n, expected: n * np.log(np.where(n > 0, n, 1) / np.where(n > 0, expected, 1))
    return 2 * (part(a, toxic * share) + part(b, other * share) + part(toxic - a, toxic * (1 - share)) + part(other - b, other * (1 - share)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    orders: tuple = ORDERS
    bits: int = BITS

    def __post_init__(self) -> None:
        self.used = self.weights != 0
        self.any = bool(self.used.any())

    def score(self, text: str | None) -> float:
        if not self.any:
            return 1 / (1 + np.exp(-self.bias))
        features = ngrams(text, self.orders, self.bits)
        features = np.unique(features[self.used[features]])
        z = self.bias + float(self.weights[features].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: list, labels: list, *, orders=ORDERS, bits: int = BITS, steps: int = 120, penalty: float = 1e-3, alpha: float = 1.0, least: float = 0.02, evidence: float = 4.0) -> Model:
    """Weights of the scaled classifier; those under ``least`` are set to 0."""
    y = np.asarray(labels, np.float64)
    toxic, other = float(y.sum()), float(len(y) - y.sum())
    if not toxic or not other:
        share = toxic / len(y) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), tuple(orders), bits)
    seen = np.zeros(1 << bits, np.int32)
    features_of = lambda t: _distinct(ngrams(t, orders, bits), seen)
    p, q = np.zeros(1 << bits), np.zeros(1 << bits)
    for text, label in zip(texts, y, strict=True):
        (p if label else q)[features_of(text)] += 1
    kept = np.flatnonzero(likelihood_ratio(p, q, toxic, other) >= evidence)
    ratio = np.log(((p[kept] + alpha) / (toxic + 2 * alpha)) / ((q[kept] + alpha) / (other + 2 * alpha)))
    number = np.full(1 << bits, -1, np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)

    def kept_of(text) -> np.ndarray:
        f = number[features_of(text)]
        return f[f >= 0]

    sets, room = [], HELD
    for text in texts:
        f = kept_of(text) if room > 0 else None
        room -= 0 if f is None else len(f)
        sets.append(f)
    w, m, v, total = (np.zeros(len(kept)) for _ in range(4))
    bias = bias_m = bias_v = 0.0
    balance = np.where(y == 1, 0.5 / toxic, 0.5 / other)
    batches = -(-len(y) // BATCH)
    order = np.random.default_rng(0).permutation(len(y))
    for step in range(1, steps + 1):
        scaled, bias_g = w * ratio, 0.0
        total[:] = 0
        for i in order[(step - 1) % batches :: batches]:
            f = kept_of(texts[i]) if sets[i] is None else sets[i]
            z = bias + scaled[f].sum()
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[i]) * balance[i] * batches
            total[f] += error  # a text has each feature once
            bias_g += error
        gradient = total * ratio + penalty * 1e-2 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        bias_m, bias_v = 0.9 * bias_m + 0.1 * bias_g, 0.99 * bias_v + 0.01 * bias_g**2
        rate = 0.05 / (1 + 3 * step / steps)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= rate * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_v / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(1 << bits, np.float32)
    weights[kept] = np.where(np.abs(w * ratio) < least, 0, w * ratio)
    return Model(weights, float(bias), tuple(orders), bits)


def train(docs: DataFrame, labels: DataFrame, *, held_out_buckets: int | None = 5, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", orders=ORDERS, bits: int = BITS) -> Model:
    """Fits on a bounded sample of the labelled rows; rows of fold 0 of
    ``held_out_buckets`` never take part."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if held_out_buckets:
        known = known.filter(fold(F.col("doc_id"), held_out_buckets) != 0)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen_by_hash(known.filter("y = 1"), "doc_id", rows_per_class).unionByName(chosen_by_hash(known.filter("y = 0"), "doc_id", rows_per_class))
    # At most 2 * rows_per_class pairs of numbers: a proven bound for the broadcast.
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, t or "", y) for b in batches for k, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = fit([r[1] for r in rows], [r[2] for r in rows], orders=orders, bits=bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    got = sample.select("doc_id", "text", "y").repartition(1).mapInArrow(lean(run), "weights binary, bias double").collect()
    if not got:  # no row reached the fit
        return fit([], [], orders=orders, bits=bits)
    return Model(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"], tuple(orders), bits)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out_col``; a column of that name is replaced."""
    kept = [x for x, c in zip(every_column(docs), docs.columns, strict=True) if c.lower() != out_col.lower()]
    names = [c for c in docs.columns if c.lower() != out_col.lower()]
    at = names.index(text_col)
    # By plain names meanwhile: a dot in a column's name would be read as a field of it.
    plain = docs.select(*kept).toDF(*(f"c{i}" for i in range(len(names))))
    schema = T.StructType([*plain.schema, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    return plain.mapInArrow(lean(run), schema).toDF(*names, out_col)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 5) == 0), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
