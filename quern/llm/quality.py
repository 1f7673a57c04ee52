"""Quality classifier: naive Bayes support vectors (Wang and Manning).

N-gram indicators are scaled by the log ratio of their class counts, each
document's vector is brought to length one, and a linear hinge-loss model is
fitted by dual coordinate descent; a logistic curve through the margins of
rows that the fit has not seen turns margins into probabilities.

N-grams: words and pairs of words in lower case, hashed; pairs and triples of one
word repeated; shapes of words (capitals, last byte) and pairs of shapes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.words import Words, groups, mix

_BITS, _SHAPE_BITS = 18, 12
FEATURES = (2 << _BITS) + (2 << _SHAPE_BITS) + 4
_LAST = np.zeros(256, np.uint64)  # the last byte, if it is ASCII but no letter
_LAST[33:127] = np.arange(33, 127)
_LAST[65:91] = _LAST[97:123] = 0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, sorted."""
    words = Words(texts, lower=True)
    h, owner = words.hash, words.owner().astype(np.int64)
    data = np.frombuffer(words.buffer, np.uint8)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = np.uint64(64 - _BITS)
    first, last = data[words.start], data[words.end - 1]
    capital = (first >= 65) & (first <= 90)
    caps = capital & (words.end - words.start > 1)
    second = data[np.minimum(words.start + 1, words.end - 1)]
    caps &= (second >= 65) & (second <= 90)
    shape = _LAST[last] * np.uint64(4) + capital * np.uint64(1) + caps * np.uint64(2)
    same = owner[1:] == owner[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[same]
    shapes, base = mix(shape * np.uint64(0x9E37) + np.uint64(1)) >> np.uint64(64 - _SHAPE_BITS), 2 << _BITS
    shape_pair = mix(shape[:-1] * np.uint64(1024) + shape[1:] + np.uint64(7))[same] >> np.uint64(64 - _SHAPE_BITS)
    twice = (h[1:] == h[:-1]) & same
    thrice = twice[1:] & twice[:-1]
    found = [
        (owner, (h >> top).astype(np.int64)),
        (owner[1:][same], (1 << _BITS) + (pair >> top).astype(np.int64)),
        (owner, base + shapes.astype(np.int64)),
        (owner[1:][same], base + (1 << _SHAPE_BITS) + shape_pair.astype(np.int64)),
        (owner[1:][twice], np.full(int(twice.sum()), FEATURES - 2)),
        (owner[2:][thrice], np.full(int(thrice.sum()), FEATURES - 1)),
    ]
    both = np.unique(np.concatenate([o * FEATURES + f for o, f in found]))
    return both // FEATURES, both % FEATURES


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))); `ratio` scales the indicators, `weight` is the fitted vector."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        owner, feature = features(texts)
        r = self.ratio[feature].astype(np.float64)
        dot = np.bincount(owner, r * self.weight[feature], len(texts))
        return dot / np.sqrt(np.maximum(np.bincount(owner, r * r, len(texts)), 1e-12)) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -500, 500)))


@dataclass(frozen=True)
class _Rows:
    """The fitting rows' features, one after the other in one array, and the factor that brings each scaled row to length one."""

    features: np.ndarray
    cuts: np.ndarray
    ratio: np.ndarray
    factor: np.ndarray

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.features[self.cuts[k] : self.cuts[k + 1]]
        return x, self.ratio[x] * self.factor[k]


def _descend(rows: _Rows, chosen: np.ndarray, signs: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; rows have length one and a constant bias feature of 1."""
    weight, bias, alpha, rng = np.zeros(FEATURES), 0.0, np.zeros(len(chosen)), np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(chosen)):
            x, v = rows.row(chosen[k])
            gradient = signs[k] * (weight[x] @ v + bias) - 1
            new = min(max(alpha[k] - gradient / 2.0, 0.0), cost)
            if new != alpha[k]:
                step = (new - alpha[k]) * signs[k]
                weight[x] += step * v
                bias += step
                alpha[k] = new
    return weight, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's curve with his smoothed targets, by Newton steps with a little ridge."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, p = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))) @ x.T + 1e-3 * np.eye(2), x @ (q - target) + 1e-3 * p)
        p = p - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(p[0], 1e-3)), float(p[1])


def fit(texts: list[bytes], labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 8) -> Model:
    """A model of labels 0 and 1. Without rows, or with one label only, every score is the smoothed share of label 1."""
    parts = [features(texts[lo : lo + 64]) for lo in range(0, len(texts), 64)]
    sizes = [np.bincount(owner, minlength=min(64, len(texts) - 64 * k)) for k, (owner, _) in enumerate(parts)]
    found = np.concatenate([np.zeros(0, np.int32), *(feature.astype(np.int32) for _, feature in parts)])
    return fit_features(found, np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes])))), labels, smoothing, cost, epochs)


def fit_features(found: np.ndarray, cuts: np.ndarray, labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 8) -> Model:
    """`fit` on features: those of row k are found[cuts[k] : cuts[k + 1]]."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    own = np.repeat(labels > 0, np.diff(cuts))
    good, bad = (smoothing + np.bincount(found[side], minlength=FEATURES) for side in (own, ~own))
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    squares = np.concatenate(([0.0], np.cumsum(ratio[found] ** 2)))
    rows = _Rows(found, cuts, ratio, 1 / np.maximum(np.sqrt(np.maximum(squares[cuts[1:]] - squares[cuts[:-1]], 0)), 1e-6))
    unseen = np.arange(len(labels)) % 5 == 4  # for the curve; the final weights then use all rows
    signs = np.where(labels > 0, 1.0, -1.0)

    def descend(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        return _descend(rows, chosen, signs[chosen], cost, epochs)

    weight, bias = descend(np.flatnonzero(~unseen))
    held = np.flatnonzero(unseen)
    slope, offset = (1.0, 0.0) if not len(held) else _logistic(np.array([weight[x] @ v + bias for x, v in map(rows.row, held)]), labels[held])
    weight, bias = descend(np.arange(len(labels)))
    return Model(ratio.astype(np.float32), weight.astype(np.float32), float(bias), slope, offset)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, mod `folds`; a null key is fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)), F.lit(0))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 6000, folds: int = 5, key: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most `fit_rows` labelled documents outside fold 0, those with the least hash of the key.

    The bound holds for the sample alone: a model of fixed size gains little from more. Labels that
    contradict each other count by their mean; null labels and labels without a document are left out.
    No text reaches the driver: tasks send the numbers of a row's features, each once, so FEATURES of four bytes a row
    at most whatever its length.
    """
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key), folds) != 0)).groupBy(F.col(key).alias("_key")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    chosen = votes.orderBy(F.xxhash64("_key"), "_key").limit(fit_rows)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = rows.select(F.xxhash64("_key", "_text").alias("_order"), "_key", F.xxhash64("_text").alias("_tie"), "_label", "_text")
    schema = T.StructType([*rows.schema.fields[:4], T.StructField("_features", T.ArrayType(T.IntegerType()))])
    found = rows.mapInArrow(_found, schema).orderBy("_order", "_key", "_tie").limit(fit_rows).select("_label", "_features").toArrow()
    lists = found.column("_features").combine_chunks()
    cuts = lists.offsets.to_numpy().astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    return fit_features(lists.flatten().to_numpy(), cuts - cuts[0], found.column("_label").to_numpy())


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each row's text in place of the text."""
    for batch, texts in groups(batches, 4):
        owner, feature = features(texts)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), lists], ["_order", "_key", "_tie", "_label", "_features"])


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, fit_rows: int = 6000, folds: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`' key and text scored: doc_id, held_out, score, predicted for every row; only text enters a score.

    Cases: null and empty texts get the score of no features; a null key counts as held out; repeated rows are scored
    each; without labels the score is 0.5; an empty table gives no rows; further columns are ignored; texts are read whole.
    """
    model = fit_quality(docs, labels, label, fit_rows, folds, key, text)
    rows = docs.select(F.col(key).alias("doc_id"), (fold(F.col(key), folds) == 0).alias("held_out"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    return rows.mapInArrow(_scorer(model, 2, threshold, [0, 1], schema.names), schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, columns unchanged, that the classifier predicts to be of label 1.

    Cases: null and empty texts are judged as texts without features; null keys are judged, never learned from; repeated
    rows stay or go together; of tied scores `threshold` itself stays; without labels every score is 0.5; an empty table
    gives no rows; columns of any name pass through.
    """
    model = fit_quality(docs, labels, text=text, **options)
    at = docs.columns.index(text)
    n = len(docs.columns)
    names = [f"c{i}" for i in range(n)] + ["_score", "_predicted"]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType())])
    return docs.toDF(*names[:n]).mapInArrow(_scorer(model, at, threshold, list(range(n)), names), schema).where("_predicted = 1").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _scorer(model: Model, text: int, threshold: float, keep: list[int], names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, text):
            scores = model.scores(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names)

    return score
