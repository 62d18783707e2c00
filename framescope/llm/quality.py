"""Quality classification by naive Bayes support vectors.

Features are indicators of hashed n-grams: words, word pairs, and one to three word *shapes*
(letter case, the punctuation or digits a word ends in, whether it repeats the word before it).
Each is scaled by the log ratio of its counts in good and bad documents, then a linear hinge-loss
model is fitted by dual coordinate descent. A logistic curve fitted on rows that training does not
see turns margins into probabilities.

Training takes at most about SAMPLE rows of each label (the documented bound), in an order by a hash of id and
text, so that the same rows give the same model however they are partitioned. Scoring runs over
whole texts inside Arrow batches: one weight a bucket, nothing is shuffled.

Null or empty text has no features: its score comes from the bias. Without labels of both kinds
every score is 0.5. Every fourth row of the sample is set apart for the curve; of fewer than LEAST_APART rows none
is, and the curve is fitted on the training rows. A document labelled twice counts twice; null labels and doc_ids teach nothing.
A score equal to ACCEPT is accepted. Repeated rows give repeated rows; extra columns are ignored by
`classify` and kept by `keep`; an empty table gives an empty result. Very long texts are scored whole,
with some hundred bytes of working memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .kernel import Words, lists, mix, slices

WORD_BITS, SHAPE_BITS = 18, 14
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
SAMPLE = 3000  # bound of the training sample (expected rows a label)
LEAST_APART = 40  # rows of a sample that can spare some for the curve
ACCEPT = 0.7
_COST, _EPOCHS, _SMOOTH = 1.0, 12, 1.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) of a slice, ordered by both."""
    words = Words(data, offsets, lower=False)
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = Words(data, offsets)
    text = np.append(data, np.uint8(32))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128))])
    length = words.end - words.start
    caps, letters = upper[words.end] - upper[words.start], letter[words.end] - letter[words.start]
    first = (text[words.start] >= 65) & (text[words.start] <= 90)
    case = np.where(letters == 0, 0, np.where((caps > 1) & (2 * caps >= letters), 3, np.where(first, 2, 1)))
    last = text[words.end - 1].astype(np.int64)
    tail = np.where((last | 32 >= 97) & (last | 32 <= 122) | (last >= 128), 1, np.where((last >= 48) & (last <= 57), 2, last))
    twice = np.minimum(text[np.maximum(words.end - 2, 0)].astype(np.int64), 128) * (length > 1)
    tail = np.where(tail > 2, tail * 256 + np.where((twice | 32 >= 97) & (twice | 32 <= 122) | (twice >= 128), 1, twice), tail)
    new = words.first[words.doc] == np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = (low.hash[1:] == low.hash[:-1]) & ~new[1:]
    shape = mix((tail * 64 + case * 4 + same * 2 + (length > 24)).astype(np.uint64))
    at, key = [words.doc, words.doc], [(low.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), (1 << WORD_BITS) + (shape >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)]
    if n > 1:
        inside = ~new[1:]
        pair = mix(low.hash[:-1] * np.uint64(3) + low.hash[1:])
        two = mix(shape[:-1] * np.uint64(5) + shape[1:])
        at += [words.doc[1:][inside]] * 2
        key += [(pair[inside] >> np.uint64(64 - WORD_BITS)).astype(np.int64), (1 << WORD_BITS) + (two[inside] >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)]
        if n > 2:
            three = mix(two[:-1] * np.uint64(7) + shape[2:])
            whole = inside[1:] & inside[:-1]
            at.append(words.doc[2:][whole])
            key.append((1 << WORD_BITS) + (three[whole] >> np.uint64(64 - SHAPE_BITS)).astype(np.int64))
    both = np.unique(np.concatenate(at) * BUCKETS + np.concatenate(key))
    return both // BUCKETS, both % BUCKETS


def _indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            doc, key = features(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in ("label", "place")), lists(key.astype(np.int32), np.bincount(doc, minlength=b - a), pa.int32())], ["label", "place", "bucket"])


class Trained:
    """Ratios, weights and the curve from margins to probabilities."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.product, self.square = ratio * weight, ratio**2
        self.bias, self.slope, self.shift = bias, slope, shift

    def score(self, doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(doc, weights=self.product[key], minlength=n)
        norm = np.sqrt(np.bincount(doc, weights=self.square[key], minlength=n))
        margin = total / np.maximum(norm, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _hinge(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + C sum max(0, 1 - y w.x) over x = ratio at the row's buckets, by dual coordinate
    descent; the bias is a constant feature. Rows are scaled to unit length and C by label share."""
    rng = np.random.default_rng(11)
    values = [ratio[x] for x in rows]
    norm = [max(float(np.sqrt((v * v).sum())), 1e-9) for v in values]
    values = [v / s for v, s in zip(values, norm, strict=True)]
    square = np.full(len(rows), 2.0)
    cost = np.where(label > 0, len(label) / (2 * max(1, (label > 0).sum())), len(label) / (2 * max(1, (label < 0).sum()))) * _COST
    weight, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    for _ in range(_EPOCHS):
        for i in rng.permutation(len(rows)):
            y = label[i]
            slope = y * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * y
                weight[rows[i]] += change * values[i]
                bias += change
                alpha[i] = new
    return weight, bias


def _margins(rows: list[np.ndarray], ratio: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weight[x] @ ratio[x] / max(np.sqrt((ratio[x] ** 2).sum()), 1e-9) + bias for x in rows])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Trained:
    """Learn from labelled rows outside the held-out quarter, about per_label of either label,
    chosen by a hash of doc_id; only their bucket lists reach the driver."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Trained(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 0.0)
    share = F.when(F.col("label") == 1, min(1.0, per_label / sizes[1])).otherwise(min(1.0, per_label / sizes[0]))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    place = F.xxhash64("doc_id", "text").alias("place")  # training order and the part set apart do not depend on partitions
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", place, "text").mapInArrow(_indicators, "label int, place long, bucket array<int>").toArrow()
    order = np.lexsort((np.asarray(found.column("label")), np.asarray(found.column("place"))))
    label = np.where(np.asarray(found.column("label"))[order] == 1, 1.0, -1.0)
    lists_ = found.column("bucket").combine_chunks()
    at, keys = np.asarray(lists_.offsets), np.asarray(lists_.values)
    rows = [keys[at[i] : at[i + 1]] for i in order]  # views of the one buffer that came
    if len({*label}) < 2:
        return Trained(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 0.0)
    apart = np.arange(len(rows)) % 4 == 0 if len(rows) >= LEAST_APART else np.zeros(len(rows), bool)
    train = [r for r, x in zip(rows, apart, strict=True) if not x]
    y = label[~apart]
    good, bad = np.full(BUCKETS, _SMOOTH), np.full(BUCKETS, _SMOOTH)
    for r, s in zip(train, y, strict=True):
        (good if s > 0 else bad)[r] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    weight, bias = _hinge(train, y, ratio)
    seen, truth = ([r for r, x in zip(rows, apart, strict=True) if x], label[apart]) if apart.any() else (train, y)
    margin = _margins(seen, ratio, weight, bias)
    # the sample is balanced by label, so each label's rows stand for its whole share
    prior = np.where(truth > 0, sizes[1] / max(1, (truth > 0).sum()), sizes[0] / max(1, (truth < 0).sum()))
    slope, shift = _logistic(margin, truth, prior / prior.sum())
    return Trained(ratio, weight, bias, slope, shift)


def _logistic(margin: np.ndarray, truth: np.ndarray, prior: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit with smoothed targets, by Newton's method with a small ridge."""
    target = np.where(truth > 0, 1 - 1 / (2 + (truth > 0).sum()), 1 / (2 + (truth < 0).sum()))
    x, w = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (prior * (p - target)) + 1e-6 * w
        hess = (x * (prior * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def predict(docs: DataFrame, model: Trained) -> DataFrame:
    """doc_id and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of BUCKETS doubles

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in slices(batch.column("text")):
                doc, key = features(data, offsets)
                out[a:b] = m.score(doc, key, b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on docs and labels, then score all of docs."""
    scored = predict(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                doc, key = features(data, offsets)
                good = m.score(doc, key, b - a) >= ACCEPT
                yield batch.slice(a, b - a).filter(pa.array(good)).select(names)

    return docs.mapInArrow(filtered, docs.schema)
