"""Language identification by averaged hashed subword embeddings.

A text's byte n-grams inside words (with one boundary byte at either end) are hashed to rows of an
embedding matrix; their mean goes through a linear softmax. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. A temperature and a rejection threshold are
fitted on a part of the sample that training does not see, so that `score` is a calibrated
probability and `rejected` marks texts below the precision asked for. Of a sample of fewer than LEAST_APART
rows nothing is set apart: both are fitted on the training rows. The sample is taken in an order by a hash of id and
text, so that the same rows give the same model however they are partitioned.

Since the mean and the softmax's weights are linear, scoring uses their product: one weight a
bucket and language, summed over the whole text inside an Arrow batch; nothing is shuffled.

Null text, or text without a letter: `und`, score 0, rejected. No labelled rows: `und` for all.
Equal scores: the first language by name. Repeated rows, and rows of null doc_id, give rows of their own
(null doc_id is not held out). Extra columns are ignored; an empty table gives an empty result. Very long
texts are scored whole, with some tens of bytes of working memory for each of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .kernel import _LOWER, _SPACE, lists, slices

BUCKETS, DIM = 1 << 16, 16
SAMPLE_PER_LANGUAGE = 600  # bound of the training sample (expected rows a language)
LEAST_APART = 20  # rows of a sample that can spare some for calibration
EPOCHS, RATE, PRECISION = 6, 2.0, 0.99
UNKNOWN = "und"


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 2 to 4 bytes that do not cross a word or a text: position, bucket."""
    low = np.where(_SPACE[data], 32, _LOWER[data]).astype(np.uint32)
    gap = low == 32
    n = len(low)
    last = np.zeros(n + 1, bool)
    last[offsets] = True  # a text starts here
    at, out = [], []
    code = low.copy()
    cross = np.zeros(n, bool)
    for size in (2, 3, 4):
        m = n - size + 1
        if m <= 0:
            break
        code = code[:m] | (low[size - 1 :] << np.uint32(8 * (size - 1)))
        cross = cross[:m] | last[size - 1 : n]
        kept = ~cross
        for j in range(1, size - 1):
            kept = kept & ~gap[j : j + m]
        if size == 2:
            kept = kept & ~(gap[:m] & gap[1 : 1 + m])
        where = np.flatnonzero(kept)
        bucket = (code[where] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        at.append(where)
        out.append((bucket >> np.uint32(16)).astype(np.int32))
    return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            at, bucket = subwords(data, offsets)
            doc = np.searchsorted(offsets, at, "right") - 1
            key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
            per = np.bincount(key // BUCKETS, minlength=b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in ("lang", "place")), lists((key % BUCKETS).astype(np.int32), per, pa.int32()), lists(n.astype(np.int32), per, pa.int32())], ["lang", "place", "bucket", "n"])


class Model:
    """Per-bucket language scores, bias, temperature and rejection threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, heat: float, least: float):
        self.languages, self.table, self.bias, self.heat, self.least = languages, table, bias, heat, least

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _sgd(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    total = EPOCHS * len(rows)
    for step, i in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(EPOCHS)])):
        label, index, share = rows[i]
        rate = RATE * (1 - step / total)
        hidden = share @ embed[index]
        z = hidden @ weight + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        back = weight @ p
        weight -= rate * np.outer(hidden, p)
        bias -= 0.05 * rate * p
        embed[index] -= (rate * share)[:, None] * back
    return embed, weight, bias


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on rows outside the held-out quarter with text and lang, about per_language of each
    language, chosen by a hash of doc_id; only their hashed counts reach the driver."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(x for x in sizes if x != UNKNOWN)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / sizes[name]))])
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    place = {x: i for i, x in enumerate(languages)}
    rows = []
    place_of = F.xxhash64("doc_id", "text").alias("place")  # training order does not depend on partitions
    found = picked.select("lang", place_of, "text").mapInArrow(_counts, "lang string, place long, bucket array<int>, n array<int>").toArrow()
    for r in found.sort_by([("place", "ascending"), ("lang", "ascending")]).to_pylist():
        n = np.asarray(r["n"], np.float32)
        if len(n):
            rows.append((place[r["lang"]], np.asarray(r["bucket"]), n / n.sum()))
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    apart = np.arange(len(rows)) % 5 == 0 if len(rows) >= LEAST_APART else np.zeros(len(rows), bool)
    embed, weight, bias = _sgd([r for r, x in zip(rows, apart, strict=True) if not x], len(languages))
    model = Model(languages, embed @ weight, bias.astype(np.float64), 1.0, 0.0)
    seen = [r for r, x in zip(rows, apart, strict=True) if x] or rows
    mean = np.stack([share @ model.table[index] for _, index, share in seen]).astype(np.float64)
    label = np.array([r[0] for r in seen])

    def loss(heat: float) -> float:
        model.heat = heat
        return -np.log(model.probabilities(mean)[np.arange(len(label)), label] + 1e-12).mean()

    model.heat = min((2.0**x for x in np.arange(-3, 3.1, 0.25)), key=loss)
    p = model.probabilities(mean)
    right, top = p.argmax(axis=1) == label, p.max(axis=1)
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    model.least = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        columns = [np.ascontiguousarray(m.table[:, j]) for j in range(k)]
        for batch in batches:
            text = batch.column("text")
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\pL"), False))
            best, top = np.full(len(text), -1), np.zeros(len(text))
            for a, b, data, offsets in slices(text):
                if not k:
                    break
                at, bucket = subwords(data, offsets)
                doc = np.searchsorted(offsets, at, "right") - 1
                n = np.bincount(doc, minlength=b - a)
                mean = np.stack([np.bincount(doc, weights=c[bucket], minlength=b - a) for c in columns], axis=1) / np.maximum(n, 1)[:, None]
                p = m.probabilities(mean)
                best[a:b], top[a:b] = p.argmax(axis=1), p.max(axis=1)
            known = letters & (best >= 0)
            names = np.array([*m.languages, UNKNOWN], object)
            top = np.where(known, np.clip(top, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[np.where(known, best, k)], pa.string()), pa.array(top), pa.array(~known | (top < m.least))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on docs, then predict all of docs."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
