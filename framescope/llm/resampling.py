"""Importance resampling towards a target distribution, by hashed n-gram features.

A feature is a run of one to `orders` consecutive words (lower-cased in A-Z, made of letters, digits and
non-ASCII characters); it falls into a bucket by its CRC-32. With s of S source features and t of T target
features in a bucket, its gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), and a document weighs the sum
of its features' gains. Gumbel noise from a hash of seed and doc_id turns the highest `share` of
weight + noise into a sample without replacement, drawn in proportion to importance.

Plan: two passes of Arrow batches. The first gives one vector of `buckets` counts a partition (np.bincount),
merged pairwise by treeReduce, so the driver receives a few vectors however many partitions there are. The
second looks the broadcast gains up and sums them by document (np.bincount with weights). Scores are
written; ranks come from a range partitioning of (score, doc_id) and one count a range, so no task sees all
documents.

Null text is empty. A document of fewer than `least_words` words has weight and score but is never drawn;
without features its weight is 0. Equal scores: the smaller doc_id (null first), then fewer features, lower
weight; rows equal in all of these are alike in every column but rank. Rows that repeat a doc_id are rows of
their own with the same noise; null doc_id hashes as an empty one. An empty target gives gains from the
source alone; an empty source no rows. Extra columns are ignored by `resample` and kept by `drawn`. Very long texts and
words are handled whole by one task, slice by slice of whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .kernel import _LOWER, slices

BUCKETS, ORDERS, SEED, SHARE, LEAST_WORDS = 10_000, 1, 2024, (10, 100), 20
RANGE_ROWS = 1 << 20  # rows of one range when scores are ranked
_VECTORISED = 48  # bytes of a feature up to which CRCs are computed side by side
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1)).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each span: a step a byte for all short spans together, zlib for long ones."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(size, kind="stable")
    begins, ordered = start[order], size[order]
    state = out.copy()
    last = int(np.searchsorted(ordered, _VECTORISED, "right"))
    for j in range(int(ordered[last - 1]) if last else 0):
        a = int(np.searchsorted(ordered, j, "right"))  # spans longer than j
        now = state[a:last]
        state[a:last] = _CRC[(now ^ data[begins[a:last] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[order] = ~state
    for i in order[last:]:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def features(data: np.ndarray, offsets: np.ndarray, orders: int = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of every feature of a slice, and the words of each document."""
    low = _LOWER[data]
    inside = _WORD[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[: len(low)]
    after = np.concatenate([inside[1:], [False]]) & ~first[1 : len(low) + 1]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(doc, minlength=len(offsets) - 1)
    if orders > 1:  # words one space apart, so that a run is one stretch of bytes
        size = end - start
        at = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        text = np.full(int((size + 1).sum()), 32, np.uint8)
        text[np.repeat(at - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(int(size.sum()))] = low[inside]
        low, start, end = text, at, at + size
    docs, keys = [], []
    for k in range(1, orders + 1):
        n = len(start) - k + 1
        if n <= 0:
            break
        whole = doc[:n] == doc[k - 1 :]
        docs.append(doc[:n][whole])
        keys.append(crc32(low, start[:n][whole], end[k - 1 :][whole]).astype(np.int64) % buckets)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *docs]), np.concatenate([none, *keys]), words


def counts(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                total += np.bincount(features(data, offsets, orders, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    vectors = texts.select("text").mapInArrow(partial, "n binary").rdd.map(lambda r: np.frombuffer(r["n"], np.int64))
    return vectors.treeReduce(lambda a, b: a + b, 3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket."""
    b, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log((float(t) + 1) * (all_source + b) / ((float(s) + 1) * (all_target + b)))) for s, t in zip(source, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """docs' doc_id with n_features, n_words and weight."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for a, b, data, offsets in slices(batch.column("text")):
                doc, key, words = features(data, offsets, orders, buckets)
                # sums stay far below 2**53, so doubles hold them exactly
                out[:, a:b] = np.bincount(doc, minlength=b - a), words, np.bincount(doc, weights=shared.value[key], minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_features", "n_words", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def ranked(scores: DataFrame, drawn: int, total: int) -> DataFrame:
    """scores with rank 1, 2, ... of the `drawn` highest, null for the others: sorted ranges, each counted."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    parts = max(1, -(-total // RANGE_ROWS))
    ranges = cut(scores.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in ranges.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a range
    before, ahead = 0, []
    for k in sorted(sizes):
        ahead.append((k, before))
        before += sizes[k]
    starts = F.broadcast(scores.sparkSession.createDataFrame(ahead, "part long, ahead long"))  # one row a range
    rank = F.col("ahead") + place + 1
    return ranges.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(rank <= drawn, rank))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for rows not drawn."""
    gain = gains(counts(docs, orders, buckets), counts(target, orders, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weighed(docs, gain, orders).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    out = ["doc_id", "n_features", "weight", "score"]
    if not n:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(able), n * share[0] // share[1], n).select(*out, "rank").unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with docs' own columns."""
    chosen = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("drawn_id")), "left_semi")


def oracle(source: str, target: str) -> str:
    """resample with one order in SQL; CRCs byte by byte for each different word."""
    words = lambda t: f"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {t}"
    return f"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
), rows AS (
  SELECT doc_id, text, row_number() OVER () AS r FROM {source}
), d AS (
  SELECT r, w, count(*) AS n FROM (SELECT r, {words("rows")}) GROUP BY r, w
), q AS (
  SELECT w, count(*) AS n FROM (SELECT {words(target)}) GROUP BY w
), u AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM q)
), b AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM u, t
), s AS (
  SELECT bucket, sum(n)::DOUBLE AS s FROM d JOIN b USING (w) GROUP BY bucket
), g AS (
  SELECT bucket, sum(n)::DOUBLE AS t FROM q JOIN b USING (w) GROUP BY bucket
), gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + {BUCKETS}) / ((s + 1) * (coalesce((SELECT sum(t) FROM g), 0) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN g USING (bucket)
), f AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM d JOIN b USING (w) JOIN gain USING (bucket) GROUP BY r
), e AS (
  SELECT r, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM rows LEFT JOIN f USING (r)
), x AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e
), y AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS k, count(*) OVER () * {SHARE[0]} // {SHARE[1]} AS most FROM x WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= most THEN k END AS rank FROM x LEFT JOIN y USING (r)
"""
