"""Sharding by histogram sort: near-equal bytes, one exchange.

Rows are ordered by a key: the first 48 bits of the text's MD5, then doc_id, so that copies of a text
are neighbours and the order has nothing to do with the input's. Shard i begins at the first key with
i / shards of all bytes before it. Those splitters are found without sorting anything: each round
counts the exact bytes below candidate boundaries (256 probes inside each interval that still holds
a splitter) over all partitions and keeps the probed interval that the splitter falls in, until an
interval is one key. Only then do the rows move, once.

Each shard is cut the same way into runs, at least RUNS and of about RUN_ROWS rows, so that no task has
to sort a whole shard: a row's slot is the count of the shard's runs before its own plus its rank
inside the run. Per round the driver gets at most 256 sums a run. A hot text may span several runs
and shards: its copies are split by doc_id.

`order` replaces the key by two given columns: shards are then stretches of that order (the pipeline
gives the reading order of a mix). `keep` lets all columns of docs come through, texts included; those
named like one of the result's are replaced.

size: UTF-8 bytes of the text (null: none) plus 16; crc32 of null text is that of no bytes. Rows with
the same doc_id and text are one key and share a shard; null doc_id sorts first. Without `keep`, extra
columns do not come through. An empty table gives an empty result. Texts of any length are only
measured and hashed.
"""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

SHARDS, RUNS, OVERHEAD = 40, 8, 16
RUN_ROWS = 4_000_000
_BITS, _STEP, _HEAD = 48, 8, 10
_LEAST = -(1 << 63)


def keyed(docs: DataFrame, order: tuple[Column, Column] | None = None, keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32 and the order key (k1, k2) of each row; text goes no further unless
    kept in `row`, a struct of docs' columns."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    k1, k2 = order or (F.conv(F.substring(F.md5(raw), 1, _BITS // 4), 16, 10), F.col("doc_id"))
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        k1.cast("long").alias("k1"),
        F.coalesce(k2.cast("long"), F.lit(_LEAST)).alias("k2"),
        *([F.struct("*").alias("row")] if keep else []),
    )


def reading_order(docs: DataFrame) -> tuple[Column, Column] | None:
    """The place of each row in the written files docs is read from: part number and row in it; none
    if docs does not come from Parquet files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    return F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS long)"), F.lit(0)), F.col("_metadata.row_index")


def _narrowed(rows: DataFrame, keys: list[Column], bits: int, targets: dict[int, tuple], share: Fraction, found: dict) -> dict[int, tuple]:
    """Radix rounds over the last of keys, an unsigned `bits`-bit number; targets: {i: (values of the
    other keys and common prefix of the last one, bytes before it)}. Returns the same with whole
    keys; those whose interval holds a single (k1, k2) go to found as soon as that shows."""
    *outer, last = keys
    shift = -(-bits // _STEP) * _STEP
    ends = [f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]
    while shift and targets:
        shift -= _STEP
        above = F.struct(*outer, F.shiftrightunsigned(last, shift + _STEP) if shift + _STEP < 64 else F.lit(0).cast("long"))
        wanted = sorted({t[0] for t in targets.values()})
        part = rows.where(above.isin([F.struct(*[F.lit(x).cast("long") for x in w]) for w in wanted]))
        sums: dict[tuple, list[tuple]] = {}
        for r in part.groupBy(*[x.alias(f"o{j}") for j, x in enumerate(outer)], F.shiftrightunsigned(last, shift).alias("p")).agg(F.sum("size").alias("b"), *ends).collect():
            p = r["p"] % (1 << 64)
            one = (r["min_k1"], r["min_k2"]) if r["min_k1"] == r["max_k1"] and r["min_k2"] == r["max_k2"] else None
            sums.setdefault((*(r[f"o{j}"] for j in range(len(outer))), p >> _STEP if shift + _STEP < 64 else 0), []).append((p, r["b"], one))
        for v in sums.values():
            v.sort(key=lambda x: x[0])
        for i, (key, before) in list(targets.items()):
            for p, b, one in sums[key]:
                if before + b >= i * share:
                    break
                before += b
            if one is None:
                targets[i] = ((*key[:-1], p), before)
            else:
                found[i] = one
                del targets[i]
    return targets


def splitters(rows: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Last key (k1, k2) before shards 1 and up: the least key whose bytes, with all before them,
    reach i / shards of the total."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    share, found = Fraction(total, shards), {}
    left = _narrowed(rows, [F.col("k1")], _BITS, {i: ((0,), 0) for i in range(1, shards)}, share, found)
    if left:  # cuts among the copies of one text: the same rounds over doc_id, as an unsigned number
        flip = 1 << 63
        inside = rows.where(F.col("k1").isin(sorted({k[0] for k, _ in left.values()})))
        spans = {r["k1"]: (r["lo"] + flip, r["hi"] + flip) for r in inside.groupBy("k1").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).collect()}
        bits = max((spans[k[0]][0] ^ spans[k[0]][1]).bit_length() for k, _ in left.values())
        shift = -(-bits // _STEP) * _STEP
        left = {i: ((k[0], spans[k[0]][0] >> shift), before) for i, (k, before) in left.items()}
        _narrowed(inside, [F.col("k1"), F.col("k2").bitwiseXOR(F.lit(_LEAST))], bits, left, share, found)
    return [found[i] for i in sorted(found)]


def _place(cuts: list[tuple[int, int]]) -> Column:
    """Number of cuts before (k1, k2): those of lower k1 prefixes are counted beforehand, only the
    few of its own prefix are compared."""
    shift = _BITS - _HEAD
    base = [bisect_left(cuts, (x << shift, _LEAST)) for x in range((1 << _HEAD) + 1)]
    if not cuts:
        return F.lit(0)
    bases, keys = F.array(*map(F.lit, base)), F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in cuts])
    head = F.shiftrightunsigned("k1", shift).cast("int")
    low = F.element_at(bases, head + 1)
    own = F.slice(keys, low + 1, F.element_at(bases, head + 2) - low)
    return low + F.size(F.filter(own, lambda x: (x["a"] < F.col("k1")) | ((x["a"] == F.col("k1")) & (x["b"] < F.col("k2")))))


def shard(docs: DataFrame, shards: int = SHARDS, order: tuple[Column, Column] | None = None, keep: bool = False) -> DataFrame:
    """doc_id (with keep: all columns of docs), size, text_crc32, law, shard, slot, grown_shard for
    every row of docs."""
    rows = cut(keyed(docs, order))
    runs = max(RUNS, -(-rows.count() // (shards * RUN_ROWS)))
    placed = (keyed(docs, order, keep) if keep else rows).withColumn("run", _place(splitters(rows, shards * runs)))
    counts = placed.groupBy("run").agg(F.count("*").alias("n")).withColumn("shard", F.floor(F.col("run") / runs).cast("int"))
    # shards * runs rows
    ahead = counts.select("run", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy("k1", "k2", "text_crc32", "size"))
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in new] if keep else [F.col("doc_id")]
    return placed.withColumn("rank", rank).join(F.broadcast(ahead), "run").select(
        *own, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def oracle(source: str, shards: int = SHARDS) -> str:
    """The same assignment by one global running sum, in SQL."""
    return f"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h,
         ('0x' || substr(md5(coalesce(text, '')), 1, {_BITS // 4}))::BIGINT AS k1, coalesce(doc_id, {_LEAST + 1}) AS k2
  FROM {source}
), c AS (
  SELECT *, n + {OVERHEAD} AS size, sum(n + {OVERHEAD}) OVER (ORDER BY k1, k2 RANGE UNBOUNDED PRECEDING) - sum(n + {OVERHEAD}) OVER (PARTITION BY k1, k2) AS before,
         sum(n + {OVERHEAD}) OVER () AS total FROM d
), s AS (
  SELECT *, least(floor(before * {shards} / total), {shards - 1})::INT AS shard FROM c
)
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce([4294967295::BIGINT] || list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k1, k2, size) - 1 AS slot, NULL::INT AS grown_shard
FROM s, t
"""
