"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in an order by hash, form blocks of BLOCK rows. With whole weights that sum to W
a source of weight w has its block j (from 0) released at slot floor(j W / w) and due by slot
ceil((j + 1) W / w); each slot goes to the released block with the earliest deadline (ties: source
name). So after any t slots a source has had t w / W blocks to within less than one block, as long
as no source has run out. Weights are taken exactly as given (divided by their common divisor only).

The schedule repeats after W slots, so one period says where every block goes: block b of a source
has slot (b div w) W + place[b mod w]. The driver lays out at most one period, and of that no more
than what comes before the first source runs out: one number a slot, never one a row. Ranks inside a
source come from counts of hash ranges plus the rank inside one range; no task sees a whole source,
however much of the table it holds.

All rows are kept: `mixed` is true up to the first slot whose source has no block left; later rows
keep their slots, behind the mix. Null source is a source of its own. Repeated rows are separate
rows. A source without a given weight gets none of the mix: it follows after all others (mixed
false; release and deadline null). Null doc_id ranks as an empty string. Texts of any length, null or
empty ones are carried, not read but for a hash that breaks ties. An empty table gives an empty
result. Extra columns stay in `in_order`, whatever their names, and are dropped by `mix`.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from heapq import heappop, heappush
from math import gcd, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK = 64
RECIPE = 13  # weights of the registered query are 1 to this
BROADCAST_SLOTS = 1 << 22  # slots of a period that are broadcast as one number each
_NULL = "\x00"
_BITS, _GROUP = 48, 1 << 12  # rows of a source that one task ranks, about


def reduced(weights: dict[str, int]) -> dict[str, int]:
    """The positive weights over their common divisor."""
    kept = {x: int(w) for x, w in weights.items() if w > 0}
    divisor = reduce(gcd, kept.values(), 0)
    return {x: w // divisor for x, w in kept.items()}


def schedule(weights: dict[str, int], most: int | None = None) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period, or in its first `most` slots."""
    total = sum(weights.values())
    slots: dict[str, list[int]] = {x: [] for x in weights}
    later: list[tuple[int, int, str]] = []  # (release, deadline, source)
    ready: list[tuple[int, str]] = []

    def release(x: str) -> None:
        j, w = len(slots[x]), weights[x]
        heappush(later, (j * total // w, -(-(j + 1) * total // w), x))

    for x in weights:
        release(x)
    for t in range(total if most is None else min(total, most)):
        while later and later[0][0] <= t:
            _, due, x = heappop(later)
            heappush(ready, (due, x))
        _, x = heappop(ready)
        slots[x].append(t)
        release(x)
    return slots


def tempered(counts: dict[str, int]) -> dict[str, int]:
    """Target weights between the sources' sizes and equal ones: whole square roots of the counts."""
    return {x: max(1, isqrt(n)) for x, n in counts.items()}


def stated(docs: DataFrame) -> dict[str | None, int]:
    """The registered query's recipe: a source weighs 1 + (first four hex digits of its name's MD5) modulo RECIPE,
    so targets differ between sources of one size and do not depend on the table."""
    names = [r["source"] for r in docs.select("source").distinct().collect()]  # one row a source
    return {x: 1 + int(md5((x or "").encode()).hexdigest()[:4], 16) % RECIPE for x in names}


def _key(name: str | None) -> str:
    """A source's name inside: null apart from every name, one that is U+0000 too."""
    return _NULL if name is None else _NULL + name if name.startswith(_NULL) else name


def _source() -> Column:
    source = F.col("source")
    return F.when(source.isNull(), F.lit(_NULL)).when(source.startswith(_NULL), F.concat(F.lit(_NULL), source)).otherwise(source)


def placed(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = BLOCK, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """weights by source name, None for null. row (a struct of docs' columns, or of those to keep), source_key, block, place (in the block), slot, release,
    deadline, mixed."""
    spark = docs.sparkSession
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")
    sizes = {r["s"]: r["n"] for r in docs.groupBy(_source().alias("s")).agg(F.count("*").alias("n")).collect()}  # one row a source
    given = tempered(sizes) if weights is None else {_key(x): w for x, w in weights.items()}
    whole = reduced({x: given.get(x, 0) for x in sizes})
    period = sum(whole.values())
    blocks = {x: -(-n // block) for x, n in sizes.items()}
    # the first block that a source lacks is due by this slot, so the mix ends before it
    ends = min((-(-(blocks[x] + 1) * period // w) for x, w in whole.items()), default=0)
    where = schedule(whole, ends)
    full = ends >= period
    horizon = min((blocks[x] // w * period + where[x][blocks[x] % w] for x, w in whole.items() if full or blocks[x] < len(where[x])), default=0)
    behind = max((-(-blocks[x] // w) for x, w in whole.items()), default=0) * period  # past every slot of the schedule
    rank_bits = max(0, -(-max(sizes.values(), default=0) // _GROUP) - 1).bit_length()
    rows = docs.select(F.struct(*keep).alias("row"), _source().alias("source_key"), key.alias("key"), "doc_id", F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("range", F.shiftrightunsigned("key", _BITS - rank_bits))
    counts = rows.groupBy("source_key", "range").agg(F.count("*").alias("n"))
    ahead = counts.select("source_key", "range", (F.sum("n").over(Window.partitionBy("source_key").orderBy("range")) - F.col("n")).alias("ahead"))
    ordered = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "tie")
    ranked = rows.withColumn("rank", F.row_number().over(ordered)).join(ahead, ["source_key", "range"]).withColumn("rank", F.col("ahead") + F.col("rank") - 1)
    ranked = ranked.select("row", "source_key", F.expr(f"rank div {block}").alias("block"), (F.col("rank") % block).cast("int").alias("place"))
    plan = spark.createDataFrame([(x, i, whole.get(x), where.get(x, [])) for i, x in enumerate(sorted(sizes))], "source_key string, nth long, w long, slots array<long>")
    if sum(map(len, where.values())) <= BROADCAST_SLOTS:
        ranked = ranked.join(F.broadcast(plan), "source_key")
        at = F.get("slots", F.expr("block % w").cast("int"))
    else:  # the same lookup as a join of single slots
        each = plan.select("source_key", F.posexplode("slots").alias("turn", "at"))
        ranked = ranked.join(F.broadcast(plan.drop("slots")), "source_key").withColumn("turn", F.expr("block % w")).join(each, ["source_key", "turn"], "left")
        at = F.col("at")
    in_plan = at.isNotNull() if full else at.isNotNull() & (F.col("block") < F.col("w"))
    slot = F.when(in_plan, F.expr("block div w") * period + at).otherwise(F.lit(behind) + F.col("block") * len(sizes) + F.col("nth")).cast("long")
    return ranked.select(
        "row", "source_key", "block", "place", slot.alias("slot"), F.expr(f"block * {period}L div w").alias("release"), F.expr(f"((block + 1) * {period}L + w - 1) div w").alias("deadline"),
        (in_plan & (slot < horizon)).alias("mixed"),
    )


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, block, place, slot, release, deadline, mixed for every row of docs."""
    return placed(docs, weights, block, ("doc_id", "source")).select("row.doc_id", "row.source", "block", "place", "slot", "release", "deadline", "mixed")


def in_order(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows and columns of docs, sorted by slot: written files hold the mix in reading order."""
    return placed(docs, weights, block).orderBy("slot", "source_key", "place").select("row.*")


def oracle(source: str, block: int = BLOCK) -> str:
    """mix over a table with the stated weights in SQL, the schedule by recursion over the slots of a period."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, chr(1)) AS s, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {_BITS // 4}))::BIGINT AS key, text FROM {source}
), c AS (
  SELECT s, count(*) AS n, 1 + ('0x' || substr(md5(coalesce(any_value(source), '')), 1, 4))::BIGINT % {RECIPE} AS w FROM d GROUP BY s
), f AS (
  SELECT s, n, w // (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) FROM c) AS w, row_number() OVER (ORDER BY s) AS i FROM c
), l AS (
  SELECT list(w ORDER BY i) AS ws, sum(w)::BIGINT AS total, min((((n + {block} - 1) // {block} + 1) * (SELECT sum(w)::BIGINT FROM f) + w - 1) // w)::BIGINT AS ends,
         max(((n + {block} - 1) // {block} + w - 1) // w)::BIGINT * sum(w)::BIGINT AS behind, count(*) AS sources FROM f
), e AS (
  SELECT -1 AS t, list_transform(ws, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, 0::BIGINT AS idx, ws, total FROM l WHERE len(ws) > 0
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, done[p], ws, total
  FROM (
    SELECT t, done, ws, total, list_min(list_transform(ws, lambda w, i: CASE WHEN done[i] * total // w <= t + 1
             THEN (((done[i] + 1) * total + w - 1) // w) * 10000 + i ELSE 1000000000000000 END)) % 10000 AS p FROM e WHERE t < least(total, (SELECT ends FROM l)) - 1
  )
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY s ORDER BY key, doc_id, text) - 1 AS rank FROM d
), z AS (
  SELECT r.doc_id, r.source, r.rank // {block} AS block, (r.rank % {block})::INT AS place, f.w, f.i FROM r JOIN f USING (s)
), y AS (
  SELECT min((((n + {block} - 1) // {block}) // w) * total + e.t) AS horizon FROM f JOIN e ON e.pick = f.i AND e.idx = ((n + {block} - 1) // {block}) % w
  WHERE (SELECT ends >= total FROM l) OR (n + {block} - 1) // {block} < w
), p AS (
  SELECT z.*, CASE WHEN l.ends >= l.total OR z.block < z.w THEN (z.block // z.w) * l.total + e.t END AS own, l.total, l.behind, l.sources
  FROM z CROSS JOIN l LEFT JOIN e ON e.pick = z.i AND e.idx = z.block % z.w
)
SELECT doc_id, source, block, place, coalesce(own, behind + block * sources + i - 1)::BIGINT AS slot, (block * total) // w AS release,
       ((block + 1) * total + w - 1) // w AS deadline, coalesce(own < horizon, false) AS mixed
FROM p, y
"""
