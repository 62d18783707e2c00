"""Benchmark decontamination: SimHash of item-sized windows, Hamming multi-index, exact similarity.

A document leaks an item if some window of as many words as the item has a weighted Jaccard
similarity of SIMILAR or more with it, over shingles of WIDTH words weighted by multiplicity
(an item of fewer words is one shingle; a document shorter than the item is one window).

1. A window and an item of a and b shingles that are so similar share at least 3 (a + b) / 7 of them.
   The shingle lookup, a hash join against the benchmark without a shuffle, gives the places of a
   document's shingles that items of one size hold; every start whose window has that many of them
   is kept, in whatever order they stand there. This bound loses no window.
2. Each such window gets a 64-bit SimHash. Two fingerprints within RADIUS bits differ by at most
   RADIUS div BLOCKS bits in one of BLOCKS blocks, so the index holds, for every item and block, all
   values that near; a window looks up its blocks among items of its size and finds every
   fingerprint within RADIUS.
3. The exact similarity decides.

A fingerprint is a sketch: at similarity 0.75 bits differ with probability 0.17, so about 2 in 10**7
such windows lie past RADIUS. `exact=True` pairs windows with items by their shared shingles instead
and loses none.

Everything is DataFrame functions. The benchmark's tables and the starts are broadcast only up to
BROADCAST_BYTES each (measured first); above that the same joins shuffle. The lookup shuffles places
of shared shingles, not texts; the texts of documents with starts are read once more.

Null or empty text leaks nothing; null or empty items are never leaked. Documents that repeat a
doc_id are told apart by their text. An empty table or benchmark: nothing leaks. Extra columns of
docs stay in `clean`, whatever their names. Ties do not arise: each leak is decided on its own. Very
long texts: a task holds one document's shingles and the windows that reach the bound.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTH, SIMILAR = 5, 0.75
BITS, BLOCKS, RADIUS = 64, 8, 27
BROADCAST_BYTES = 64 << 20
_SIZE = BITS // BLOCKS
_GAP = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """64-bit hashes of the text's words, in order."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, width: int) -> Column:
    """Hashes of the width-word shingles of an array of word hashes, in order; one of the whole array
    if it is shorter; none if it is empty. Words are looked up by place: slices would copy the array."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, width)]))
    return F.slice(each, 1, F.greatest(F.lit(1), F.size(words) - width + 1))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the hashes, with multiplicity, have it."""
    def code(lane: int) -> Column:
        """Bits b, b + lane, ... are counted together, in lanes of that many bits of one number."""
        ones, out = sum(1 << i for i in range(0, BITS, lane)), F.lit(0).cast("long")
        for b in range(lane):
            sums = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, b).bitwiseAND(F.lit(ones)))
            more = F.transform(F.array(*[F.lit(i) for i in range(0, BITS, lane)]), lambda i: F.struct(i.alias("i"), F.lit(b).alias("b")))
            # one pass over the lanes of sums
            pack = F.aggregate(F.transform(F.array(sums), lambda v: F.aggregate(more, F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(
                F.when(F.call_function("shiftright", v, m["i"]).bitwiseAND(F.lit((1 << lane) - 1)) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), m["i"] + m["b"])).otherwise(F.lit(0).cast("long"))))),
                F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
            out = out.bitwiseOR(pack)
        return out

    return F.when(F.size(hashes) < 1 << 16, code(16)).otherwise(code(32))


def _block(code: Column, j: int) -> Column:
    return F.shiftrightunsigned(code, j * _SIZE).bitwiseAND(F.lit((1 << _SIZE) - 1)).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle arrays, weights being multiplicities."""
    both = F.array_intersect(a, b)
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    weighed = F.aggregate(both, F.lit(0), lambda t, s: t + F.least(count(a, s), count(b, s)))
    shared = F.when(plain, F.size(both)).otherwise(weighed)
    return shared / (F.size(a) + F.size(b) - shared)


def _sized(df: DataFrame, row: Column | int) -> DataFrame:
    """df to be broadcast if its rows, of about `row` bytes each, are few enough in all."""
    total = df.agg(F.sum(F.lit(row) if isinstance(row, int) else row)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _starts(places: Column, m: Column, n: Column) -> Column:
    """Starts of the windows of n words, in a document of m, with enough of the ascending places to
    reach SIMILAR. With `need` places wanted, the window that begins at s has places i to i + need - 1
    if s is from place[i + need - 1] - (its last shingle's offset) to place[i]; past place[i - 1], so
    that each start comes once."""
    width = F.least(n, F.lit(WIDTH))
    inside = F.greatest(F.lit(1), F.least(n, m) - width + 1)
    need = F.ceil((n - width + 1 + inside) * F.lit(3) / F.lit(7)).cast("int")
    last = F.greatest(F.lit(0), m - n)

    def begun(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.get(places, i + need - 1) - inside + 1, F.when(i > 0, F.get(places, i - 1) + 1).otherwise(F.lit(0)))
        high = F.least(F.get(places, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<int>")
    return F.when(F.size(places) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - need), begun))).otherwise(none)


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, start, window (shingles), code of every window of an item's size that
    shares enough shingles with items of that size to reach SIMILAR."""
    lookup = items.select(F.least("n", F.lit(WIDTH)).alias("width"), "n", F.explode("item").alias("shingle")).distinct()
    widths = sorted(r["width"] for r in lookup.select("width").distinct().collect())  # 1 to WIDTH
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
    lookup, hits = _sized(lookup, 40), None
    for width in widths or [WIDTH]:
        # only numbers stand beside a shingle: a document's words are not copied to each of its rows
        sets = text.select("doc_id", "text_hash", F.size("words").alias("m"), _shingles(F.col("words"), width).alias("s"))
        # outer, as else the optimiser filters by the array's size first and splits the text once a word
        rows = sets.select("doc_id", "text_hash", "m", F.posexplode_outer("s").alias("at", "shingle"))
        found = rows.join(lookup.where(F.col("width") == width), "shingle").select("doc_id", "text_hash", "m", "n", "at")
        hits = found if hits is None else hits.unionByName(found)
    places = hits.groupBy("doc_id", "text_hash", "m", "n").agg(F.sort_array(F.collect_set("at")).alias("places"))
    starts = cut(places.select("doc_id", "text_hash", "n", _starts(F.col("places"), F.col("m"), F.col("n")).alias("starts")).where(F.size("starts") > 0))
    a = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").alias("a")
    b = _sized(starts, F.lit(64) + 8 * F.size("starts")).alias("b")
    laid = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")))
    width = F.least("n", F.lit(WIDTH))
    laid = laid.select("a.doc_id", "a.text_hash", "n", "starts", _words(F.col("text")).alias("words"))
    shingles = F.coalesce(*[F.when(width == k, _shingles(F.col("words"), k)) for k in widths or [WIDTH]])
    laid = laid.select("doc_id", "text_hash", "n", "starts", F.greatest(F.lit(1), F.least("n", F.size("words")) - width + 1).alias("inside"), shingles.alias("s"))
    each = F.transform("starts", lambda x: F.struct(x.alias("start"), F.slice("s", x + 1, F.col("inside")).alias("window")))
    laid = laid.select("doc_id", "text_hash", "n", F.explode_outer(each).alias("w")).select("doc_id", "text_hash", "n", "w.start", "w.window")
    return laid.withColumn("code", simhash(F.col("window")))


def _near(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of windows and items (by key) of one size whose fingerprints are within RADIUS bits."""
    near = RADIUS // BLOCKS
    masks = [sum(1 << b for b in bits) for k in range(near + 1) for bits in combinations(range(_SIZE), k)]
    index = items.select("key", "n", F.col("code").alias("item_code"), F.explode(F.array(*[F.struct(F.lit(j).alias("block"), _block(F.col("code"), j).alias("base")) for j in range(BLOCKS)])).alias("b"))
    index = index.select("key", "n", "item_code", F.col("b.block").alias("block"), F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("b.base").bitwiseXOR(m))).alias("value"))
    probes = windows.select("*", F.explode(F.array(*[F.struct(F.lit(j).alias("block"), _block(F.col("code"), j).alias("value")) for j in range(BLOCKS)])).alias("p"))
    probes = probes.select("doc_id", "text_hash", "n", "start", "window", "code", "p.block", "p.value")
    apart = F.col("code").bitwiseXOR(F.col("item_code"))
    # of the blocks in which a pair is near, only the first one counts
    first = F.coalesce(*[F.when(F.bit_count(_block(apart, j)) <= near, F.lit(j)) for j in range(BLOCKS)])
    return probes.join(_sized(index, 56), ["n", "block", "value"]).where((F.bit_count(apart) <= RADIUS) & (F.col("block") == first))


def _sharing(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of windows and items (by key) of one size that share a shingle."""
    lookup = items.select("key", "n", F.explode(F.array_distinct("item")).alias("shingle"))
    rows = windows.select("*", F.explode(F.array_distinct("window")).alias("shingle"))
    return rows.join(_sized(lookup, 48), ["n", "shingle"]).dropDuplicates(["doc_id", "text_hash", "n", "start", "key"])


def leaks(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, text_hash, item_id, start (word), similarity of every leaking window; exact: without
    fingerprints."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).select("item_id", F.size("words").alias("n"), _shingles(F.col("words"), WIDTH).alias("item")).where("n > 0")
    items = items.withColumn("key", F.xxhash64("item_id", "item", "n")).dropDuplicates(["key"])
    items = cut(cut(items).withColumn("code", simhash(F.col("item"))))  # shingles are not computed anew for each bit
    windows = _windows(docs, items)
    pairs = (_sharing if exact else _near)(windows if exact else cut(windows), items).select("doc_id", "text_hash", "start", "window", "key")
    full = pairs.join(_sized(items.select("key", "item_id", "item"), F.lit(64) + 8 * F.size("item")), "key")
    return full.select("doc_id", "text_hash", "item_id", "start", similarity(F.col("window"), F.col("item")).alias("similarity")).where(F.col("similarity") >= SIMILAR)


def by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items (the leaked items' ids, ascending, comma-joined), n_items, similarity (the best)
    per row of docs."""
    found = leaks(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    a, b = rows.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return joined.select("a.doc_id", F.array_join(items.cast("array<string>"), ",").alias("items"), F.size(items).cast("long").alias("n_items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, with their own columns."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("id"), "text_hash").distinct().alias("found")
    rows = docs.alias("rows")
    kept = rows.join(found, F.col("rows.doc_id").eqNullSafe(F.col("found.id")) & (F.xxhash64("rows.text") == F.col("found.text_hash")), "left_anti")
    return kept.select("rows.*")


def oracle(source: str, benchmark: str = "benchmark") -> str:
    """by_document in SQL: every window that holds a shared shingle, compared exactly."""
    cut = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    shingle = "CASE WHEN len({0}) = 0 THEN [] ELSE list_transform(range(greatest(1, len({0}) - 4)), lambda i: {0}[i + 1 : i + 5]) END"
    return f"""
WITH i AS (
  SELECT item_id, w, len(w) AS n, {shingle.format('w')} AS s FROM (SELECT item_id, {cut} AS w FROM {benchmark})
), p AS (
  SELECT item_id, n, u.s AS s, u.at AS place FROM i, LATERAL (SELECT unnest(i.s) AS s, unnest(range(len(i.s))) AS at) u
), d AS (
  SELECT doc_id, w, len(w) AS m, {shingle.format('w')} AS s FROM (SELECT doc_id, {cut} AS w FROM {source})
), e AS (
  SELECT doc_id, m, u.s AS s, u.at AS at FROM d, LATERAL (SELECT unnest(d.s) AS s, unnest(range(len(d.s))) AS at) u
), h AS (
  SELECT DISTINCT e.doc_id, p.item_id, unnest(range(greatest(0, e.at - p.n + 1), least(e.at, greatest(0, e.m - p.n)) + 1)) AS start FROM e JOIN p USING (s)
), v AS (
  SELECT h.doc_id, h.item_id, i.s AS a, {shingle.format('x')} AS b FROM (SELECT h.*, d.w[h.start + 1 : h.start + i.n] AS x FROM h JOIN d USING (doc_id) JOIN i USING (item_id)) h JOIN i USING (item_id)
), q AS (
  SELECT doc_id, item_id, len(a) + len(b) AS n_all, list_sum(list_transform(list_distinct(a), lambda z: least(len(list_filter(a, lambda y: y = z)), len(list_filter(b, lambda y: y = z))))) AS shared FROM v
), r AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, max(shared / (n_all - shared)) AS similarity FROM q WHERE shared / (n_all - shared) >= {SIMILAR} GROUP BY doc_id
)
SELECT doc_id, array_to_string(coalesce(items, []), ',') AS items, len(coalesce(items, [])) AS n_items, coalesce(similarity, 0.0) AS similarity FROM d LEFT JOIN r USING (doc_id)
"""
