"""N-gram Jaccard self-join by count vectors in R-trees; exact.

A document's set holds its distinct WIDTH-word shingles (hashes). Documents link when
100 |A and B| >= 75 |A or B|, that is 7 |A and B| >= 3 (|A| + |B|). Documents with equal sets form
one class, so copies cost one row each and are never paired.

Shingles are hashed into groups, at least twice as many as the set has members up to 2**11 of them,
and over half as many in longer sets, whose points would be large; a class is the point of its
counts per group. (Numbers of groups are powers of two, so the finer of two points folds onto
the coarser one's groups.) The overlap of two classes is at most the sum of the minima of their
coordinates, and over an R-tree node's box the minima with the box's upper corner bound all points
inside.

1. Linked sets share one of their first n - ceil(0.75 n) + 1 shingles in any fixed order; rare
   shingles come first, judged by 2**22 counters of hash buckets over all documents (a fixed size;
   the order decides how much work is done, never what is found). Spark deals classes out by those
   shingles; a shingle that one class alone has ends here. A shingle whose counter exceeds SPLIT is
   dealt out in parts, which are joined again by their smallest class.
2. Shingles with the same smallest class, their hub, make one bucket, and every bucket's points go into
   an R-tree, tile by tile (each with the hub). First round: the tree gives each point the one
   earlier point whose bound leaves most room; those pairs are verified on the whole sets. So groups
   of near copies, however large, become connected with a number of pairs linear in them.
3. Second round: buckets that still hold classes of several components go through R-trees again, and
   all pairs of different components within the bounds are verified. No other link can be missing, since
   links inside a component change nothing; they are not listed. Of a bucket beyond TILE points, those
   of its largest component are dealt out once, the others to each of its tiles.
4. Components over all verified links.

Classes are named by 64-bit hashes of their sets and sizes; a second hash is compared wherever a
class is formed, and two sets with one name fail the job instead of being merged. A document with fewer
words than WIDTH has one shingle of all its words; null, empty or blank text has none, links with
nothing and is its own component. Null doc_id: component null, and no part in links. Rows that
repeat a doc_id and text fall in one class; extra columns are ignored by `join` and kept by
`representatives`, whatever their names; an empty table gives no rows. Very long texts are handled
whole by one task, with some hundred bytes of working memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .kernel import Words, lists, mix, shingles, slices

WIDTH, LEAF = 5, 16
NEAREST_TILE, TILE, SPLIT = 256, 1024, 1 << 16
BROADCAST_KEYS = 1 << 20  # rows, of up to 32 bytes, of a table of keys or buckets that is broadcast
_LEVELS = (5, 18)  # least and most bits of a group's number
_FINE = 11  # up to so many bits, groups outnumber a set's members twice
_COUNTERS, _CHUNK = 22, 1 << 16  # bits of a counter's number; counters sent in a row
_SET, _CHECK = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _name(doc: np.ndarray, value: np.ndarray, n: int, salt: np.uint64 = _SET) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and a 64-bit name of each set that does not depend on order."""
    count = np.bincount(doc, minlength=n)
    ends = np.cumsum(count)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ salt))])
    total = run[ends] - run[ends - count]
    return count, mix(total + count.astype(np.uint64)).view(np.int64)


def levels(n: np.ndarray) -> np.ndarray:
    """Bits of the group numbers for sets of n members."""
    whole = np.ceil(np.log2(np.maximum(n, 1)))
    return np.clip(np.maximum(whole - 1, np.minimum(whole + 1, _FINE)), *_LEVELS).astype(np.int64)


def _counter(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - _COUNTERS)).astype(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: size, class and count vector; after a task's last, its counters in chunks."""
    seen = np.zeros(1 << _COUNTERS, np.uint32)
    names = ["doc_id", "n", "cls", "again", "counts", "chunk", "seen"]
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            doc, value = shingles(Words(data, offsets), WIDTH)
            np.add.at(seen, _counter(value), 1)
            n, cls = _name(doc, value, b - a)
            groups = np.where(n > 0, 1 << levels(n), 0)
            counts = np.bincount((np.cumsum(groups) - groups)[doc] + (value.astype(np.int64) & (groups - 1)[doc]), minlength=groups.sum())
            counts = lists(counts.astype(np.int16), groups, pa.int16())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(cls, mask=n == 0), pa.array(_name(doc, value, b - a, _CHECK)[1]), counts, pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names)
    for i in range(len(seen) // _CHUNK):
        part = seen[i * _CHUNK : (i + 1) * _CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int16())), pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk of those in the partition, holding the sums so far alone."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column("chunk").to_pylist(), batch.column("seen"), strict=True):
            total.setdefault(i, np.zeros(_CHUNK, np.uint64))
            total[i] += np.frombuffer(part.as_buffer(), np.uint32)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["chunk", "seen"])


def _ranks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """16-bit rank of each counter, by rising count, and the numbers of parts (log2) of its keys."""
    parts = rows.where("chunk is not null").select("chunk", "seen").mapInArrow(_summed, "chunk int, seen binary")
    seen = np.zeros(1 << _COUNTERS, np.uint32)
    for r in parts.repartition("chunk").mapInArrow(_summed, "chunk int, seen binary").collect():  # all counters once
        seen[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["seen"], np.uint32)
    rank, bits = np.empty(1 << _COUNTERS, np.uint16), np.empty(1 << _COUNTERS, np.uint8)
    rank[np.argsort(seen, kind="stable")] = np.repeat(np.arange(1 << 16, dtype=np.uint16), 1 << (_COUNTERS - 16))
    for i in range(0, len(seen), _CHUNK):  # piece by piece: the driver's memory is small
        bits[i : i + _CHUNK] = np.ceil(np.log2(np.maximum(seen[i : i + _CHUNK] / SPLIT, 1)))
    return rank, bits


def _prefixes(ranks):
    """(part, key, cls) of each class's first shingles, once a task and class. part is the shingle, or
    one of its parts if it is dealt out in several; key is the shingle then, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (place, bits), done = ranks.value, set()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                doc, value = shingles(Words(data, offsets), WIDTH)
                n, cls = _name(doc, value, b - a)
                fresh = np.zeros(b - a, bool)
                for i in np.flatnonzero(n):
                    if cls[i] not in done:
                        done.add(cls[i])
                        fresh[i] = True
                kept = fresh[doc]
                doc, value = doc[kept], value[kept]
                order = np.lexsort(((place[_counter(value)].astype(np.uint64) << np.uint64(48)) | (value & np.uint64((1 << 48) - 1)), doc))
                doc, value = doc[order], value[order]
                n = np.where(fresh, n, 0)
                at = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                kept = at < (n - -(-3 * n // 4) + 1)[doc]
                key, of = value[kept], cls[doc[kept]]
                split = bits[_counter(key)]
                part = np.where(split > 0, mix(key + (mix(of.view(np.uint64)) & ((np.uint64(1) << split.astype(np.uint64)) - np.uint64(1))) + np.uint64(1)), key)
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(key.view(np.int64), mask=split == 0), pa.array(of)], ["part", "key", "cls"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and class: (key, hub, cls) of each distinct class in parts with two or more,
    or of a key in several parts; the hub is the first. Holds one row between batches, whatever a
    bucket's size."""
    last_part = last_cls = hub = None
    told = True  # whether the hub of the last part has been given out
    for batch in batches:
        part, cls = (np.asarray(batch.column(x)) for x in ("part", "cls"))
        if not len(part):
            continue
        split = np.asarray(batch.column("key").is_valid())
        new = np.concatenate([[part[0] != last_part], part[1:] != part[:-1]])
        again = np.concatenate([[not new[0] and cls[0] == last_cls], ~new[1:] & (cls[1:] == cls[:-1])])
        start = np.where(new, np.arange(len(part)), -1)
        np.maximum.accumulate(start, out=start)
        head = np.where(start < 0, hub if hub is not None else 0, cls[start])
        given = np.flatnonzero(~again & (~new | split))
        group = np.cumsum(new)[given]
        opens = np.ones(len(given), bool)  # a hub is told with its part's first other member
        opens[1:] = group[1:] != group[:-1]
        if len(given) and group[0] == 0 and told:
            opens[0] = False
        h = given[opens & ~new[given]]
        at = np.concatenate([given, h])
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(head[at]), pa.array(np.concatenate([cls[given], head[h]]))], ["key", "hub", "cls"])
        in_last = bool(len(given)) and group[-1] == np.cumsum(new)[-1]
        told = in_last or (told and not new.any())
        last_part, last_cls, hub = part[-1], cls[-1], head[-1]


class Tree:
    """An R-tree over count vectors, built by halving along the most spread coordinate down to leaves of
    LEAF points. A node has the range of its points in `order`, its box's upper corner, the least and
    most size inside, and two children (the second follows the first)."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, points: np.ndarray):
        self.n, self.counts, self.order = n, counts, points.copy()
        spans, child = [(0, len(points))], []
        at = 0
        while at < len(spans):  # nodes in breadth-first order
            s, e = spans[at]
            child.append(0)
            if e - s > LEAF:
                inside = self.order[s:e]
                values = counts[inside]
                by = (values.astype(np.float32) ** 2).mean(axis=0) - values.mean(axis=0, dtype=np.float32) ** 2
                self.order[s:e] = inside[np.lexsort((n[inside], values[:, by.argmax()]))]
                child[at] = len(spans)
                spans += [(s, (s + e) // 2), ((s + e) // 2, e)]
            at += 1
        self.span, self.child = np.array(spans), np.array(child)
        parts = [self.order[s:e] for s, e in spans]
        self.top = np.array([counts[x].max(axis=0) for x in parts])
        self.low, self.high = (np.array([f(n[x]) for x in parts]) for f in (np.min, np.max))

    def pairs(self, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, asking point, room) of all pairs that sizes and coordinate minima allow; room is the
        bound on 7 |A and B| less what a link needs."""
        query, node = asking, np.zeros(len(asking), np.int64)
        found_i, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(query):
            size = self.n[query]
            open_ = (4 * size >= 3 * self.low[node]) & (4 * self.high[node] >= 3 * size)
            query, node, size = query[open_], node[open_], size[open_]
            least = size + np.maximum(self.low[node], -(-3 * size // 4))
            open_ = 7 * _minima(self.counts, query, self.top, node) >= 3 * least
            query, node = query[open_], node[open_]
            leaf = self.child[node] == 0
            for q, x in zip(query[leaf], node[leaf], strict=True):
                inside = self.order[self.span[x, 0] : self.span[x, 1]]
                found_i.append(inside)
                found_q.append(np.full(len(inside), q))
            below = self.child[node[~leaf]]
            query, node = np.repeat(query[~leaf], 2), np.stack([below, below + 1], axis=1).ravel()
        i, q = np.concatenate(found_i), np.concatenate(found_q)
        kept = (4 * np.minimum(self.n[i], self.n[q]) >= 3 * np.maximum(self.n[i], self.n[q])) & (i != q)
        i, q = i[kept], q[kept]
        room = 7 * _minima(self.counts, i, self.counts, q) - 3 * (self.n[i] + self.n[q])
        kept = room >= 0
        return i[kept], q[kept], room[kept]


def _minima(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of rows i of a and j of b, some million coordinates at a time."""
    out = np.zeros(len(i), np.int64)
    size = max(1, (1 << 20) // a.shape[1])
    for s in range(0, len(i), size):
        out[s : s + size] = np.minimum(a[i[s : s + size]], b[j[s : s + size]]).sum(axis=1, dtype=np.int64)
    return out


def _group_pairs(n: np.ndarray, comp: np.ndarray, tile: np.ndarray, level: np.ndarray, values: np.ndarray, first: np.ndarray, nearest: bool, crossing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one bucket (or pair of its tiles), level by level: points of a level meet
    one another and the points of the next finer level, folded. nearest: for each point the earlier one
    with most room, else all of different components; crossing: of two tiles only."""
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for k in np.unique(level):
        rows = np.flatnonzero((level == k) | (level == k + 1))
        own = level[rows] == k
        if len(rows) < 2 or not nearest and comp[rows].min() == comp[rows].max():
            continue
        g = 1 << int(k)
        counts = np.stack([values[f : f + (g << (x - k))].reshape(-1, g).sum(axis=0) for f, x in zip(first[rows], level[rows], strict=True)]).astype(np.int16)
        tree = Tree(n[rows], counts, np.flatnonzero(own))
        i, j, room = tree.pairs(np.arange(len(rows)))
        i, j = rows[i], rows[j]
        kept = (level[j] > k) | (i < j)  # of two points of the level each pair once
        if nearest:
            kept &= i != j
        else:
            kept &= comp[i] != comp[j]
            if crossing:
                kept &= tile[i] != tile[j]
        for o, x in zip(out, (i, j, room), strict=True):
            o.append(x[kept])
    i, j, room = (np.concatenate(x) for x in out)
    if nearest and len(i):
        i, j = np.minimum(i, j), np.maximum(i, j)
        order = np.lexsort((i, -room, j))
        best = order[np.concatenate([[True], j[order][1:] != j[order][:-1]])]
        return i[best], j[best]
    return i, j


def _trees(nearest: bool):
    """Rows sorted by bucket, lo, hi, cls: candidate pairs. Whole groups, about 16k rows at a time."""

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        bucket, lo, hi, tile, cls, comp, n = (np.asarray(t.column(x)) for x in ("bucket", "lo", "hi", "tile", "cls", "comp", "n"))
        counts = t.column("counts").combine_chunks()
        values, first = np.asarray(counts.flatten()), np.asarray(counts.offsets).astype(np.int64)
        first, level = (first - first[0])[:-1], levels(n)
        cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1), len(bucket)]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            i, j = _group_pairs(n[s:e], comp[s:e], tile[s:e], level[s:e], values, first[s:e], nearest, lo[s] != hi[s])
            a.append(cls[s:e][i])
            b.append(cls[s:e][j])
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= 1 << 14:
                here, last = (np.stack([np.asarray(x.column(c)) for c in ("bucket", "lo", "hi")]) for x in (batch, held[-1]))
                turns = np.flatnonzero((here != last[:, -1:]).any(axis=0))
                if len(turns):
                    held.append(batch.slice(0, turns[0]))
                    yield from out(held)
                    held, rows, batch = [], 0, batch.slice(turns[0])
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield from out(held)

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets link."""
    for batch in batches:
        size = max(1, min(batch.num_rows, 256))
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            m = part.num_rows
            found = []
            for side in ("text_a", "text_b"):
                doc, value = [], []
                for s, _, data, offsets in slices(part.column(side)):
                    d, v = shingles(Words(data, offsets), WIDTH)
                    doc.append(d + s)
                    value.append(v)
                found.append((np.concatenate(doc), np.concatenate(value)))
            n = [np.bincount(d, minlength=m) for d, _ in found]
            doc, value = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            same = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
            shared = np.bincount(doc[1:][same], minlength=m)
            yield part.select(["a", "b"]).filter(pa.array(7 * shared >= 3 * (n[0] + n[1])))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by the sets of one document each."""
    pairs = cut(pairs)
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    whose = needed.join(classes.select("cls", "doc_id"), "cls")
    texts = cut(docs.select("doc_id", "text").join(whose, "doc_id").mapInArrow(_own, "cls long, text string"))
    with_a = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(with_b.select("a", "b", "text_a", "text_b").mapInArrow(_overlaps, "a long, b long").distinct())


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that are of the class they were fetched for (a repeated doc_id may have others)."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            doc, value = shingles(Words(data, offsets), WIDTH)
            _, cls = _name(doc, value, b - a)
            part = batch.slice(a, b - a)
            yield part.select(["cls", "text"]).filter(pa.array(cls == np.asarray(part.column("cls"))))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows = cut(docs.select("doc_id", "text").mapInArrow(_signatures, "doc_id long, n long, cls long, again long, counts array<short>, chunk int, seen binary"))
    known = rows.where("n > 0 and doc_id is not null")
    one = F.when((F.min("again") == F.max("again")) & (F.min("n") == F.max("n")), F.first("n")).otherwise(F.raise_error(F.lit("two sets have one name")).cast("long"))
    classes = cut(known.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), one.alias("n"), F.first("counts").alias("counts")))
    members = _members(docs, rows)
    links = _verified(_nearest(members, classes), classes, docs)
    labels = components(links)
    more = _verified(_residual(members, labels, classes), classes, docs)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    lowest = cut(labels.withColumnRenamed("node", "cls").join(classes.select("cls", "doc_id"), "cls").groupBy("label").agg(F.min("doc_id").alias("low")))
    of = cut(labels.withColumnRenamed("node", "cls").join(lowest, "label").select("cls", "low"))
    single = classes.select("cls", F.col("doc_id").alias("own"))
    per_class = cut(single.join(of, "cls", "left").select("cls", F.coalesce("low", "own").alias("component_id")))
    linked = known.select("doc_id", "n", "cls").join(per_class, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = rows.where("n >= 0 and (n = 0 or doc_id is null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest)


def _members(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """hub, cls: each bucket's classes, its smallest one among them."""
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(rows))  # 12 MB, whatever the input
    postings = docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(ranks), "part long, key long, cls long")
    shared = cut(postings.repartition("part").sortWithinPartitions("part", "cls").mapInArrow(_buckets, "key long, hub long, cls long"))
    parted = shared.where("key is not null")
    hubs = _few(parted.groupBy("key").agg(F.min("hub").alias("least")))
    whole = shared.where("key is null").select("hub", "cls").unionByName(parted.join(hubs, "key").select(F.col("least").alias("hub"), "cls")).distinct()
    return cut(whole)


def _few(df: DataFrame) -> DataFrame:
    """df, of rows of up to 32 bytes, to be broadcast if it has at most BROADCAST_KEYS of them."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _searched(points: DataFrame, nearest: bool) -> DataFrame:
    """points: bucket, lo, hi, tile, cls, comp, n, counts."""
    return points.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "cls").mapInArrow(_trees(nearest), "a long, b long").distinct()


def _nearest(members: DataFrame, classes: DataFrame) -> DataFrame:
    """For each point of a bucket's tile the earlier one with most room."""
    large = members.groupBy("hub").agg(F.count("*").alias("size")).where(F.col("size") > NEAREST_TILE).select("hub", F.ceil(F.col("size") / NEAREST_TILE).cast("int").alias("tiles"))
    tiled = members.join(_few(large), "hub", "left").fillna(1, ["tiles"])
    own = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    # the hub is in every tile
    at = tiled.select(F.col("hub").alias("bucket"), "cls", F.explode(F.when(F.col("hub") == F.col("cls"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(own))).alias("tile"))
    points = at.join(classes.select("cls", "n", "counts"), "cls")
    return _searched(points.select("bucket", F.col("tile").alias("lo"), F.col("tile").alias("hi"), "tile", "cls", F.col("cls").alias("comp"), "n", "counts"), True)


def _residual(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs of classes of different components that share a bucket."""
    comp = labels.select(F.col("node").alias("cls"), "label")
    left = cut(members.join(comp, "cls", "left").select(F.col("hub").alias("bucket"), "cls", F.coalesce("label", "cls").alias("comp")))
    each = left.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    size = each.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    here = left.join(_few(size.select("bucket", "size", F.col("top.comp").alias("major"), F.col("top.n").alias("most"))), "bucket")
    large, inside = F.col("size") > TILE, F.col("comp") == F.col("major")
    of = lambda n: F.ceil(n / TILE).cast("int")
    majors, minors = of(F.col("most")), of(F.col("size") - F.col("most"))
    own = lambda tiles: F.pmod(F.xxhash64("cls"), tiles).cast("int")
    place = lambda lo, hi, tile: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), tile.cast("int").alias("tile"))
    # lo and hi below 0: a tile of the largest component (tile 0) with all others (tile 1)
    met = F.transform(F.sequence(F.lit(1), majors), lambda m: place(-2 * m, -2 * m - 1, F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), minors - 1), lambda m: place(F.least(own(minors), m), F.greatest(own(minors), m), own(minors)))
    places = (
        F.when(~large, F.array(place(F.lit(0), F.lit(0), F.lit(0)))).when(inside, F.array(place(-2 * (own(majors) + 1), -2 * (own(majors) + 1) - 1, F.lit(0)))).otherwise(F.concat(met, among))
    )
    points = here.select("bucket", "cls", "comp", F.explode(places).alias("at")).select("bucket", "at.lo", "at.hi", "at.tile", "cls", "comp").join(classes.select("cls", "n", "counts"), "cls")
    return _searched(points.select("bucket", "lo", "hi", "tile", "cls", "comp", "n", "counts"), False)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, with their own columns.
    Rows that repeat a doc_id share its fate; rows with null doc_id stay."""
    keep = join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct().alias("keep")
    kept = docs.alias("rows").join(keep, F.col("rows.doc_id") == F.col("keep.id"), "left_semi")
    return kept.select("rows.*").unionByName(docs.where("doc_id is null"))


def oracle(source: str) -> str:
    """join in SQL: all pairs that share a shingle, counted exactly, and their reachability."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM d
), c AS (
  SELECT min(doc_id) AS cls, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s
), e AS (
  SELECT cls, len(s) AS n, unnest(s) AS x FROM c
), f AS (
  SELECT x FROM e GROUP BY x HAVING count(*) > 1
), p AS (
  SELECT a.cls AS a, b.cls AS b FROM (SELECT * FROM e JOIN f USING (x)) a JOIN e b ON a.x = b.x AND a.cls < b.cls AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), l AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT cls AS node, cls AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node AND l.b > r.root
), m AS (
  SELECT node, min(root) AS root FROM r GROUP BY node
), k AS (
  SELECT s.doc_id, c.cls FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) s JOIN c USING (s)
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.root, s.doc_id) AS component_id FROM s LEFT JOIN k USING (doc_id) LEFT JOIN m ON m.node = k.cls
"""
