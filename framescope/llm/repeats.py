"""Exact removal of repeated byte strings by a sampled enhanced suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts in a document of smaller doc_id.

Every LENGTH-byte string holds an anchor: the leftmost least hash (of 32 bits) among its GRAM-byte strings, a
choice that depends on its bytes alone, so equal strings have equal anchors at equal places. Each
anchor's *context* is all bytes of its document that a LENGTH-byte string around it can reach.

1. Documents with equal contexts form a class: all but the class's smallest document lose the whole
   context. Tasks settle that among their own FLUSH anchors before anything moves, so a copied
   document costs a row a task; then anchors are dealt out by hash. An anchor with more than SPREAD
   contexts among those FLUSH (it has over SPREAD / FLUSH of all rows) is dealt out by context
   instead, with a mark to its own place. Anchors of one document end here.
2. Where an anchor has several classes, one context of each is fetched. Sorted by what follows the
   anchor they are a suffix array sampled at anchors; its longest-common-prefix array is scanned with
   a stack into the tree of common-prefix intervals. For each interval and each left extension that
   its depth leaves to reach LENGTH, members are parted by the bytes before the anchor (the left
   diversity test); each part is a repeat with all its occurrences, and all but the smallest
   document's lose it.
   (A class found in several places has a context in each, and the same test parts their documents.)
3. Anchors with more than HOT classes (the edges of a passage that very many documents share) do not
   go to one task: their strings are dealt out singly, minima combined before the shuffle.
4. A last pass over the texts marks and cuts the bytes.

Null text is empty. Null doc_id is neither smaller nor larger than any other: such rows stay whole.
Rows that repeat a doc_id do not affect one another. Extra columns are ignored. Texts of fewer than
LENGTH bytes stay whole. A very long text is handled by one task, with some tens of bytes of working
memory for each of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .kernel import _tables, grams, mix, slices

LENGTH, GRAM, HOT = 50, 16, 16384
FLUSH, SPREAD = 1 << 18, 32
BROADCAST_KEYS = 1 << 20  # anchors of more than HOT classes that are broadcast, 17 bytes each
_PLACE = np.uint64((1 << 32) - 1)
_PLAIN, _SPREAD, _MARK, _FULL = range(4)
_FIRST = -(1 << 63)  # the context of a mark: it sorts first


class Anchors:
    """Anchors of a slice: position, document, hash, reach to either side, hash of the context."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        wide = LENGTH - GRAM + 1
        value = grams(data, GRAM)
        size = np.diff(offsets)
        if len(value) < wide or (size < LENGTH).all():
            self.at = np.zeros(0, np.int64)
        else:
            # leftmost minimum of `wide` grams from each position, by doubling; a number is hash, then place
            low, span = (value & ~_PLACE) | np.arange(len(value), dtype=np.uint64), 1
            while span < wide:
                step = min(span, wide - span)
                low = np.minimum(low[: len(low) - step], low[step:])
                span += step
            where = (low & _PLACE).astype(np.int64)
            whole = np.zeros(len(where) + 1, np.int64)
            for a, n in zip(offsets[:-1], size, strict=True):
                if n >= LENGTH:
                    whole[a] += 1
                    whole[a + n - LENGTH + 1] -= 1
            where = where[np.cumsum(whole[:-1]) > 0]  # leftmost minima never move back
            self.at = where[np.concatenate([np.ones(min(1, len(where)), bool), where[1:] != where[:-1]])].astype(np.int64)
        self.doc = np.searchsorted(offsets, self.at, "right") - 1
        self.key = value[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.left = np.minimum(self.at - offsets[self.doc], LENGTH - GRAM)
        self.right = np.minimum(offsets[self.doc + 1] - self.at, LENGTH)
        self.context = self.span(self.at - self.left, self.at + self.right) if len(self.at) else self.key
        self.context = mix(self.context + self.left.astype(np.uint64))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not hasattr(self, "total"):
            self.powers, self.inverse = _tables(len(self.data) + 1)
            self.total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(self.data)], out=self.total[1:])
        return mix((self.total[end] - self.total[start]) * self.inverse[start])


def combined(key: np.ndarray, context: np.ndarray, doc: np.ndarray, spread: int) -> tuple[np.ndarray, ...]:
    """(key, context, doc, kind) of some anchors: the smallest document of each context, spread out
    where its key has more than `spread` of them; marks of such keys; and, as full, all other documents."""
    order = np.argsort(context, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = context[order][1:] != context[order][:-1]
    many = np.flatnonzero(~new | np.append(~new[1:], False))  # only contexts met again need their documents in order
    order[many] = order[many][np.lexsort((doc[order[many]], context[order[many]]))]
    key, context, doc = key[order], context[order], doc[order]
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc
    again = np.zeros(len(order), bool)
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1])
    full = ~new & ~again & (doc > least)
    kind = np.where(full, _FULL, _PLAIN).astype(np.int8)
    bucket = (key[new].view(np.uint64) >> np.uint64(44)).astype(np.int64)  # 2**20 counters find the few keys worth a look
    many = np.flatnonzero(new)[np.bincount(bucket, minlength=1 << 20)[bucket] > spread]
    value, place, n = np.unique(key[many], return_inverse=True, return_counts=True)
    kind[many[n[place] > spread]] = _SPREAD
    marks = value[n > spread]
    kept = new | full
    pad = lambda v, dtype: np.full(len(marks), v, dtype)
    return tuple(np.concatenate(x) for x in ((key[kept], marks), (context[kept], pad(_FIRST, np.int64)), (doc[kept], pad(0, np.int64)), (kind[kept], pad(_MARK, np.int8))))


def _anchors(flush: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            parts = combined(*(np.concatenate(x) for x in zip(*held, strict=True)), spread)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["key", "context", "doc_id", "kind"])

        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for a, _, data, offsets in slices(batch.column("text")):
                x = Anchors(data, offsets)
                held.append((x.key.view(np.int64), x.context.view(np.int64), ids[x.doc + a].astype(np.int64)))
                size += len(x.key)
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, context and document: those that lose their context (full), and the first
    row of each class where a key has several, is marked or is spread. Holds one row of a key,
    whatever its size."""
    last = (None, None, None)
    head, several = None, False
    names = ["key", "context", "doc_id", "full"]
    for batch in batches:
        known = np.asarray(batch.column("kind")) == _FULL
        if known.any():
            part = batch.filter(pa.array(known)).select(names[:3])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.ones(part.num_rows, bool))], names)
            batch = batch.filter(pa.array(~known))
        key, context, doc, kind = (np.asarray(batch.column(x)) for x in ("key", "context", "doc_id", "kind"))
        n = len(key)
        if not n:
            continue
        new = np.concatenate([[key[0] != last[0]], key[1:] != key[:-1]])
        fresh = new | np.concatenate([[context[0] != last[1]], context[1:] != context[:-1]])
        again = ~fresh & np.concatenate([[doc[0] == last[2]], doc[1:] == doc[:-1]])
        full = np.flatnonzero(~fresh & ~again & (context != _FIRST))
        spread = kind == _SPREAD
        second = np.flatnonzero(fresh & (~new | spread))
        group = np.cumsum(new)
        opens = np.ones(len(second), bool)
        opens[1:] = group[second[1:]] != group[second[:-1]]
        if len(second) and group[second[0]] == 0 and several:
            opens[0] = False
        start = np.where(new, np.arange(n), -1)
        np.maximum.accumulate(start, out=start)
        begins = second[opens]
        heads = start[begins[~new[begins]]]  # a spread head tells itself
        k, c, d = ([*x[second], *[h[j] if i < 0 else x[i] for i in heads]] for j, (x, h) in enumerate(((key, head or (0,) * 3), (context, head or (0,) * 3), (doc, head or (0,) * 3))))
        k, c, d = (np.array(x, np.int64) for x in (k, c, d))
        real = c != _FIRST
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([key[full], k[real]])), pa.array(np.concatenate([context[full], c[real]])), pa.array(np.concatenate([doc[full], d[real]])), pa.array(np.arange(len(full) + real.sum()) < len(full))], names)
        inside = len(second) and group[second[-1]] == group[-1]
        several = bool(inside) or (several and not new.any())
        if new.any():
            i = start[-1]
            head = (key[i], context[i], doc[i])
        last = (key[-1], context[-1], doc[-1])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts asked for (some), or the single strings of those asked for (hot)."""
    names = ["key", "context", "doc_id", "back", "string", "left", "right"]
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        for a, b, data, offsets in slices(batch.column("text")):
            x = Anchors(data, offsets)
            context = x.context.view(np.int64)
            for column, hot in (("some", False), ("hot", True)):
                asked = batch.column(column).slice(a, b - a)
                at = _member(x.doc, context, asked)
                at = at[np.unique(mix(context[at].view(np.uint64) + mix(x.doc[at].astype(np.uint64))), return_index=True)[1]]  # once a document
                if not len(at):
                    continue
                if hot:
                    back = np.arange(LENGTH - GRAM + 1)
                    i, back = (y.ravel() for y in np.meshgrid(at, back, indexing="ij"))
                    fits = (back <= x.left[i]) & (LENGTH - back <= x.right[i])
                    i, back = i[fits], back[fits]
                    string = x.span(x.at[i] - back, x.at[i] - back + LENGTH).view(np.int64)
                    empty = pa.nulls(len(i), pa.binary())
                    left = right = empty
                else:
                    i, back, string = at, np.full(len(at), -1), np.zeros(len(at), np.int64)
                    left = _cut_out(data, x.at[i] - x.left[i], x.left[i])
                    right = _cut_out(data, x.at[i], x.right[i])
                yield pa.RecordBatch.from_arrays([pa.array(x.key[i].view(np.int64)), pa.array(context[i]), pa.array(ids[x.doc[i] + a]), pa.array(back.astype(np.int32)), pa.array(string), left, right], names)


def _member(doc: np.ndarray, context: np.ndarray, asked: pa.Array) -> np.ndarray:
    """Rows whose context is in their document's list."""
    count = _lengths(asked)
    values = np.asarray(asked.flatten())
    if not len(values) or not len(doc):
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    want = mix(values.view(np.uint64) + mix(owner.astype(np.uint64) + np.uint64(1)))
    have = mix(context.view(np.uint64) + mix(doc.astype(np.uint64) + np.uint64(1)))
    return np.flatnonzero(np.isin(have, want))


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0))


def _cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of the given spans."""
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[index].tobytes())])


def intervals(common: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, last, depth, depth of the parent) of each node of the common-prefix interval tree with
    two members or more; common[i] is the common prefix of entries i and i + 1."""
    out, stack = [], [(0, 0)]  # first entry, depth
    for i in range(len(common) + 1):
        depth = int(common[i]) if i < len(common) else 0
        first = i
        while stack[-1][1] > depth:
            first, top = stack.pop()
            out.append((first, i, top, max(depth, stack[-1][1])))
        if stack[-1][1] < depth:
            stack.append((first, depth))
    return out


def matches(key: np.ndarray, doc: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each context, bit l set if the LENGTH-byte string that begins l bytes before its anchor is
    also in a context of the same key and a smaller document."""
    n, reach = len(key), LENGTH - GRAM
    after = np.frombuffer(b"".join(x.ljust(56, b"\0") for x in right), np.uint8).reshape(n, 56)
    size = np.array([len(x) for x in right])
    words = after.view(">u8")
    order = np.lexsort((size, *(words[:, j] for j in reversed(range(7))), key))
    key, doc, size, after = key[order], doc[order], size[order], after[order]
    lefts = np.array([len(x) for x in left])[order]
    before = np.frombuffer(b"".join(x[::-1].ljust(reach, b"\0") for x in left), np.uint8).reshape(n, reach)[order]
    hashes = np.zeros((n, reach + 1), np.uint64)
    for j in range(reach):
        hashes[:, j + 1] = mix(hashes[:, j] * np.uint64(0x9E3779B97F4A7C15) + before[:, j] + np.uint64(1))
    differ = after[1:] != after[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), 56)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    common[key[1:] != key[:-1]] = 0
    masks = np.zeros(n, np.int64)
    nodes = [x for x in intervals(common) if x[2] >= GRAM]
    if nodes:
        first, last, depth, parent = np.array(nodes).T
        # left extensions for which this node, and not its parent, is the set with enough to the right
        low, high = np.maximum(LENGTH - depth, 0), np.minimum(LENGTH - np.maximum(parent, GRAM - 1) - 1, reach)
        for l in range(reach + 1):
            here = np.flatnonzero((low <= l) & (l <= high))
            if not len(here):
                continue
            m = last[here] - first[here] + 1
            node = np.repeat(here, m)
            member = np.arange(m.sum()) + np.repeat(first[here] - (np.cumsum(m) - m), m)
            fits = lefts[member] >= l
            node, member = node[fits], member[fits]
            part = mix(hashes[member, l] + node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            by = np.lexsort((doc[member], part))
            part, member = part[by], member[by]
            if not len(part):
                continue
            new = np.concatenate([[True], part[1:] != part[:-1]])
            least = doc[member][np.flatnonzero(new)][np.cumsum(new) - 1]
            masks[member[doc[member] > least]] |= np.int64(1) << np.int64(l)
    out = np.zeros(n, np.int64)
    out[order] = masks
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: masks of the contexts; whole keys, about 16k contexts at a time."""

    def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        key, doc = (np.asarray(t.column(x)) for x in ("key", "doc_id"))
        masks = matches(key, doc, t.column("left").to_pylist(), t.column("right").to_pylist())
        yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("context").combine_chunks(), pa.array(masks)], ["doc_id", "context", "mask"])

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("key"))
        if rows >= 1 << 14:
            turns = np.flatnonzero(key != np.asarray(held[-1].column("key"))[-1])
            if len(turns):
                held.append(batch.slice(0, turns[0]))
                yield from out(held)
                held, rows, batch = [], 0, batch.slice(turns[0])
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield from out(held)


def _marked(x: Anchors, full: pa.Array, masks: pa.Array) -> np.ndarray:
    """Whether each byte of the slice goes."""
    context = x.context.view(np.int64)
    edge = np.zeros(len(x.data) + 1, np.int32)
    at = _member(x.doc, context, full)
    np.add.at(edge, x.at[at] - x.left[at], 1)
    np.add.at(edge, x.at[at] + x.right[at], -1)
    count = _lengths(masks)
    flat = masks.flatten()
    if len(flat):
        owner = np.repeat(np.arange(len(count)), count)
        want = mix(np.asarray(flat.field("context")).view(np.uint64) + mix(owner.astype(np.uint64) + np.uint64(1)))
        have = mix(x.context + mix(x.doc.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(want)
        place = np.minimum(np.searchsorted(want[order], have), len(want) - 1)
        found = np.flatnonzero(want[order][place] == have)
        mask = np.asarray(flat.field("mask"))[order][place[found]]
        for l in range(LENGTH - GRAM + 1):
            start = x.at[found[(mask >> l) & 1 == 1]] - l
            np.add.at(edge, start, 1)
            np.add.at(edge, start + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            gone = _marked(Anchors(data, offsets), batch.column("full").slice(a, b - a), batch.column("masks").slice(a, b - a))
            rows = []
            for s, e in zip(offsets, offsets[1:], strict=False):
                g = gone[s:e]
                rows.append((int(e - s), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), data[s:e][~g].tobytes()))
            n, removed, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array([sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless told otherwise, kept (binary)
    for every row of docs."""
    named = docs.where("doc_id is not null").select("doc_id", "text")
    kinds = F.when(F.col("kind") == _SPREAD, F.xxhash64("context")).when(F.col("kind") == _FULL, F.xxhash64("context", "doc_id")).otherwise(F.col("key"))
    found = named.mapInArrow(_anchors(FLUSH, SPREAD), "key long, context long, doc_id long, kind byte").repartition(kinds).sortWithinPartitions("key", "context", "doc_id")
    found = cut(found.mapInArrow(_classes, "key long, context long, doc_id long, full boolean"))
    first = found.where("not full").select("key", "context", "doc_id")
    crowded = cut(first.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot")))
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    asked = first.join(crowded, "key", "left").groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.col("context"))).alias("some"), F.collect_list(F.when(F.col("hot"), F.col("context"))).alias("hot"))
    fetched = cut(named.join(asked, "doc_id").select("doc_id", "text", "some", "hot").mapInArrow(_fetch, "key long, context long, doc_id long, back int, string long, left binary, right binary"))
    trees = fetched.where("back < 0").select("key", "context", "doc_id", "left", "right").repartition("key").sortWithinPartitions("key").mapInArrow(_trees, "doc_id long, context long, mask long")
    single = fetched.where("back >= 0").select("key", "back", "string", "doc_id", "context")
    least = cut(single.groupBy("key", "back", "string").agg(F.min("doc_id").alias("least")))
    strings = single.join(least, ["key", "back", "string"]).where("doc_id > least").select("doc_id", "context", F.expr("shiftleft(1L, back)").alias("mask"))
    masks = trees.unionByName(strings).where("mask <> 0").groupBy("doc_id", "context").agg(F.bit_or("mask").alias("mask"))
    masks = masks.groupBy("doc_id").agg(F.collect_list(F.struct("context", "mask")).alias("masks"))
    full = found.where("full").groupBy("doc_id").agg(F.collect_set("context").alias("full"))
    ends = docs.select("doc_id", "text").join(full, "doc_id", "left").join(masks, "doc_id", "left").select("doc_id", "text", "full", "masks")
    out = ends.mapInArrow(_cuts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")


def oracle(source: str) -> str:
    """remove without its bytes in SQL: every LENGTH-byte string of the table, as hexadecimal digits, with the
    smallest document that has it. (Texts are first cut into overlapping pieces, as a digit far inside a
    long string is dear to look up.)"""
    step = 1000
    return f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM {source}
), c AS (
  SELECT doc_id, n, {step} * k AS base, substring(h, {2 * step} * k + 1, {2 * (step + LENGTH - 1)}) AS piece FROM d, LATERAL (SELECT unnest(range((n + {step - 1}) // {step})) AS k)
), p AS (
  SELECT doc_id, base + i AS pos, substring(piece, 2 * i + 1, {2 * LENGTH}) AS s FROM c, LATERAL (SELECT unnest(range(least({step}, n - base - {LENGTH - 1}))) AS i)
), m AS (
  SELECT s, min(doc_id) AS least_id FROM p GROUP BY s HAVING count(DISTINCT doc_id) > 1
), g AS (
  SELECT doc_id, pos, lag(pos) OVER w AS prior FROM p JOIN m USING (s) WHERE doc_id > least_id WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos, sum((prior IS NULL OR pos > prior + {LENGTH})::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g
), x AS (
  SELECT doc_id, run, min(pos) AS a, max(pos) + {LENGTH} AS b FROM r GROUP BY doc_id, run
), k AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, list(a ORDER BY a) AS begins, list(b ORDER BY a) AS ends FROM x GROUP BY doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.h ELSE array_to_string(list_transform(list_zip([0] || k.ends, k.begins || [d.n]), lambda z: substring(d.h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
