"""Personal data: pattern spans, and information-theoretic sanitisation of what would reveal them.

Base spans (e-mail, IPv4, card, phone) come from fixed patterns. A found value is a protected
entity c. Corpus co-occurrence then tells how strongly a term t in a document reveals c although c
itself is masked: with document frequencies over all N documents,

    IC(c) = log2(N / df(c))        PMI(c, t) = log2(P(c | t) N / df(c))

and t discloses the share PMI / IC = 1 + log2 P(c | t) / IC(c) of c, with P(c | t) = df(c,t) / df(t). The share
is taken times 1 - 1 / (16 d) where d is the number of different texts that hold both: copies of one text
are one piece of evidence, and evidence counts the same in a corpus of any size. In documents that hold c, terms with a
share of at least GENERALISE are spans of kind `term`: those of REMOVE or more are deleted, the others
replaced by their general class (NUMBER, NAME, WORD). So a term that only documents of c hold is
generalised from the first text on, and deleted once four texts agree; one that also stands elsewhere discloses c
the less, the more often it does.

Plan: one pass finds base spans and, only where a document has an entity, its distinct terms; df(t)
is counted over every document, summed inside each task before the shuffle. Entities that the same rows hold
are alike to every term: one of them, told by the sum of its rows' hashes, stands for all. Terms meet df(t) once a row,
and those too frequent to disclose any of the row's entities go before they meet the entities. Rows are told apart by a
number given in the first pass, never by doc_id; only rows with entities carry text across a shuffle.

Null text is empty: no spans, and stays null when sanitised. Empty and blank texts have none. Rows
that repeat a doc_id, or have none, are separate rows. Extra columns are ignored by `find` and kept
by `sanitise`, whatever their names. Ties: a share equal to a threshold counts. Very long texts are
handled whole by one task. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut
from .kernel import Words, distinct, lists, mix, slices

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE = 0.9, 0.98
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_FLUSH = 4_000_000  # terms a task holds before it hands on their counts


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        v = int(x) << (i & 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that the cost stays linear."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
        if at < 0:
            break
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def _entity(kind: str, value: str) -> int:
    plain = value.lower() if kind in ("email", "ip") else _NOT_DIGIT.sub("", value)
    return int.from_bytes(sha256(f"{kind}:{plain}".encode()).digest()[:8], "little", signed=True)


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        text = batch.column("text")
        likely = np.asarray(pc.fill_null(pc.match_substring_regex(text, "[@0-9]"), False))
        counts, spans, entities = np.zeros((4, len(text)), np.int64), [""] * len(text), [[] for _ in range(len(text))]
        for i in np.flatnonzero(likely):
            value = text[i].as_py()
            found = base_spans(value)
            for k, _, _ in found:
                counts[KINDS.index(k), i] += 1
            spans[i] = _join(found)
            entities[i] = sorted({_entity(k, value[s:e]) for k, s, e in found})
        holds = np.array([bool(x) for x in entities], bool)
        held = pc.if_else(pa.array(holds), text, pa.scalar(None, text.type))
        whole = [batch.column("row")] if "row" in batch.schema.names else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + len(text))), batch.column("doc_id"), *(pa.array(x) for x in counts), pa.array(spans), pa.array(entities, pa.list_(pa.int64())), held, *whole],
            ["number", "doc_id", *(f"n_{k}" for k in KINDS), "base", "entities", "text", *(["row"] if whole else [])],
        )
        row += len(text)


def _terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, strip=True)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document with entities: its distinct terms, and a hash of its text."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            words = _terms(data, offsets)
            doc, term = distinct(words.doc, words.hash)
            whole = Words(data, offsets)
            same = np.zeros(b - a, np.uint64)
            np.add.at(same, whole.doc, mix(whole.hash + np.arange(len(whole.hash)).astype(np.uint64) - whole.first[whole.doc].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("number").slice(a, b - a), batch.column("entities").slice(a, b - a), pa.array(same.view(np.int64)), lists(term.view(np.int64), np.bincount(doc, minlength=b - a), pa.int64())],
                ["number", "entities", "same", "terms"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of all terms of a task, summed up to _FLUSH terms."""
    held: list[np.ndarray] = []
    sums: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate(held)
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate(sums)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.add.reduceat(n, first)

    def out(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(key), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], ["term", "n"])

    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            words = _terms(data, offsets)
            if not len(words.hash):
                continue
            term = distinct(words.doc, words.hash)[1]
            term, n = np.unique(term, return_counts=True)
            held.append(term)
            sums.append(n.astype(np.int64))
            if sum(map(len, held)) > _FLUSH:
                key, n = merged()
                held, sums = [key], [n]
                if len(key) > _FLUSH // 2:
                    yield from out(key, n)
                    held, sums = [], []
    if held:
        yield from out(*merged())


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """number, telling: per row that holds one, its disclosing terms and their shares of PMI / IC (the
    largest, where a term discloses several entities)."""
    seen = cut(found.where(F.col("text").isNotNull()).select("number", "entities", "text").mapInArrow(_held, "number long, entities array<long>, same long, terms array<long>"))
    total = F.lit(float(docs.count()))
    each = seen.select("number", "same", F.explode("entities").alias("entity"))
    mark = lambda salt: F.sum(F.xxhash64("number", F.lit(salt)).cast("decimal(38,0)")).cast("string")
    entities = each.groupBy("entity").agg(F.count("*").alias("df_entity"), mark(1).alias("rows1"), mark(2).alias("rows2"))
    # of entities in the same rows the least stands for all: every row that holds one holds it
    kept = entities.where(F.col("df_entity") < total).groupBy("rows1", "rows2", "df_entity").agg(F.min("entity").alias("entity"))
    information = F.log2(total / F.col("df_entity"))
    # the most documents a term may be in if all documents of the entity hold it
    kept = kept.select("entity", "df_entity", (F.col("df_entity") * F.pow(F.lit(2.0), information * (1 - GENERALISE))).alias("most"))
    held = cut(each.join(kept, "entity"))
    df = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_term"))
    limits = held.groupBy("number").agg(F.max("most").alias("most"))
    terms = seen.join(limits, "number").select("number", "most", F.explode("terms").alias("term")).join(df, "term").where(F.col("df_term") <= F.col("most")).select("number", "term", "df_term")
    rare = cut(terms.join(held, "number").where(F.col("df_term") <= F.col("most")).select("number", "same", "entity", "term", "df_entity", "df_term"))
    texts = rare.groupBy("entity", "term", "same").agg(F.count("*").alias("n"), F.first("df_entity").alias("df_entity"), F.first("df_term").alias("df_term"))
    pairs = texts.groupBy("entity", "term").agg(F.sum("n").alias("df_pair"), F.count("*").alias("texts"), F.first("df_entity").alias("df_entity"), F.first("df_term").alias("df_term"))
    share = (1 + F.log2(F.col("df_pair") / F.col("df_term")) / information) * (1 - 1 / (16 * F.col("texts")))
    pairs = pairs.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)
    telling = rare.select("number", "entity", "term").join(pairs, ["entity", "term"]).groupBy("number", "term").agg(F.max("share").alias("share"))
    return telling.groupBy("number").agg(F.collect_list(F.struct("term", "share")).alias("telling"))


def _all_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    for batch in batches:
        out = batch.column("base").to_pylist()
        removed = [[] for _ in out]
        telling = batch.column("telling")
        for a, b, data, offsets in slices(batch.column("text")):
            if not len(data) or telling.slice(a, b - a).null_count == b - a:
                continue
            words = _terms(data, offsets)
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            for i in range(a, b):
                share = {x["term"]: x["share"] for x in telling[i].as_py() or ()}
                if not share:
                    continue
                spans = [(k, int(x), int(y)) for k, x, y in (z.split(":") for z in out[i].split(",") if z)]
                lo, n = words.first[i - a], words.count[i - a]
                start, end = (point[v[lo : lo + n]] - point[offsets[i - a]] for v in (words.start, words.end))
                for j in np.flatnonzero(np.isin(words.hash[lo : lo + n].view(np.int64), list(share))):
                    x, y = int(start[j]), int(end[j])
                    if not any(s < y and x < e for _, s, e in spans[: len(spans)] if _ != "term"):
                        spans.append(("term", x, y))
                        if share[int(words.hash[lo + j].view(np.int64))] >= REMOVE:
                            removed[i].append(x)
                out[i] = _join(sorted(spans, key=lambda z: (z[1], order[z[0]])))
        keep = [x for x in batch.schema.names if x not in ("text", "telling", "entities")]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(out, pa.string()), pa.array(removed, pa.list_(pa.int64()))], [*keep, "spans", "removed"])


_COUNTS = ", ".join(f"n_{k} long" for k in KINDS)


def _found(docs: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame]:
    """The first pass over docs, with docs' own columns in `row` if kept, and each row's disclosing terms."""
    schema = StructType.fromDDL(f"number long, doc_id long, {_COUNTS}, base string, entities array<long>, text string")
    rows = docs.select("doc_id", "text", *([F.struct("*").alias("row")] if keep else []))
    found = cut(rows.mapInArrow(_find, StructType([*schema.fields, *([StructField("row", docs.schema)] if keep else [])])))
    return found, disclosing(docs, found)


def find(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_email, n_ip, n_card, n_phone, base (spans of the patterns), spans
    (all, by start), removed (starts of the term spans to delete instead of generalise)."""
    found, telling = _found(docs, False)
    return found.join(telling, "number", "left").select(*(c for c in found.columns if c != "number"), "telling").mapInArrow(_all_spans, f"doc_id long, {_COUNTS}, base string, spans string, removed array<long>")


def _general(word: str) -> str:
    """The class that stands for a generalised term."""
    return "[NUMBER]" if any(x.isdigit() for x in word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def masked(text: str, spans: str, removed: list[int]) -> str:
    """text with base spans by their kind in brackets, terms by their class or deleted; of spans that
    overlap, the first one counts and the rest of a later one goes with it."""
    out, at = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",") if x):
        start, end = int(start), int(end)
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]" if kind != "term" else "" if start in removed else _general(text[start:end])]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with text masked: base spans by their kind in brackets, revealing terms by their class, terms
    of REMOVE or more deleted. All other columns stay; null text stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _all_spans(batches):
            row = batch.column("row")
            text, spans, removed = row.field("text").to_pylist(), batch.column("spans").to_pylist(), batch.column("removed").to_pylist()
            new = pa.array([None if x is None else masked(x, s, r) for x, s, r in zip(text, spans, removed, strict=True)], row.field("text").type)
            yield pa.RecordBatch.from_arrays([new if x == "text" else row.field(x) for x in names], names)

    found, telling = _found(docs, True)
    return found.join(telling, "number", "left").select("row", "base", "text", "telling").mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The counts and spans of find, with the hash of the base spans and the number of deleted terms."""
    return find(docs).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", F.size("removed").alias("n_removed"))


def oracle(source: str) -> str:
    """digest in SQL; places come from the lengths of matches and of the pieces between them."""
    patterns = ", ".join(
        f"({k}, '{kind}', '{pattern}')"
        for k, (kind, pattern) in enumerate((
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
            ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")))
    )
    word, marks = r"[^\x20\x09-\x0D]+", r"[!-/:-@\[-`{-~]{1,4}"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM {source}
), kinds(o, kind, pattern) AS (VALUES {patterns}), m AS (
  SELECT doc_id, o, kind, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS ps FROM d, kinds
), x AS (
  SELECT doc_id, o, kind, unnest(ms) AS v, unnest(ps[1 : len(ms)]) AS piece, unnest(range(len(ms))) AS k FROM m
), y AS (
  SELECT doc_id, o, kind, v, regexp_replace(v, '[^0-9]', '', 'g') AS digits, sum(length(piece) + length(v)) OVER (PARTITION BY doc_id, o ORDER BY k) AS e FROM x
), b AS (
  SELECT doc_id, o, kind, (e - length(v))::BIGINT AS s, e::BIGINT AS e, kind || ':' || CASE WHEN o < 2 THEN lower(v) ELSE digits END AS entity FROM y
  WHERE CASE o WHEN 0 THEN true WHEN 3 THEN length(digits) BETWEEN 10 AND 15
    WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS BIGINT), 0) > 255)) = 0
    ELSE length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: c::INT * (2 - i % 2) - CASE WHEN i % 2 = 0 AND c::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0 END
), held AS (
  SELECT DISTINCT doc_id, entity FROM b
), n AS (
  SELECT count(*) AS n FROM d
), c AS (
  SELECT entity, count(*) AS df FROM held GROUP BY entity
), ws AS (
  SELECT doc_id, regexp_extract_all(t, '{word}') AS ms, string_split_regex(t, '{word}') AS ps FROM d
), w AS (
  SELECT doc_id, unnest(ms) AS v, unnest(ps[1 : len(ms)]) AS piece, unnest(range(len(ms))) AS k FROM ws
), z AS (
  SELECT doc_id, k, v, regexp_replace(v, '{marks}$', '') AS cut, sum(length(piece) + length(v)) OVER (PARTITION BY doc_id ORDER BY k) - length(v) AS s FROM w
), q AS (
  SELECT doc_id, {lower("regexp_replace(cut, '^" + marks + "', '')")} AS term, (s + length(cut) - length(regexp_replace(cut, '^{marks}', '')))::BIGINT AS s, (s + length(cut))::BIGINT AS e FROM z
), u AS (
  SELECT DISTINCT doc_id, term FROM q WHERE term <> ''
), f AS (
  SELECT term, count(*) AS df FROM u GROUP BY term
), same AS (
  SELECT doc_id, {lower("array_to_string(ms, ' ')")} AS whole FROM ws
), g AS (
  SELECT h.entity, u.term, count(*) AS n, count(DISTINCT same.whole) AS texts FROM held h JOIN u USING (doc_id) JOIN same USING (doc_id) GROUP BY ALL
), i AS (
  SELECT g.entity, g.term, (1 + log2(g.n / f.df) / log2((SELECT n FROM n) / c.df)) * (1 - 1 / (16 * g.texts)) AS share
  FROM g JOIN f USING (term) JOIN c USING (entity) WHERE c.df < (SELECT n FROM n)
), l AS (
  SELECT h.doc_id, i.term, max(share) AS share FROM held h JOIN i USING (entity) JOIN u USING (doc_id, term) WHERE share >= {GENERALISE} GROUP BY ALL
), a AS (
  SELECT q.doc_id, q.s, q.e, l.share FROM q JOIN l USING (doc_id, term) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = q.doc_id AND b.s < q.e AND q.s < b.e)
), base AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_email, count(*) FILTER (o = 1) AS n_ip, count(*) FILTER (o = 2) AS n_card, count(*) FILTER (o = 3) AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS base FROM b GROUP BY doc_id
), spans AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM (SELECT doc_id, o, kind, s, e FROM b UNION ALL SELECT doc_id, 4, 'term', s, e FROM a) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM a WHERE share >= {REMOVE} GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(removed.n, 0)::INT AS n_removed
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
