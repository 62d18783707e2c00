"""Secrets: pattern spans, and values in credential contexts weighed by what it costs to guess them.

Base spans (assign, access, hex) come from fixed patterns. Besides, the value that follows a name such
as `db_password:`, `authorization=`, `contraseña :=`, or stands between user and host of a URL, is taken
apart by dynamic programming into the segments an attacker would try, so that the sum of their costs is
least. Costs are thousandths of a bit:

    word    log2(total / count) of the corpus' own words, or log2(rank) of COMMON; a capital adds 1 bit,
            look-alike digits and symbols (p4ssw0rd) 2
    date    years 7.6, dates of six digits 15.2, whole ones 16.2, written with separators 18.2 bits
    repeat  the unit by brute force, and log2 of the times it stands there; whole runs only
    walk    neighbours on the keyboard or in the alphabet: log2(47 * length), 2 bits a straight stretch;
            whole runs of four keys or more
    brute   each other character: 26, 26, 10 or 33 of its kind

A value of STRONG or more is no word anyone would try: a span of kind `strong`. What costs less (a
placeholder, `changeme`, `qwerty2024`) is no secret by this method; base spans stay in any case.

Words are counted over all documents. The dictionary holds words that make up at least 1 in 2**SHARE of
all words; there are at most 2**SHARE of those, whatever the corpus, so it may be broadcast. Rarer words
would cost more than SHARE bits and are left to brute force.

Plan: one pass counts words (summed before the shuffle), one finds, weighs and joins spans inside Arrow
batches. Only word counts are shuffled.

Null text is empty: no spans, and stays null when redacted. Rows that repeat a doc_id, or have none, are
rows of their own. Equal costs: the segment that starts first. Extra columns are ignored by `findings` and
`digest` and kept by `redact`, whatever their names. Very long texts and values are handled whole by one
task. A table without words has an empty dictionary; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .kernel import Words, slices

KINDS = ("assign", "access", "hex")
STRONG = 33_219  # 10**10 guesses, in thousandths of a bit
SHARE = 16
SHORTEST, LONGEST = 3, 20  # letters of a dictionary word
# fixed values: passwords that are tried first, in that order
COMMON = """password admin root letmein welcome login secret changeme default test guest user example dragon monkey
master football baseball iloveyou sunshine princess shadow superman batman trustno hello freedom whatever starwars
access passphrase token placeholder dummy sample demo demodemo none null undefined""".split()
LOOKALIKE = ("0134578@$!", "oleastbasi")  # a character and the letter it stands for
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


def any_case(words: str) -> str:
    """A pattern that takes ASCII letters in either case, and no other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


PATTERNS = (
    f"({any_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]+",
)
LEAST = (6, 20, 24)  # characters of group 2, of the match, of the match
NAMES = "password|passwd|passphrase|passcode|passwort|kennwort|contrase(?:ñ|Ñ|n)a|clave|mot de passe|pwd|pass|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|auth"
CONTEXTS = (
    rf"""(?:{any_case(NAMES)})[A-Za-z0-9_-]{{0,32}}["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?(?:(?:{any_case("bearer|basic")})\x20)?([!#$%&()*+./0-9:=?@A-Z\[\\\]^_a-z{{|}}~-]{{5,}}[!#$%&*+/0-9=@A-Z^_a-z~-])""",
    r"""://[^\s:/@"']{1,64}:([!#$%&()*+.0-9=?A-Z\[\\\]^_a-z{|}~-]{6,})@""",
)
_BASE, _VALUE = tuple(map(re.compile, PATTERNS)), tuple(map(re.compile, CONTEXTS))
_LIKELY = rf"{any_case(NAMES)}|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|://[^\s:/@]{{1,64}}:"
_D, _M, _Y = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
_S = "[-./_]"


def thousandths(guesses: float) -> int:
    return round(1000 * log2(guesses))


DATES = (  # length, pattern, cost
    (4, _Y, thousandths(200)),
    (6, f"{_D}{_M}[0-9]{{2}}|[0-9]{{2}}{_M}{_D}", thousandths(100 * 366)),
    (8, f"{_Y}{_M}{_D}|{_D}{_M}{_Y}|{_M}{_D}{_Y}", thousandths(200 * 366)),
    (10, f"{_Y}{_S}{_M}{_S}{_D}|{_D}{_S}{_M}{_S}{_Y}|{_M}{_S}{_D}{_S}{_Y}", thousandths(200 * 366) + 2000),
)
_DATES = tuple((n, re.compile(f"(?=(?:{p}))"), cost) for n, p, cost in DATES)
PERIODS, WALK = 8, 4
LETTER, DIGIT, OTHER = thousandths(26), thousandths(10), thousandths(33)
CAPITAL, LOOKS, STRAIGHT, KEYS = 1000, 2000, 2000, 47


def steps() -> dict[tuple[str, str], str]:
    """Direction of every step from a key to a neighbour, and of those along the alphabet."""
    place = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    way = {(1, 0): "right", (-1, 0): "left", (0, 1): "down", (-1, 1): "down left", (0, -1): "up", (1, -1): "up right"}
    out = {(a, b): way[v - x, w - y] for a, (x, y) in place.items() for b, (v, w) in place.items() if (v - x, w - y) in way}
    for a, b in zip("abcdefghijklmnopqrstuvwxy", "bcdefghijklmnopqrstuvwxyz", strict=True):
        out.setdefault((a, b), "next")
        out.setdefault((b, a), "previous")
    return out


_STEPS = steps()


class Dictionary:
    """Costs of words by hash: of the corpus' frequent ones and of COMMON, whichever is less."""

    def __init__(self, hashes: np.ndarray, costs: np.ndarray):
        raw = "".join(COMMON).encode()
        ends = np.cumsum([len(x) for x in COMMON])
        common = Words(np.frombuffer(raw, np.uint8), np.concatenate([[0], ends]).astype(np.int64)).hash
        key = np.concatenate([hashes.astype(np.uint64), common])
        cost = np.concatenate([costs, [thousandths(i + 1) for i in range(len(COMMON))]]).astype(np.int64)
        order = np.lexsort((cost, key))
        first = np.ones(len(order), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        self.hashes, self.costs = key[order][first], cost[order][first]

    def words(self, value: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, cost) of every dictionary word in value, capitals and look-alikes included."""
        plain = value.translate(str.maketrans(*LOOKALIKE)).encode()
        raw = np.frombuffer(value.encode(), np.uint8)
        upper = (raw >= 65) & (raw <= 90)
        letter = upper | (raw >= 97) & (raw <= 122)
        text = np.frombuffer(plain, np.uint8)
        text = np.where((text >= 65) & (text <= 90), text + 32, text).astype(np.uint8)
        ok = (text >= 97) & (text <= 122)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (ok, letter, upper)]
        whole = Words(text, np.array([0, len(text)]))
        for n in range(SHORTEST, min(LONGEST, len(text)) + 1):
            start = np.arange(len(text) - n + 1)
            plain, letters, capitals = (x[n:] - x[:-n] for x in sums)
            start = start[(plain == n) & (letters > 0)]
            if not len(start):
                continue
            key = whole.spans(start, start + n)
            at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
            hit = self.hashes[at] == key
            for i, cost in zip(start[hit], self.costs[at[hit]], strict=True):
                yield int(i), int(i) + n, int(cost) + CAPITAL * bool(capitals[i]) + LOOKS * bool(letters[i] < n)


def brute(c: str) -> int:
    return DIGIT if "0" <= c <= "9" else LETTER if "a" <= c.lower() <= "z" else OTHER


def segments(value: str, dictionary: Dictionary) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, cost, kind) of every segment the method knows, but for single characters."""
    n = len(value)
    for a, b, cost in dictionary.words(value):
        yield a, b, cost, "word"
    for size, pattern, cost in _DATES:
        for m in pattern.finditer(value):
            yield m.start(), m.start() + size, cost, "date"
    raw = np.frombuffer(value.encode(), np.uint8)
    for p in range(1, min(PERIODS, n - 1) + 1):
        for a, length in _runs(raw[:-p] == raw[p:]):
            times = (length + p) // p
            if times >= 2 and times * p >= 3:
                yield a, a + times * p, sum(map(brute, value[a : a + p])) + thousandths(times), "repeat"
    low = value.lower()
    way = [_STEPS.get(x) for x in zip(low, low[1:], strict=False)]
    for a, length in _runs(np.array([x is not None for x in way], bool)):
        if length + 1 >= WALK:
            turns = sum(x != y for x, y in zip(way[a : a + length], way[a + 1 : a + length], strict=False))
            yield a, a + length + 1, thousandths(KEYS * (length + 1)) + STRAIGHT * (1 + turns), "walk"


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def guess_cost(value: str, dictionary: Dictionary) -> tuple[int, list[tuple[int, int, str]]]:
    """The least cost of value, and its segments (start, end, kind); brute-force neighbours are one."""
    ending: dict[int, list[tuple[int, int, str]]] = {}
    for a, b, cost, kind in segments(value, dictionary):
        ending.setdefault(b, []).append((a, cost, kind))
    best, back = [0], [(0, "")]
    for j in range(1, len(value) + 1):
        found = min([(best[j - 1] + brute(value[j - 1]), j - 1, "brute"), *((best[a] + cost, a, kind) for a, cost, kind in ending.get(j, ()))])
        best.append(found[0])
        back.append(found[1:])
    parts, j = [], len(value)
    while j:
        a, kind = back[j]
        if kind == "brute" and parts and parts[-1][2] == "brute":
            parts[-1] = (a, parts[-1][1], kind)
        else:
            parts.append((a, j, kind))
        j = a
    return best[-1], parts[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    found = []
    for k, pattern in enumerate(_BASE):
        for m in pattern.finditer(text):
            if len(m[2] if k == 0 else m[0]) >= LEAST[k]:
                found.append((m.start(), k, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def values(text: str) -> list[tuple[int, int]]:
    """Places of values in credential contexts, by start."""
    return sorted({m.span(1) for pattern in _VALUE for m in pattern.finditer(text)})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a slice's dictionary words and how often they stand there."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            words = Words(data, offsets, strip=True)
            low = words.data
            letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
            size = words.end - words.start
            kept = (size >= SHORTEST) & (size <= LONGEST) & (letters[words.end] - letters[words.start] == size)
            key, n = np.unique(words.hash[kept], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def learn(docs: DataFrame) -> Dictionary:
    """The dictionary of docs; at most 2**SHARE rows reach the driver."""
    counts = cut(docs.select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return Dictionary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = counts.where(F.col("n") * F.lit(1 << SHARE) >= F.lit(total)).toArrow()
    n = rows.column("n").to_pylist()
    return Dictionary(np.asarray(rows.column("word"), np.int64).view(np.uint64), np.array([thousandths(total / x) for x in n], np.int64))


Found = tuple[list[tuple[str, int, int]], list[tuple[int, int, int, list]]]  # base spans; values with costs and segments


def scan(text: str, dictionary: Dictionary) -> Found:
    return base_spans(text), [(a, b, *guess_cost(text[a:b], dictionary)) for a, b in values(text)]


def spans(found: Found) -> list[tuple[str, int, int]]:
    """All spans: base ones, and the values that cost STRONG or more."""
    order = {k: i for i, k in enumerate((*KINDS, "strong"))}
    return sorted([*found[0], *(("strong", a, b) for a, b, cost, _ in found[1] if cost >= STRONG)], key=lambda x: (x[1], order[x[0]]))


def _scanned(docs: DataFrame):
    """A function that scans an Arrow column of texts, with docs' dictionary broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(column: pa.Array) -> Iterator[Found]:
        likely = np.asarray(pc.fill_null(pc.match_substring_regex(column, _LIKELY), False))
        for i, x in enumerate(likely):
            yield scan(column[i].as_py(), shared.value) if x else ([], [])

    return run


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def digest(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_assign, n_access, n_hex, n_values (in credential contexts), n_strong,
    base_sha256, spans, and costs (start:end:cost of every value)."""
    run = _scanned(docs)
    names = [*(f"n_{k}" for k in KINDS), "n_values", "n_strong"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, text = [], [[], [], []]
            for found in run(batch.column("text")):
                every = spans(found)
                counts.append([*(sum(k == x for k, _, _ in found[0]) for x in KINDS), len(found[1]), sum(k == "strong" for k, _, _ in every)])
                for out, x in zip(text, (_joined(found[0]), _joined(every), ",".join(f"{a}:{b}:{cost}" for a, b, cost, _ in found[1])), strict=True):
                    out.append(x)
            table = np.array(counts, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(table[:, j]) for j in range(len(names))), *(pa.array(x, pa.string()) for x in text)], ["doc_id", *names, "base", "spans", "costs"])

    found = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id long, {', '.join(f'{x} long' for x in names)}, base string, spans string, costs string")
    return found.select("doc_id", *names, F.sha2("base", 256).alias("base_sha256"), "spans", "costs")


def findings(docs: DataFrame) -> DataFrame:
    """One row a span: doc_id, kind, start, end, text, and for values cost and parts (kind:start:end of
    their segments). Values under STRONG are reported too, as kind `weak`."""
    run = _scanned(docs)
    schema = "doc_id long, kind string, start long, `end` long, text string, cost long, parts string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "kind", "start", "end", "text", "cost", "parts")}
            ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, (base, weighed) in enumerate(run(text)):
                each = [(k, a, b, None, None) for k, a, b in base] + [("strong" if cost >= STRONG else "weak", a, b, cost, _joined([(k, a + s, a + e) for s, e, k in parts])) for a, b, cost, parts in weighed]
                for k, a, b, cost, parts in each:
                    for name, x in zip(out, (ids[i], k, a, b, text[i].as_py()[a:b], cost, parts), strict=True):
                        out[name].append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], list(out))

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with [SECRET] for every span; spans that meet are one."""
    out, at = [], 0
    for _, start, end in found:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced; all other columns stay."""
    run, names = _scanned(docs), docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            new = pa.array([None if x is None else redacted(x, spans(found)) for x, found in zip(text.to_pylist(), run(text), strict=True)], text.type)
            yield pa.RecordBatch.from_arrays([new if x == "text" else batch.column(x) for x in names], names)

    return docs.mapInArrow(rows, docs.schema)


def oracle(source: str) -> str:
    """digest in SQL: segments by position lists, islands for runs, a recursive query for the least cost."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    base = ", ".join(f"({k}, {quoted(KINDS[k])}, {quoted(p)}, {2 if k == 0 else 0}, {LEAST[k]})" for k, p in enumerate(PATTERNS))
    contexts = ", ".join(f"({k}, {quoted(p)}, {k})" for k, p in enumerate(CONTEXTS))
    common = ", ".join(f"({quoted(w)}, {thousandths(i + 1)})" for i, w in enumerate(COMMON))
    moves = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(d)})" for (a, b), d in _STEPS.items())
    dates = ", ".join(f"({n}, {quoted(p)}, {cost})" for n, p, cost in DATES)
    one = lambda c: f"CASE WHEN regexp_full_match({c}, '[0-9]') THEN {DIGIT} WHEN regexp_full_match({c}, '[A-Za-z]') THEN {LETTER} ELSE {OTHER} END"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    marks = r"[!-/:-@\[-`{-~]{1,4}"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM {source}
), kinds(o, kind, pattern, part, least) AS (VALUES {base}), contexts(o, pattern, tail) AS (VALUES {contexts}),
m AS (
  SELECT r, o, kind, pattern, part, least, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS ps FROM d, kinds
), x AS (
  SELECT r, o, kind, part, least, pattern, unnest(ms) AS v, unnest(ps[1 : len(ms)]) AS piece, unnest(range(len(ms))) AS k FROM m
), y AS (
  SELECT *, sum(length(piece) + length(v)) OVER (PARTITION BY r, o ORDER BY k) AS e FROM x
), b AS (
  SELECT r, o, kind, (e - length(v))::BIGINT AS s, e::BIGINT AS e FROM y
  WHERE CASE WHEN part = 2 THEN length(regexp_extract(v, {quoted(PATTERNS[0])}, 2)) ELSE length(v) END >= least
), cm AS (
  SELECT r, o, tail, pattern, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS ps FROM d, contexts
), cx AS (
  SELECT r, o, tail, unnest(ms) AS v, unnest(ps[1 : len(ms)]) AS piece, unnest(range(len(ms))) AS k FROM cm
), cy AS (
  SELECT *, sum(length(piece) + length(v)) OVER (PARTITION BY r, o ORDER BY k) - tail AS e,
         CASE o WHEN 0 THEN regexp_extract(v, {quoted(CONTEXTS[0])}, 1) ELSE regexp_extract(v, {quoted(CONTEXTS[1])}, 1) END AS value FROM cx
), places AS (
  SELECT DISTINCT r, (e - length(value))::BIGINT AS s, e::BIGINT AS e, value FROM cy
), v AS (
  SELECT DISTINCT value AS v, length(value) AS n FROM places
), w AS (
  SELECT {lower(f"regexp_replace(regexp_replace(u, '{marks}$', ''), '^{marks}', '')")} AS word
  FROM (SELECT unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS u FROM d)
), counts AS (
  SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{{SHORTEST},{LONGEST}}}') GROUP BY word
), words AS (
  SELECT word, min(cost) AS cost FROM (
    SELECT word, round(1000 * log2((SELECT sum(n) FROM counts) / n))::BIGINT AS cost FROM counts WHERE n * {1 << SHARE} >= (SELECT sum(n) FROM counts)
    UNION ALL SELECT * FROM (VALUES {common}) q(word, cost)) GROUP BY word
), spots AS (
  SELECT v, n, unnest(range(n)) AS i FROM v
), spelled AS (
  SELECT v, i, i + l AS j, substr(v, i + 1, l) AS sub FROM (SELECT v, n, i, unnest(range({SHORTEST}, {LONGEST} + 1)) AS l FROM spots) WHERE i + l <= n
), same AS (
  SELECT v, p, k, k - row_number() OVER (PARTITION BY v, p ORDER BY k) AS island FROM (
    SELECT v, p, unnest(range(n - p)) AS k FROM (SELECT v, n, unnest(range(1, {PERIODS} + 1)) AS p FROM v) WHERE p < n) WHERE substr(v, k + 1, 1) = substr(v, k + 1 + p, 1)
), runs AS (
  SELECT v, p, min(k) AS i, (count(*) + p) // p AS times FROM same GROUP BY v, p, island
), moves(a, b, way) AS (VALUES {moves}), walked AS (
  SELECT v, i, way, i - row_number() OVER (PARTITION BY v ORDER BY i) AS island, lag(way) OVER (PARTITION BY v ORDER BY i) AS before, lag(i) OVER (PARTITION BY v ORDER BY i) AS ago
  FROM spots JOIN moves ON a = lower(substr(v, i + 1, 1)) AND b = lower(substr(v, i + 2, 1))
), dates(l, pattern, cost) AS (VALUES {dates}), edges AS (
  SELECT v, i, i + 1 AS j, {one("substr(v, i + 1, 1)")} AS cost FROM spots
  UNION ALL SELECT v, i, j, cost + CASE WHEN regexp_matches(sub, '[A-Z]') THEN {CAPITAL} ELSE 0 END + CASE WHEN regexp_matches(sub, '[^A-Za-z]') THEN {LOOKS} ELSE 0 END
    FROM spelled JOIN words ON word = translate({lower("sub")}, '{LOOKALIKE[0]}', '{LOOKALIKE[1]}') WHERE regexp_matches(sub, '[A-Za-z]')
  UNION ALL SELECT v, i, i + l, cost FROM spots, dates WHERE i + l <= n AND regexp_full_match(substr(v, i + 1, l), pattern)
  UNION ALL SELECT v, i, i + times * p, list_sum(list_transform(range(i, i + p), lambda k: {one("substr(v, k + 1, 1)")})) + round(1000 * log2(times)) FROM runs WHERE times >= 2 AND times * p >= 3
  UNION ALL SELECT v, min(i), max(i) + 2, round(1000 * log2({KEYS} * (count(*) + 1))) + {STRAIGHT} * (1 + count(*) FILTER (ago = i - 1 AND before <> way)) FROM walked GROUP BY v, island HAVING count(*) + 1 >= {WALK}
), ends AS (
  SELECT v, j, list({{'i': i, 'cost': cost::BIGINT}}) AS each FROM edges GROUP BY v, j
), best AS (
  SELECT v, n, 0::BIGINT AS j, [0::BIGINT] AS costs FROM v
  UNION ALL
  SELECT best.v, best.n, best.j + 1, list_append(best.costs, list_min(list_transform(ends.each, lambda x: best.costs[x.i + 1] + x.cost))) FROM best JOIN ends ON ends.v = best.v AND ends.j = best.j + 1
), priced AS (
  SELECT v, costs[n + 1] AS cost FROM best WHERE j = n
), found AS (
  SELECT r, s, e, cost FROM places JOIN priced ON v = value
), counted AS (
  SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS base FROM b GROUP BY r
), weighed AS (
  SELECT r, count(*) AS n_values, count(*) FILTER (cost >= {STRONG}) AS n_strong, string_agg(s || ':' || e || ':' || cost, ',' ORDER BY s, e) AS costs FROM found GROUP BY r
), spans AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans FROM (SELECT r, o, kind, s, e FROM b UNION ALL SELECT r, 3, 'strong', s, e FROM found WHERE cost >= {STRONG}) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_values, 0) AS n_values, coalesce(n_strong, 0) AS n_strong,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(costs, '') AS costs
FROM d LEFT JOIN counted USING (r) LEFT JOIN weighed USING (r) LEFT JOIN spans USING (r)
"""
