"""Corpus operators against brute force, and the cases every one of them must take."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framescope.llm import decontamination, html_text, jaccard_join, language_id, mixing, pii, quality, repeats, sharding, topk

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string"


def docs(spark, texts, first=0, sources=("a", "b", None)):
    """Rows with extra columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en" if i % 2 else "fr", sources[i % len(sources)], None, 7, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


def edge_texts():
    """Nulls, empty and blank texts, a very long one, ties and repeats."""
    long = prose(1, 30_000)
    base = prose(2, 80)
    near = base.replace("w1", "v1", 2)
    return [None, "", " \t\n ", "one", "One", base, base, near, long, long + " tail", prose(3, 60), prose(4, 4), prose(4, 4).upper(), "été à 日本", base + " " + prose(5, 10), None]


def doubled(df):
    """Repeated rows, and a null doc_id."""
    extra = df.limit(3).unionByName(df.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    return df.unionByName(extra)


# ---- language ----

def test_language(spark):
    fr, en = "le chat noir dort bien sous la grande table", "the black cat sleeps well under a large table"
    rng = np.random.default_rng(0)
    pick = lambda s: " ".join(rng.choice(s.split(), 12))
    texts = [pick(en if i % 2 else fr) for i in range(400)] + [None, "", "123 456", "!"]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, texts)).collect()}
    for i in range(400):
        assert got[i].lang_pred == ("en" if i % 2 else "fr"), i
        assert 0 <= got[i].score <= 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in range(400, 404))
    assert language_id.identify(docs(spark, texts).limit(0)).count() == 0
    assert language_id.identify(docs(spark, texts).withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_language_takes_edges(spark):
    df = doubled(docs(spark, edge_texts()))
    assert language_id.identify(df).count() == df.count()


def test_language_does_not_depend_on_partitions(spark):
    df = docs(spark, [prose(i, 30, 40 if i % 2 else 60) for i in range(300)] + edge_texts())
    one, other = ({r.doc_id: tuple(r) for r in language_id.identify(x).collect()} for x in (df.coalesce(1), df.repartition(7)))
    assert one == other


def slow_subwords(text):
    """Buckets of the byte n-grams, one by one."""
    b = bytes(32 if x in b" \t\n\x0b\x0c\r" else x + 32 if 65 <= x <= 90 else x for x in text.encode())
    out = []
    for size in (2, 3, 4):
        for i in range(len(b) - size + 1):
            gram = b[i : i + size]
            if 32 not in gram[1:-1] and gram != b"  ":
                mixed = (int.from_bytes(gram, "little") * 0x9E3779B1 + size * 0x85EBCA6B) % 2**32
                out.append(mixed * 0xC2B2AE35 % 2**32 >> 16)
    return out


def test_language_forward_pass_against_a_slow_one(spark):
    rng = np.random.default_rng(3)
    model = language_id.Model(["a", "b", "c"], rng.normal(0, 30, (language_id.BUCKETS, 3)).astype(np.float32), np.array([0.1, 0.0, -0.2]), 1.7, 0.6)
    texts = [*edge_texts(), "Ünï cödé  and\ttabs", "a", "ab c", *[prose(i, 20) for i in range(20)]]
    got = {r.doc_id: r for r in language_id.predict(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        found = slow_subwords(t or "")
        mean = np.mean([model.table[x].astype(float) for x in found], axis=0) if found else np.zeros(3)
        z = np.exp((mean + model.bias) / model.heat)
        p = z / z.sum()
        if t and any(c.isalpha() for c in t):
            assert got[i].lang_pred == "abc"[p.argmax()] and got[i].score == pytest.approx(p.max()) and got[i].rejected == (p.max() < 0.6)
        else:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)


# ---- quality ----

def quality_set(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = [" ".join(word().upper() + "!!" if i % 4 == 0 else word() for _ in range(25)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    return docs(spark, [*texts, None, ""]), labels


def test_quality(spark):
    df, labels = quality_set(spark)
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == 402 and all(got[i].predicted == int(i % 4 != 0) for i in range(400))
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_ignores_held_out_labels_and_takes_edges(spark):
    df, labels = quality_set(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    flipped = spark.createDataFrame([(i, int(i % 4 != 0) ^ held(i), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    a, b = ([(r.doc_id, r.score) for r in quality.classify(df, x).orderBy("doc_id").collect()] for x in (labels.where("quality is not null"), flipped))
    assert a == b
    odd = doubled(docs(spark, edge_texts()))
    assert quality.classify(odd, labels.limit(0)).where("score = 0.5").count() == odd.count()
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_quality_does_not_depend_on_partitions(spark):
    texts = [prose(i, 30).upper() if i % 3 else prose(i, 30) for i in range(300)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(not i % 3), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    one, other = ({r.doc_id: tuple(r) for r in quality.classify(x, y).collect()} for x, y in ((df.coalesce(1), labels), (df.repartition(7), labels.repartition(5))))
    assert one == other


def test_dual_coordinate_descent_against_projected_gradients(monkeypatch):
    """Both solve the dual of the same hinge loss; one coordinate at a time, or all by small steps."""
    monkeypatch.setattr(quality, "_EPOCHS", 2000)
    rng = np.random.default_rng(2)
    ratio = np.zeros(quality.BUCKETS)
    ratio[:12] = rng.normal(size=12)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(40)]
    rows = [r if len(r) else np.array([0]) for r in rows]
    label = np.where([ratio[r].sum() + rng.normal() * 0.5 > 0 for r in rows], 1.0, -1.0)
    weight, bias = quality._hinge(rows, label, ratio)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 12] = 1
    cost = np.where(label > 0, 40 / (2 * (label > 0).sum()), 40 / (2 * (label < 0).sum()))
    q = (x @ x.T) * np.outer(label, label)
    alpha = np.zeros(40)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / 40, 0, cost)
    assert np.allclose(np.append(weight[:12], bias), (alpha * label) @ x, atol=2e-3) and abs(weight[:12]).max() > 0.1


# ---- personal data ----

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def slow_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = [int(x) for x in m[0] if x in "0123456789"]
            good = {
                "email": True, "ip": kind != "ip" or all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d[::-1])) % 10 == 0, "phone": 10 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return [(PATTERNS[k][0], s, e) for s, k, e in sorted(out)]


def test_base_spans_against_the_patterns():
    rng = np.random.default_rng(2)
    alphabet = list("aZ09._%+-@@..  ()4111+1é日\n")
    for _ in range(3000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert pii.base_spans(t) == slow_base(t), t
    for t in ("a@b.c@d.e", "a@b.c_d@e.f", "x@y x@y.z", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.001", "4111 1111-1111 1111", "+1 (415) 555-2671", "9" * 5000 + ".1.1.1", "@.@"):
        assert pii.base_spans(t) == slow_base(t), t


def slow_terms(text):
    """(term, start, end) of every word, without up to four marks at either end."""
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        s, e = m.span()
        for _ in range(4):
            e -= e > s and text[e - 1] in marks
            s += e > s and text[s] in marks
        if e > s:
            yield text[s:e].translate(LOW), s, e


def slow_disclosure(texts):
    """Per row: (start, end, share) of the terms that disclose one of its entities."""
    plain = lambda k, v: (k, v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v))
    spans = [slow_base(t) for t in texts]
    entities = [{plain(k, t[s:e]) for k, s, e in b} for t, b in zip(texts, spans, strict=True)]
    terms = [{w for w, _, _ in slow_terms(t)} for t in texts]
    df_term, df_entity = Counter(w for x in terms for w in x), Counter(c for x in entities for c in x)
    n, share = len(texts), {}
    for c in df_entity:
        holders = [i for i, x in enumerate(entities) if c in x]
        ic = np.log2(n / len(holders))
        for w in set().union(*(terms[i] for i in holders)):
            both = [i for i in holders if w in terms[i]]
            share[c, w] = (1 + np.log2(len(both) / df_term[w]) / ic) * (1 - 1 / (16 * len({tuple(texts[i].split()) for i in both}))) if ic else 0
    out = []
    for t, b, found in zip(texts, spans, entities, strict=True):
        rows = [(s, e, max((share[c, w] for c in found), default=0)) for w, s, e in slow_terms(t) if not any(x < e and s < y for _, x, y in b)]
        out.append([r for r in rows if r[2] >= pii.GENERALISE])
    return out


def secret_texts():
    secret = [f"contact zebrafish{'' if i % 2 else ','} at bob.smith@mail.example.com about item {prose(i, 8)}" for i in range(6)]
    alone = ["The lonely Quokka wrote from 10.9.8.7 to w1 w2", "The lonely Quokka wrote from 10.9.8.7 to w1 w2", "call 7351 or +1 (415) 555-2671 w3"]
    return [*secret, *alone, *[prose(50 + i, 30) for i in range(2100)], *edge_texts(), "mail x@y.zz or 10.0.0.1"]


def test_pii_terms_against_a_slow_count(spark):
    texts = secret_texts()
    want = slow_disclosure(texts)
    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    for i, rows in enumerate(want):
        spans = sorted([(s, 5, f"term:{s}:{e}") for s, e, _ in rows] + [(s, [k for k, _ in PATTERNS].index(k), f"{k}:{s}:{e}") for k, s, e in slow_base(texts[i])])
        assert got[i].spans == ",".join(x for *_, x in spans), texts[i]
        assert got[i].removed == [s for s, _, x in rows if x >= pii.REMOVE]
    assert want[0] and want[6] and want[8] and not any(want[9:2100])


def test_pii_digest_and_sanitising(spark):
    texts = secret_texts()
    df = doubled(docs(spark, texts))
    found = pii.find(df).collect()
    assert len(found) == df.count()
    by = {r.doc_id: r for r in found}
    for i, t in enumerate(texts):
        base = [f"{k}:{s}:{e}" for k, s, e in slow_base(t)]
        assert by[i].base == ",".join(base) and set(base) <= set(by[i].spans.split(",")) | {""}
    d = {r.doc_id: r for r in pii.digest(df).collect()}
    assert d[len(texts) - 1].base_sha256 == hashlib.sha256(by[len(texts) - 1].base.encode()).hexdigest() and d[0].n_email == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "bob.smith" not in clean[0] and "zebrafish" not in clean[0]
    assert clean[6] == "[NAME] [WORD] [NAME] [WORD] [WORD] [IP] [WORD] w1 w2"
    assert clean[10] == texts[10] and pii.digest(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0


def test_sanitising_rows_without_or_with_one_doc_id(spark):
    rows = [(None, "write to ann@mail.com now", "n"), (1, "a much longer text in here then write ann@mail.com now", "x"), (1, "ip 10.0.0.1", "y"), (None, None, "z"), (2, "", "e"), (3, " \t", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __spans string").withColumn("__removed", F.lit(1)).withColumn("row", F.lit("r")).withColumn("number", F.lit(5))
    got = pii.sanitise(df)
    assert got.columns == df.columns
    out = {r["__spans"]: r.text for r in got.collect()}
    assert len(out) == 6 and not any("ann@" in (t or "") or "10.0" in (t or "") for t in out.values())
    assert "[EMAIL]" in out["n"] and "[EMAIL]" in out["x"] and "[IP]" in out["y"] and (out["z"], out["e"], out["b"]) == (None, "", " \t")
    assert pii.masked("ab cd", "email:0:4,phone:2:5", []) == "[EMAIL]"


@pytest.mark.parametrize("texts", [[None], [""], [" \n", None, ""]])
def test_pii_of_partitions_without_words(spark, texts):
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    assert pii.digest(df).where("spans = ''").count() == len(texts)


# ---- near duplicates ----

def slow_sets(texts):
    out = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def slow_components(texts):
    sets = slow_sets(texts)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ks}


def near_texts():
    rng = np.random.default_rng(3)
    out = edge_texts()
    for g in range(8):
        base = prose(100 + g, int(rng.integers(6, 120))).split()
        for _ in range(12):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 50)}"
            out.append(" ".join(w[int(rng.integers(0, 3)) :]))
    shared = prose(999, 30)
    return out + [f"{prose(200 + i, 25)} {shared} {prose(300 + i, 5)}" for i in range(20)]


@pytest.mark.parametrize(("nearest", "tile", "split", "keys"), [(256, 1024, 1 << 16, 1 << 20), (3, 5, 1 << 16, 1 << 20), (8, 4, 2, 1 << 20), (256, 1024, 1, 0)])
def test_jaccard_join(spark, monkeypatch, nearest, tile, split, keys):
    for name, value in (("NEAREST_TILE", nearest), ("TILE", tile), ("SPLIT", split), ("BROADCAST_KEYS", keys)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = dict(enumerate(near_texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs(spark, texts.values())).collect()}
    assert got == slow_components(texts)


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
def test_buckets(batch):
    """Every class of a part with two or more, with the smallest one; whatever the batches."""
    rng = np.random.default_rng(batch)
    rows = sorted({(int(p), int(c)) for p, c in rng.integers(0, 9, (60, 2))} | {(20, 3), (21, 4), (22, 1), (22, 2)})
    rows = sorted([*rows, *rows[::3]])
    split = {3, 5, 20}
    table = pa.table({"part": [p for p, _ in rows], "key": pa.array([p if p in split else None for p, _ in rows], pa.int64()), "cls": [c for _, c in rows]})
    out = pa.Table.from_batches(jaccard_join._buckets(table.to_batches(max_chunksize=batch))).to_pylist()
    want = set()
    for p in {p for p, _ in rows}:
        members = {c for q, c in rows if q == p}
        if len(members) > 1 or p in split:
            want |= {(p if p in split else None, min(members), c) for c in members}
    assert {(r["key"], r["hub"], r["cls"]) for r in out} == want


def test_jaccard_join_edges(spark):
    df = doubled(docs(spark, edge_texts()))
    got = jaccard_join.join(df).collect()
    assert len(got) == df.count()
    assert [r for r in got if r.doc_id is None][0].component_id is None
    assert jaccard_join.join(df.limit(0)).count() == 0
    kept = jaccard_join.representatives(docs(spark, edge_texts()))
    want = {k for k, (_, c) in slow_components(dict(enumerate(edge_texts()))).items() if c == k}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want


def test_tree_loses_nothing():
    rng = np.random.default_rng(4)
    for n_points in (2, 40, 300):
        counts = (rng.poisson(1, (20, 64))[rng.integers(0, 20, n_points)] + (rng.random((n_points, 64)) < 0.03)).astype(np.int16)
        n, at = counts.sum(axis=1).astype(np.int64), np.arange(n_points)
        tree = jaccard_join.Tree(n, counts, at)
        i, j, room = tree.pairs(at)
        slack = {(a, b): 7 * int(np.minimum(counts[a], counts[b]).sum()) - 3 * int(n[a] + n[b]) for a in at for b in at if a != b and 4 * min(n[a], n[b]) >= 3 * max(n[a], n[b])}
        assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), room.tolist(), strict=True)) == {k: v for k, v in slack.items() if v >= 0}
        assert (len(tree.span) > 1) == (n_points > jaccard_join.LEAF)


def test_representatives_with_clashing_names(spark):
    df = docs(spark, ["a b c d e f"] * 2 + ["x y z"]).withColumn("__kept", F.lit(1)).withColumn("id", F.lit(9)).withColumn("component_id", F.lit("c"))
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 2}


# ---- decontamination ----

def test_decontamination(spark):
    items = [prose(700 + i, n, 5000) for i, n in enumerate((20, 35, 57, 3))]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    changed = items[1].split()
    changed[33] = "other"
    half = " ".join(items[2].split()[:25])
    texts = [*edge_texts(), f"{prose(1, 40, 9000)} {items[0].upper()} {prose(2, 9, 9000)}", f"{prose(3, 5, 9000)} {' '.join(changed)}", f"{half} {prose(4, 60, 9000)}", items[2], f"lead {items[3]} end", prose(5, 200, 9000)]
    n = len(edge_texts())
    df = docs(spark, texts)
    got = {r.doc_id: r.items for r in decontamination.by_document(df, bench).collect()}
    assert {k: v for k, v in got.items() if v} == {n: "0", n + 1: "1", n + 3: "2", n + 4: "3"}
    kept = decontamination.clean(doubled(df), bench)
    assert kept.columns == df.columns and kept.count() == doubled(df).count() - 4
    assert decontamination.by_document(df.limit(0), bench).count() == 0 and decontamination.clean(df, bench.limit(0)).count() == df.count()


def test_decontamination_of_reordered_items(spark):
    a, b = prose(900, 20, 10**6), prose(901, 20, 10**6)
    items = [f"{a} {b}", prose(902, 30, 6), prose(903, 23, 10**6), "x y x"]
    texts = [f"{prose(904, 30, 9000)} {b} {a} {prose(905, 31, 9000)}", f"{b} {a}", prose(906, 400, 6), f"{items[1][9:]} {items[1]}", " ".join(items[2].split()[:20]), f"{prose(907, 9, 9000)} {items[2]} {items[2]}", "x y x y x", f"{a} {prose(908, 20, 9000)} {b}"]

    def shingles(words):
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            w, x = t.split(), x.split()
            for start in range(max(0, len(w) - len(x)) + 1):
                p, q = shingles(w[start : start + len(x)]), shingles(x)
                like = (p & q).total() / (p | q).total()
                if like >= decontamination.SIMILAR:
                    want[d, i, start] = like
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start): r.similarity for r in decontamination.leaks(docs(spark, texts), bench).collect()}
    assert {(0, 0), (1, 0), (4, 2), (5, 2), (6, 3)} <= {k[:2] for k in want} and got == pytest.approx(want)
    whole = {(r.doc_id, r.item_id, r.start): r.similarity for r in decontamination.leaks(docs(spark, texts), bench, exact=True).collect()}
    assert whole == pytest.approx(want)
    assert {r.doc_id for r in decontamination.clean(docs(spark, texts), bench).collect()} == set(range(len(texts))) - {k[0] for k in want}


def test_decontamination_of_edited_items_against_all_windows(spark):
    """Recall over every window of edited items: parts changed, moved, repeated or cut."""
    rng = np.random.default_rng(12)
    items = [prose(920 + i, int(rng.integers(6, 40)), 10**6) for i in range(12)]
    texts = []
    for i in range(90):
        w = items[i % len(items)].split()
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = "changed"
        turn = int(rng.integers(0, len(w))) if i % 3 == 0 else 0
        texts.append(" ".join([*prose(950 + i, int(rng.integers(0, 9)), 9000).split(), *w[turn:], *w[:turn], *w[: i % 7]]))
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            w, x = t.split(), x.split()
            q = Counter(tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4)))
            for start in range(max(0, len(w) - len(x)) + 1):
                v = w[start : start + len(x)]
                p = Counter(tuple(v[j : j + 5]) for j in range(max(1, len(v) - 4)))
                if (p & q).total() / (p | q).total() >= decontamination.SIMILAR:
                    want[d, i, start] = (p & q).total() / (p | q).total()
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    for exact in (False, True):
        got = {(r.doc_id, r.item_id, r.start): r.similarity for r in decontamination.leaks(docs(spark, texts), bench, exact).collect()}
        assert got == pytest.approx(want) and len(want) > 40


def test_decontamination_without_broadcasts_and_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    item = prose(940, 25, 10**6)
    df = docs(spark, ["clean words here", f"lead {item} tail"]).withColumn("text_hash", F.lit("x")).withColumn("id", F.lit(1)).withColumn("__text_hash", F.lit(2))
    bench = spark.createDataFrame([(0, item), (None, item)], "item_id long, text string")
    kept = decontamination.clean(df, bench)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [0]


def test_hamming_index_guarantees_the_radius():
    rng = np.random.default_rng(5)
    near = decontamination.RADIUS // decontamination.BLOCKS
    for _ in range(2000):
        flips = rng.choice(64, int(rng.integers(0, decontamination.RADIUS + 1)), replace=False)
        assert min(Counter(int(x) // 8 for x in flips).get(j, 0) for j in range(8)) <= near


# ---- top k ----

@pytest.mark.parametrize("kind", ["unit", "skewed", "ties"])
@pytest.mark.parametrize("cell", [48 << 20, 9000])
def test_top_k(spark, monkeypatch, kind, cell):
    monkeypatch.setattr(topk, "CELL_BYTES", cell)  # 9000: about ten columns and a few lines of cells
    monkeypatch.setattr(topk, "BUCKET", 50)
    monkeypatch.setattr(topk, "BLOCK", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 24))
    x *= {"unit": 1 / np.linalg.norm(x, axis=1), "skewed": rng.exponential(size=400) ** 3, "ties": np.ones(400)}[kind][:, None]
    if kind == "ties":
        x = np.repeat(np.round(x[:8]), 50, axis=0)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [float("nan")] * 24), (1040, [None] + [1.0] * 23), (1060, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.col("id") % 20 == 0, 5).collect()}
    q = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = {}
    for i in range(0, 400, 20):
        s = q @ q[i]
        for k, j in enumerate([j for j in np.lexsort((np.arange(400), -s)) if j != i][:5]):
            want[i, k + 1] = (j, s[j])
    assert got == want


def slow_top_k(rows, k):
    """Sorted (query id, rank, vec_id, score) over rows (id, vector), row by row."""
    q = {n: (i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for n, (i, a) in q.items():
        if i % 20 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j, m) for m, (j, b) in q.items() if m != n and len(a) == len(b))
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("seeds", [4, 1, 0])
def test_top_k_edges(spark, monkeypatch, seeds):
    monkeypatch.setattr(topk, "CELL_BYTES", 48 << 20 if seeds else 2000)
    monkeypatch.setattr(topk, "SEEDS", seeds)
    monkeypatch.setattr(topk, "BUCKET", 30)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in rng.normal(size=(4, 4, 4, 3, 5)[i % 5])]) for i in range(400)]
    rows += [(0, [1.0, 2.0, 0.5, 1.0]), (40, rows[40][1]), (None, [1.0] * 4), (7, [2.0] * 4), (7, [2.0] * 4), (20, []), (21, []), (60, None), (100, [0.0] * 4), (120, [2e7] * 3), (121, [2e7, -2e7, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("id", "transform(v, x -> float(x)) v").withColumn("row", F.lit("x")).withColumn("dim", F.lit(None).cast("int"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, 6).collect())
    assert got == slow_top_k(rows, 6)
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [0.0, 0.0])], "id long, v array<float>")
    assert topk.top_k(few, F.col("id") % 20 == 0, 20).count() == 4


# ---- html ----

@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        ("<html><body><nav><a href=x>menu here</a></nav><article><h1>T</h1><p>Some words, and more.<br>x<p>Second&nbsp;one</article><footer>foot</footer></body>", "T Some words, and more. x Second one"),
        ("<div class='ad'>buy this now, or else, please</div><div id=content><p>The story begins here, with a long sentence that matters.</p><script>var t='</p>';</script><p>And it ends.</p></div><div class=comments><p>First! a reader says something rather long here, too.</p></div>", "The story begins here, with a long sentence that matters. And it ends."),
        ("<article><p>a<b>b</b>c</p><form>x</form><aside>y</aside><!-- <p>no</p> --><ul><li>one<li>two</ul>", "abc one two"),
        ("<p>unclosed <a href='x>y</p><p>end", None), ("<" * 3000, None), ("<b>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text(html, text):
    got = html_text.main_text(html)
    assert isinstance(got, str) and (text is None or got == text)


LONG = "The story goes on and on, with commas, clauses, and a long tail of words that matter to the reader."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>Good text, today.</p>" + "<div>" * 900 + "<nav><ul><li>MENU ITEM</ul></nav>" + "</div>" * 900 + "<p>More.</p></article>", "Good text, today. More."),
        (f"<article class='post-header related-work'><h2>Related work</h2><p>{LONG}</p><section class='related-work'><p>Section kept.</p></section><div class=related-posts>drop</div><div class='share-buttons'>drop</div></article>", f"Related work {LONG} Section kept."),
        (f"<body><div id=c><p>{LONG}</p></div><h2>Heading two</h2><p>Tiny para</p><ul><li>an item</ul>loose<div><a href=/a>all</a> <a href=/b>links</a></div></body>", f"{LONG} Heading two Tiny para an item loose"),
        (f"<div><p>{LONG} see <a href=/x/>there</a> and on</p><p><a name='y'/>End.</p></div>", f"{LONG} see there and on End."),
        (f"<div class=sidebar><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><p class='ad'>buy</p><h2 class='related-posts'>more</h2><p id=advertisement>now</p></article>", LONG),
        (f"<div><header class=site-header>top</header><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><div class='cookieNotice'>we use</div></div>", f"Title {LONG}"),
        (f"<body><form id='aspnetForm' action=x><input name=q><div class=content><h2>On ships</h2><p>{LONG}</p><p>{LONG}</p><label>Name</label><select><option>one</select></div></form></body>", f"On ships {LONG} {LONG}"),
        (f"<body><form id=f><main><h1>Title</h1><p>{LONG}</p><button>Send</button></main></form></body>", f"Title {LONG}"),
        (f"<body><div><p>{LONG}</p></div><form><p>Subscribe to our letter, and never miss a post again.</p><input></form></body>", LONG),
        ("<body><form><label>User</label><input><button>Log in</button></form></body>", ""),
        (f"<article><h1 class=page-header>Head</h1><p>{LONG}</p><section id='social-sciences'><p>Sociology, too.</p></section><section id='ship-navigation'><p>By the stars.</p></section><section class='lunch-menu'><ul><li>Soup<li>Bread</ul></section><div class='quick-nav'><a href=a>one</a> <a href=b>two</a></div><div class=social-links>follow us</div></article>", f"Head {LONG} Sociology, too. By the stars. Soup Bread"),
        (f"<main><header><h1>Title</h1></header><p>{LONG} Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> be.</p></main>", f"Title {LONG} Let x=2 be."),
        ("<b>" * 50_000 + "deep" + "</i>" * 50_000, "deep"), ("<td>" * 3 + "<b>x" * 20_000 + "</i>" * 20_000, "x" * 20_000),
    ],
)
def test_main_text_without_losses(html, text):
    assert html_text.main_text(html) == text


def slow_article(html):
    """Text of the article element by the standard library's parser, for pages made of known parts."""
    from html.parser import HTMLParser

    blocks = set("address article aside blockquote div dl dt dd fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr td th ul".split())
    drop = {"nav", "footer", "aside", "form", "button"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skip, self.out = 0, [], []

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip.append(tag)
            elif tag == "article":
                self.inside += 1
            elif self.skip or tag in drop or set((dict(attrs).get("class") or "").split()) & {"ad", "comments", "sidebar"}:
                if tag not in ("br", "p", "li", "img", "input", "hr"):
                    self.skip.append(tag)
            if tag in blocks or tag == "br":
                self.out.append(" ")

        def handle_endtag(self, tag):
            if self.skip and tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            elif tag == "article":
                self.inside -= 1
            if tag in blocks:
                self.out.append(" ")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.out.append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    return " ".join("".join(reader.out).split())


def test_main_text_against_a_slow_parser():
    rng = np.random.default_rng(14)
    inline = ["{}", "<b>{}</b>", "<a href='/l'>{}</a>", "{} &amp; &eacute;&#8212;{}", "<em>{}<br>{}</em>", "<!-- no -->{}", "<span class=x>{}</span>"]
    block = ["<p>{}</p>", "<p>{}", "<div>{}</div>", "<ul><li>{}<li>{}</ul>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}<td>{}</table>", "<section><p>{}</section>", "<pre>{}\n  {}</pre>"]
    noise = ["<aside>{}</aside>", "<div class=ad>{}</div>", "<form><button>{}</button></form>", "<script>'</p>{}'</script>", "<style>{}</style>", "<nav><ul><li>{}</ul></nav>", "<section class='comments'><p>{}</section>"]

    def fill(pattern):
        return re.sub(r"\{\}", lambda _: inline[int(rng.integers(len(inline)))].replace("{}", prose(int(rng.integers(1 << 30)), int(rng.integers(1, 12))) + rng.choice([",", ".", ""])), pattern)

    for _ in range(120):
        body = "".join(fill((noise if rng.random() < 0.3 else block)[int(rng.integers(7))]) for _ in range(int(rng.integers(3, 25))))
        page = f"<html><head><title>t</title></head><body>{fill(noise[5])}<article><h1>{fill('{}')}</h1>{body}</article>{fill(noise[0])}<footer>{fill('{}')}</footer></body></html>"
        assert html_text.main_text(page) == slow_article(page), page


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hé llo</p>", "x"), (2, None, None, "y"), (None, "w", "", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, "w", "", 0), (1, "u", "Hé llo", 6), (2, None, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- sharding ----

@pytest.mark.parametrize("hot", [0, 300])
def test_sharding(spark, hot):
    texts = ["same text again"] * hot + [prose(i, i % 40) for i in range(600)] + edge_texts()
    df = docs(spark, texts)
    got = sharding.shard(df, 10).toPandas()
    size = {i: len((t or "").encode()) + 16 for i, t in enumerate(texts)}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in enumerate(texts)}
    assert len(got) == len(texts) and {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == {i: (size[i], crc[i]) for i in size}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    key = lambda i: (int(hashlib.md5((texts[i] or "").encode()).hexdigest()[:12], 16), i)
    before, total, shard = 0, sum(size.values()), dict(zip(got.doc_id, got["shard"], strict=True))
    for i in sorted(size, key=key):
        assert shard[i] == min(9, before * 10 // total), i
        before += size[i]


def test_sharding_edges(spark):
    df = doubled(docs(spark, edge_texts()))
    assert sharding.shard(df).count() == df.count() and sharding.shard(df.limit(0)).count() == 0 and sharding.shard(df.limit(1)).count() == 1


def test_sharding_keeps_columns(spark):
    df = docs(spark, ["b", None, "c", "b"]).withColumn("k1", F.lit("x")).withColumn("row", F.lit("y"))
    got = sharding.shard(df, 2, keep=True)
    assert [c for c in df.columns if c != "shard"] == got.columns[: len(df.columns) - 1]
    assert sorted((r.doc_id, r.text or "", r.k1, r.row, r.key) for r in got.collect()) == [(0, "b", "x", "y", "k"), (1, "", "x", "y", "k"), (2, "c", "x", "y", "k"), (3, "b", "x", "y", "k")]


# ---- repeats ----

def slow_repeats(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone, new = bytearray(len(b)), []
        for i in range(len(b) - 49):
            if b[i : i + 50] in seen:
                gone[i : i + 50] = b"\1" * 50
            else:
                new.append(b[i : i + 50])
        seen.update(new)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def repeat_texts():
    rng = np.random.default_rng(8)
    pieces = [prose(400 + i, 14, 3000)[: int(rng.integers(45, 90))] for i in range(6)] + ["con, " * 30, "é日" * 20, "x" * 120]
    out = [t if t is None or len(t) < 5000 else t[:5000] for t in edge_texts()]
    for i in range(60):
        out.append(prose(500 + i, int(rng.integers(0, 30)), 3000) + "".join(pieces[int(j)] for j in rng.integers(0, len(pieces), int(rng.integers(0, 4)))) + prose(600 + i, 6, 3000))
    return out


@pytest.mark.parametrize(("hot", "flush", "spread"), [(16384, 1 << 18, 32), (1, 1 << 18, 32), (4096, 40, 1), (4096, 300, 3), (2, 1 << 20, 0)])
def test_repeats(spark, monkeypatch, hot, flush, spread):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "FLUSH", flush)
    monkeypatch.setattr(repeats, "SPREAD", spread)
    texts = dict(enumerate(repeat_texts()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove(docs(spark, texts.values())).collect()}
    assert got == slow_repeats(texts)


def test_repeats_edges(spark):
    df = doubled(docs(spark, repeat_texts()))
    got = repeats.remove(df).collect()
    assert len(got) == df.count() and [r for r in got if r.doc_id is None][0].n_removed == 0
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in got)
    assert repeats.remove(df.limit(0)).count() == 0


def test_interval_tree():
    rng = np.random.default_rng(9)
    for _ in range(200):
        common = rng.integers(0, 4, int(rng.integers(0, 12)))
        want = set()
        for i in range(len(common)):
            for j in range(i, len(common)):
                d = common[i : j + 1].min()
                if d and (i == 0 or common[i - 1] < d) and (j + 1 == len(common) or common[j + 1] < d):
                    want.add((i, j + 1, d, max(common[i - 1] if i else 0, common[j + 1] if j + 1 < len(common) else 0)))
        assert set(repeats.intervals(common)) == want


# ---- mixing ----

def key_of(x):
    return x if isinstance(x, str) else "\x00"


def test_schedule_stays_within_a_block_of_the_targets():
    rng = np.random.default_rng(10)
    cases = [{f"s{i}": int(w) for i, w in enumerate(rng.integers(1, 300, int(rng.integers(1, 30))))} for _ in range(15)]
    for given in [*cases, {"a": 700, "b": 200, "c": 100, "d": 1}, {"a": 5, "b": 10}, {str(i): 1 for i in range(1500)}]:
        weights = mixing.reduced(given)
        total = sum(weights.values())
        place = mixing.schedule(weights)
        assert sorted(t for s in place.values() for t in s) == list(range(total))
        for x, w in list(weights.items())[:40]:
            t = np.arange(total)
            done = np.cumsum(np.isin(t, place[x]))
            assert (abs(done - (t + 1) * given[x] / sum(given.values())) < 1).all()
        part = mixing.schedule(weights, total // 3)
        assert all(part[x] == [t for t in place[x] if t < total // 3] for x in weights)
    assert mixing.schedule({}) == {} and mixing.reduced({"a": 0}) == {}


def deviates(got, weights, block):
    """The most that any source is off its target, in blocks, over the mixed slots."""
    mixed = got[got.mixed].drop_duplicates("slot").sort_values("slot")
    assert list(mixed.slot) == list(range(len(mixed)))
    total, worst = sum(weights.values()), 0
    for s, w in weights.items():
        done = np.cumsum([key_of(x) == s for x in mixed.source])
        worst = max(worst, abs(done - np.arange(1, len(done) + 1) * w / total).max(initial=0))
    return worst, len(mixed)


@pytest.mark.parametrize("broadcast", [1 << 22, 0])
def test_mixing(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", broadcast)
    monkeypatch.setattr(mixing, "_GROUP", 100)
    df = docs(spark, [prose(i, 5) for i in range(900)] + edge_texts(), sources=("a", "a", "a", "b", None))
    got = mixing.mix(df, block=8).toPandas()
    assert len(got) == df.count() and not got.duplicated(["slot", "place"]).any()
    assert deviates(got, mixing.tempered(Counter(map(key_of, got.source))), 8)[0] < 1
    scheduled = got[got.mixed]
    assert (scheduled.release <= scheduled.slot).all() and (scheduled.slot < scheduled.deadline).all()
    only = mixing.mix(df, {"b": 1}, 8).toPandas()
    assert set(only[only.mixed].source) == {"b"} and len(only) == len(got) and not only.duplicated(["slot", "place"]).any()
    rows = mixing.in_order(doubled(df).withColumn("__rank", F.lit("mine")).withColumn("slot", F.lit("s")).withColumn("row", F.lit(1)))
    assert rows.columns[-3:] == ["__rank", "slot", "row"] and {(r["__rank"], r.slot) for r in rows.collect()} == {("mine", "s")}
    assert rows.count() == doubled(df).count() and mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_many_periods_and_of_a_tiny_source(spark):
    weights = {"a": 7, "b": 2, "c": 1, "d": 1}
    rows = [(i, "t", "ab"[i % 9 >= 7] if i % 10 else "cd"[i % 20 // 10]) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, 2).toPandas()
    worst, n = deviates(got, weights, 2)
    assert worst < 1 and n > 100 * 11
    tiny = spark.createDataFrame([*rows, (9999, "t", "tiny")], "doc_id long, text string, source string")
    got = mixing.mix(tiny, weights | {"tiny": 1}, 2).toPandas()
    assert deviates(got, weights | {"tiny": 1}, 2)[0] < 1
    # weights whose period is far longer than the table, so only a part of it is laid out
    big = {"a": 700_000_001, "b": 200_000_003, "c": 100_000_007, "d": 90_000_001}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), big, 2).toPandas()
    worst, n = deviates(got, big, 2)
    assert worst < 1 and n > 500 and len(got) == 4000 and not got.duplicated(["slot", "place"]).any()


def test_mixing_by_the_stated_recipe(spark):
    """The registered query's targets: unequal, kept to within a block, null apart from a source named U+0000."""
    rows = [(i, "t", (None, "\x00", "src1", "src2", "src3")[i % 5]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = mixing.stated(df)
    assert set(weights) == {None, "\x00", "src1", "src2", "src3"} and len(set(weights.values())) > 2
    got = mixing.mix(df, weights, 4).toPandas()
    mixed = got[got.mixed].drop_duplicates("slot").sort_values("slot")
    total = sum(weights.values())
    assert len(mixed) > 5 * total and list(mixed.slot) == list(range(len(mixed))) and len(got) == 6000
    for s, w in weights.items():
        done = np.cumsum([x is None if s is None else x == s for x in mixed.source])
        assert abs(done - np.arange(1, len(done) + 1) * w / total).max() < 1


def test_mixing_of_more_sources_than_rows_in_a_block(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    got = mixing.mix(df, block=2).toPandas()
    assert len(got) == 3000 and got.mixed.all() and not got.duplicated(["slot", "place"]).any()


# ---- all of them ----

def test_no_folder_is_made_up_on_a_cluster(spark):
    from types import SimpleNamespace

    from framescope.llm import common

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId="app"))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077"))
    assert common.shared_dir(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y/app"
