"""The pipeline on a small corpus against its stages' meaning."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark, tmp_path):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        texts.append(" ".join(word().upper() + "!!" if bad else word() for _ in range(40)))
        labels.append((i, int(not bad), 0))
    item = " ".join(word() for _ in range(20))
    texts[7] = f"{texts[7]} {item}"
    texts += [texts[1], texts[2] + " extra", None]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    kept = {i for i in range(300) if i % 5} - {7}
    assert kept <= set(got.doc_id) <= kept | {302} and not {300, 301} & set(got.doc_id)
    assert not got.doc_id.duplicated().any() and got["shard"].between(0, 39).all()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns, name
    assert Counter(bool(re.search("!!", t or "")) for i, t in enumerate(texts) if i in set(got.doc_id))[True] == 0


def test_shards_follow_the_mix(spark, tmp_path):
    """run's rows, read shard by shard, are the mix of what decontamination keeps; without the mixing
    stage they are not."""
    from framescope.llm import mixing
    from framescope.llm.common import cut

    rows = [(i, f"text {i} " * (1 + i % 7), "en", "abbbbbbb"[i % 8], 3) for i in range(2000)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    *_, (_, mix), (_, shard) = pipeline.STAGES
    got = shard(spark, cut(mix(spark, docs, "")), "").toPandas().sort_values(["shard", "slot"])
    want = mixing.mix(docs).toPandas().sort_values(["slot", "place"])
    assert list(got.doc_id) == list(want.doc_id) and set(docs.columns) < set(got.columns)
    assert list(got.text) == [rows[i][1] for i in got.doc_id]
    size = got["size"].to_numpy()
    assert list(got["shard"]) == [int(b * 40 // size.sum()) for b in size.cumsum() - size]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    without = shard(spark, docs, "").toPandas().sort_values(["shard", "slot"])
    assert list(without.doc_id) != list(got.doc_id)
    assert shard(spark, spark.createDataFrame(rows[:5], docs.schema), "").count() == 5


def slow_mix(rows, block=64):
    """(source, doc_id) in the order of an earliest-deadline-first mix, slot by slot."""
    by = {}
    for i, s in rows:
        by.setdefault("\x00" if s is None else s, []).append(i)
    for x in by.values():
        x.sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:12], i))
    raw = {s: math.isqrt(len(x)) for s, x in by.items()}
    weight = {s: w // math.gcd(*raw.values()) for s, w in raw.items()}
    period, blocks = sum(weight.values()), {s: -(-len(x) // block) for s, x in by.items()}
    ends = min(-(-(blocks[s] + 1) * period // w) for s, w in weight.items())
    full, done, slot, t = ends >= period, dict.fromkeys(by, 0), {}, 0
    while t < ends or full and any(done[s] < blocks[s] for s in by):
        ready = [(-(-(done[s] + 1) * period // w), s) for s, w in weight.items() if done[s] * period // w <= t]
        s = min(ready)[1]
        slot[s, done[s]] = t
        done[s] += 1
        t += 1
    behind = max(-(-blocks[s] // w) for s, w in weight.items()) * period
    order = []
    for nth, s in enumerate(sorted(by)):
        for k, i in enumerate(by[s]):
            order.append((slot.get((s, k // block), behind + k // block * len(by) + nth), s, k % block, i))
    return [i for *_, i in sorted(order)]


def test_run_against_a_slow_version(spark, tmp_path):
    """Every row of run(): which documents stay, and their shards and slots, stage by stage in plain Python."""
    from test_corpus import slow_components

    from framescope.llm import quality

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmn"), 7))
    texts = []
    for i in range(700):
        words = [word() for _ in range(int(rng.integers(8, 60)))]
        texts.append(" ".join(w.upper() + "!!" for w in words) if i % 6 == 0 else " ".join(words))
    items = [" ".join(word() for _ in range(24)) for _ in range(3)]
    for k, i in enumerate((31, 200, 401)):
        texts[i] += " " + items[k]
    texts[77] = items[0].replace(items[0].split()[3], "changed", 1)  # an edited item alone
    texts += [texts[5], texts[5] + " more", texts[10], "", None, "one two"] + [texts[i] + " x" for i in range(20, 60)]
    rows = [(i, t, "en", ("a", "a", "b", None, "a")[i % 5], 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(700)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {i for i in range(700) if i % 6} <= good and not {i for i in range(0, 700, 6)} & good
    kept = sorted(good)
    roots = slow_components({i: texts[i] for i in kept})
    kept = [i for i in kept if roots[i][1] == i]

    def shingles(words):
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    def leaks(text):
        words = (text or "").lower().split()
        for item in items:
            want, n = shingles(item.split()), len(item.split())
            for at in range(max(0, len(words) - n) + 1):
                have = shingles(words[at : at + n])
                if words and 4 * (want & have).total() >= 3 * (want | have).total():
                    return True
        return False

    kept = [i for i in kept if not leaks(texts[i])]
    assert not {31, 200, 401} & set(kept) and 500 < len(kept) < 600
    order = slow_mix([(i, rows[i][3]) for i in kept])
    sizes = [len((texts[i] or "").encode()) + 16 for i in order]
    want, before, at = [], 0, Counter()
    for i, n in zip(order, sizes):
        shard = before * 40 // sum(sizes)
        want.append((i, texts[i], n, shard, at[shard]))
        at[shard] += 1
        before += n
    got = pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "size", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
