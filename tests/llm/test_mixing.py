from __future__ import annotations

import random
import re

from panel_engine.llm import mixing
from tests.llm.cases import awkward, empty


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Water filling: whoever is above its cap is fixed there and the rest shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, texts):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.shard < 16
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1, (s, t, want[s])


def corpus(spark, n=3000, parts=3):
    rnd = random.Random(11)
    rows = [(i, "w " * int(rnd.paretovariate(0.9)), rnd.choice(["hot"] * 12 + ["a", "b", "", None, "é", "\U0001f600", "zz"])) for i in range(n)]
    rows += [(n, "w " * 5000, "tiny"), (n + 1, "", "none")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts), {r[0]: r[1] for r in rows}


def test_each_source_meets_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_DOCS", 4)  # a deep tree
    docs, texts = corpus(spark)
    rows = mixing.mix(docs).collect()
    check(rows, texts)
    split = [r for r in rows if r.source == "hot" and 0 < r.taken % max(r.size, 1)]
    assert len(split) < 800  # leaves cut one document each, not every document
    per_shard = {}
    for r in rows:
        if r.source == "hot":
            per_shard[r.shard] = per_shard.get(r.shard, 0) + r.taken
    assert len(per_shard) == 16


def test_reruns_agree(spark):
    docs, _ = corpus(spark, 500)
    again, _ = corpus(spark, 500, parts=7)
    key = lambda df: sorted(map(tuple, mixing.mix(df).collect()), key=repr)
    assert key(docs) == key(again.withColumn("extra", again.text))


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as size", "2 as k", "3 as target", "4 as `order`")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id = 5")).collect()] == [0]
