from __future__ import annotations

import math
import random
import zlib

import numpy as np

from panel_engine.llm import language, toxicity
from tests.llm.cases import DOC_SCHEMA, awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def brute_segments(scores):
    """Maximal segments by their definition: recursively the best-scoring stretch, shortest and leftmost of equals."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[0] or s == best[0] and (j - i) < best[2] - best[1]):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return brute_segments(scores[:i]) + [(i, j, s)] + [(a + j, b + j, t) for a, b, t in brute_segments(scores[j:])]


def test_segments_equal_definition():
    rnd = random.Random(4)
    for _ in range(300):
        scores = [rnd.randint(-64, 64) / 16 + rnd.random() / 1024 for _ in range(rnd.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        want = brute_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_rate_solves_its_equation():
    value, share = np.array([-0.1, 4.0]), np.array([0.999, 0.001])
    rate = toxicity.solve_rate(value, share)
    assert abs((share * np.exp(rate * value)).sum() - 1) < 1e-6


def corpus(spark, n=900):
    rnd = random.Random(6)
    insults, words = ["nasty", "vilebeast", "scumbag"], [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(30, 300))]
        toxic = rnd.random() < 0.3
        if toxic:
            at = rnd.randrange(len(w))
            w[at:at] = [rnd.choice(insults) if rnd.random() < 0.5 else rnd.choice(words) for _ in range(14)]
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, DOC_SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS)


def test_held_out_labels(spark):
    docs, labels = corpus(spark)
    held = language.held_out("doc_id", 5, 0)
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(held).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(rows) > 100
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in rows) / len(rows) > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        for p in r.passages:
            assert any(x in texts[r.doc_id][p.start:p.end] for x in ("nasty", "vilebeast", "scumbag")) and p.expected < 0.05


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as score", "2 as k", "3 as y", "4 as passages")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (3, None, None), (None, 1, 1), (9, 0, 0), (77, 0, 1)], LABELS)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    assert all(not r.passages for r in rows if r.doc_id in (4, 5, 6))
    nothing = toxicity.fit(empty(spark), labels.limit(0))
    assert toxicity.score(empty(spark), nothing).count() == 0 and toxicity.score(docs, nothing).count() == docs.count()
