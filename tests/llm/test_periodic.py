from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panel_engine.llm import periodic, queries
from tests.llm.cases import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least_words=6, least_periods=4):
    """Every maximal stretch for every period, kept if no smaller period fits it."""
    n, out = len(w), []
    for p in range(1, n // least_periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least_words, least_periods * p):
                part = w[i:i + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(w, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(w, *least):
    codes = np.array(w, np.int64)
    places = periodic.repeated(codes, np.full(len(w), len(w)), periodic.least_prefix(*least))
    return periodic.runs(codes, places, *least) if len(places) else []


def stutter(rnd, n, kinds):
    w = []
    while len(w) < n:
        w += [rnd.randrange(kinds) for _ in range(rnd.randint(1, 7))] * rnd.randint(1, 7)
    return w


@pytest.mark.parametrize("block", [2, 1024])
def test_runs_are_those_of_brute_force(block, monkeypatch):
    monkeypatch.setattr(periodic.Positions, "BLOCK", block)
    rnd = random.Random(7)
    for _ in range(1500):
        kinds = rnd.choice([1, 2, 3, 5])
        w = stutter(rnd, rnd.randint(0, 70), kinds) if rnd.random() < 0.7 else [rnd.randrange(kinds) for _ in range(rnd.randint(0, 70))]
        least = rnd.choice([(6, 4), (6, 4), (2, 2), (3, 2), (5, 3)])
        assert found(w, *least) == brute_runs(w, *least), w


def test_long_runs():
    assert found([1] * 30000, 6, 4) == [(0, 30000, 1)]
    tail = list(range(5000)) * 5
    assert found([7, *tail], 6, 4) == [(0, 25001, 5000)] if tail[4999] == 7 else [(1, 25000, 5000)]


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as runs", "2 as kept", "3 as __text2")
    rows = periodic.find_runs(docs).collect()
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert len(rows) == len(texts)
    want = sorted(((k, brute_kept(WORD.findall(t or ""), brute_runs(WORD.findall(t or "")) if k != 9 else [])) for k, t in texts), key=repr)
    assert sorted(((r.doc_id, r.kept) for r in rows), key=repr) == want
    assert periodic.find_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, least_periods=1)


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(brute_kept(w, runs)))


def test_query(spark, tmp_path):
    rnd = random.Random(13)
    docs = [(i, " ".join(map(str, stutter(rnd, rnd.randint(0, 120), rnd.choice([2, 40]))))) for i in range(300)]
    docs += [(300 + i, t) for i, t in enumerate([None, "", " \n", "ab c " * 9, "é\x1cx é\x1cx é\x1cx é\x1cx é\x1cx é\x1cx"])]
    # every text under a key that rewrites it, too
    rewriting = [k for k in range(1000, 9000) if zlib.crc32(str(k).encode()) % 10 == 0]
    docs += [(k, t) for k, (_, t) in zip(rewriting, docs)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in queries.op13(spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted(expected(*d) for d in docs)


def test_tail_of_a_null_key_stays(spark):
    df = spark.createDataFrame([(None, "a b  c")], "doc_id long, text string")
    assert df.select(periodic.with_periodic_tail().alias("t")).first().t == "a b  c"
    assert df.select(F.size(F.split("text", " ")).alias("n")).first().n == 4
