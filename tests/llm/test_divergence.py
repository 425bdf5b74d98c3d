from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panel_engine.llm import divergence
from tests.llm.cases import DOC_SCHEMA, awkward, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, k=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in seen.items()}
    share = lambda c, n, v: 1 + 1000000000 * (c + 1) // (n + v)
    out = []
    for lang, source in groups:
        terms = kept.get(lang, set())
        v = len(terms)
        own = counts[lang, source]
        n = sum(own[t] for t in terms)
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            m = sum(counts[lang, other][t] for t in terms)
            total = 0
            for t in terms:
                p, q = share(own[t], n, v), share(counts[lang, other][t], m, v)
                total += (p - q) * (p - q) // q
            pairs.append((-total, other.encode(), other))
        of_lang = Counter()
        for x, s in groups:
            if x == lang:
                of_lang.update(counts[x, s])
        m = sum(of_lang[t] for t in terms)
        best = []
        for t in terms:
            if own[t]:
                p, q = share(own[t], n, v), share(of_lang[t], m, v)
                if p > q:
                    best.append((-((p - q) * (p - q) // q), t.encode(), t))
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:k])):
            out += [(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(rnd, n):
    words = [f"{a}{b}" for a in ("ab", "Ab", "é", "\U0001f600", "ﬁ", "z") for b in "qrstuvwxyzé"] + ["THE"] * 20
    langs = ["en"] * 5 + ["de", "", None]
    return [(i, " ".join(rnd.choice(words[k % 5:]) for _ in range(rnd.randint(0, 40))), rnd.choice(langs),
             rnd.choice(["hot"] * 6 + [None, "", "s1", "é", "s:2"]), 0) for i, k in enumerate(range(n))]


@pytest.mark.parametrize("cells,held", [(1 << 21, 1 << 18), (40, 50)])
def test_equals_brute_force(spark, monkeypatch, cells, held):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD", held)
    if cells == 40:  # many blocks, buckets and merges
        for name, size in (("BUCKET", 60), ("PART", 8), ("MERGED", 2), ("STEP", 3)):
            monkeypatch.setattr(divergence, name, size)
    rows = corpus(random.Random(cells), 500)
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    assert audited(df, k=9) == brute([(r[2], r[3], r[1]) for r in rows], k=9)


def test_skyband_keeps_what_fewer_than_k_dominate(monkeypatch):
    monkeypatch.setattr(divergence, "STEP", 7)
    rnd = random.Random(2)
    for _ in range(60):
        n, k = rnd.randint(0, 60), rnd.choice([1, 2, 5])
        rows = [(rnd.randrange(6), rnd.randrange(6), str(rnd.randrange(10**6)).encode()) for _ in range(n)]
        rows = list({r[2]: r for r in rows}.values())
        want = {i for i, b in enumerate(rows) if sum(a[0] >= b[0] and a[1] <= b[1] and a[2] < b[2] for a in rows) < k}
        c, low, term = (np.array(x) for x in ([r[0] for r in rows], [r[1] for r in rows], [0] * len(rows)))
        term = np.array([r[2] for r in rows], object)
        assert set(divergence.skyband(c.astype(np.int64), low.astype(np.int64), term, k).tolist()) == want


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 3)], "c long, n long, v long")
    got = df.select(divergence.share("c", "n").alias("p")).first().p
    assert got == 1 + 1000000000 * (9_000_000_000_000 + 1) // (9_000_000_000_001 + 3)


def test_awkward_rows(spark):
    docs = awkward(spark)
    docs = docs.unionByName(docs).unionByName(docs).selectExpr("*", "1 as term", "2 as c", "3 as v", "4 as n", "5 as item", "6 as `value`")
    want = brute([(r.lang, r.source, r.text) for r in docs.collect()])
    assert audited(docs) == want and any(r[0] == "" and r[2] == "pair" for r in want)
    once = awkward(spark).where("lang = 'de'")
    assert {r[4] for r in audited(once)} <= {0} and audited(once) == brute([(r.lang, r.source, r.text) for r in once.collect()])
    assert audited(empty(spark)) == []
