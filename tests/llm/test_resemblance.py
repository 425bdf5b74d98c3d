from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from panel_engine.llm import resemblance as rs
from tests.llm.cases import DOC_SCHEMA


def brute(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))}


def likeness(a, b):
    a, b = brute(a), brute(b)
    return len(a & b) / len(a | b)


def pair(rnd, least, most, n=300):
    """A text and an edited copy with a Jaccard similarity between the two."""
    while True:
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        copy = list(words)
        while (j := likeness(" ".join(words), " ".join(copy))) >= most:
            copy[rnd.randrange(n)] = f"w{rnd.randrange(10**6)}"
        if j >= least:
            return " ".join(words), " ".join(copy)


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOC_SCHEMA)
    return {r.doc_id for r in cp.deduplicated(spark, docs, "").collect()}


def test_pairs_of_known_similarity(spark):
    rnd, texts, bounds = random.Random(1), [], [(0.80, 0.82), (0.84, 0.86), (0.89, 0.91), (0.94, 0.96)]
    for least, most in bounds:
        for _ in range(60):
            texts += pair(rnd, least, most)
    for _ in range(60):
        texts += pair(rnd, 0.74, 0.79)
    got = kept(spark, texts)
    lost = [sum(i not in got for i in range(120 * b + 1, 120 * b + 120, 2)) for b in range(5)]
    print("near copies found of 60 each, from 0.80, 0.84, 0.89, 0.94, 0.74 on:", lost)
    assert set(range(0, len(texts), 2)) <= got
    assert lost[0] >= 50 and lost[1] >= 56 and lost[2] >= 59 and lost[3] == 60
    assert lost[4] == 0  # not alike enough, whatever their fingerprints


@pytest.mark.parametrize("pairwise,per_member", [(256, 8), (2, 0)])
def test_crowded_keys_lose_no_candidate(spark, monkeypatch, pairwise, per_member):
    """With a leader asked first and the rest in a second round, the groups are those of all pairs."""
    monkeypatch.setattr(rs, "PAIRWISE", pairwise)
    monkeypatch.setattr(rs, "PER_MEMBER", per_member)
    rnd, texts = random.Random(2), []
    for _ in range(3):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randint(1, 4)):
                copy[rnd.randrange(400)] = f"w{rnd.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [texts[0], "", " ", "one two"]
    assert kept(spark, texts) == {0, 25, 50, 76, 78}


def test_rows_that_share_an_id(spark):
    """Different texts of one id stay, in any partitioning; of near copies the same row stays."""
    rnd = random.Random(3)
    a, b = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(200)) for _ in range(2))
    rows = [(1, a, "en", "a", 1), (1, b, "en", "a", 1), (1, a + " end", "en", "a", 1), (2, b, "en", "a", 1), (1, a, "en", "a", 1)]
    seen = set()
    for some in (rows, rows[::-1]):
        got = cp.deduplicated(spark, spark.createDataFrame(some, DOC_SCHEMA).repartition(3), "").collect()
        assert [r.doc_id for r in got] == [1, 1] and {r.text == b for r in got} == {True, False}
        seen.add(frozenset(r.text for r in got))
    assert len(seen) == 1


def test_copies_of_one_text_ask_two_candidates_each(spark, monkeypatch):
    """Of many near copies, the pairs whose texts are compared stay in proportion to the documents."""
    counted, verified = [], rs.verified
    monkeypatch.setattr(rs, "verified", lambda pairs, *rest: counted.append(pairs.count()) or verified(pairs, *rest))
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base[:j] + [f"x{j}"] + base[j + 1:]) for j in range(120)]
    assert kept(spark, texts) == {0}
    assert sum(counted) <= 2 * len(texts)


def test_families_whose_members_are_not_alike_are_compared_without_a_row_per_pair(spark, monkeypatch):
    """Copies that are like their base but hardly like each other, by which the first round links few of them."""
    made, verified = [], rs.verified
    monkeypatch.setattr(rs, "verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(rs, "BLOCK", 40, raising=False)
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(149):
        copy = list(base)
        for j in rnd.sample(range(150), rnd.randint(1, 6)):
            copy[j] = f"x{i}_{j}"
        texts.append(" ".join(copy))
    sets = [rs.shingles(t.encode(), 5) for t in texts]
    linked, left = {0}, set(range(1, 150))
    while more := {i for i in left if any(rs.alike(sets[i], sets[j]) for j in linked)}:
        linked, left = linked | more, left - more
    assert 20 < len(linked) < 150
    rest = [i for i in sorted(left)]
    apart = all(not rs.alike(sets[i], sets[j]) for i in rest for j in rest if i < j)
    got = kept(spark, texts)
    assert apart and got == {0, *rest}
    assert sum(made) <= 10 * len(texts)


def test_matches_counts_in_parts(monkeypatch):
    monkeypatch.setattr(rs, "SHINGLES", 7)
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(30, 200))).astype(np.uint64) for _ in range(30)] + [np.array([1000], np.uint64)]
    want = [(i, j) for i in range(31) for j in range(i) if rs.alike(sets[i], sets[j])]
    assert want and want == list(zip(*[x.tolist() for x in np.nonzero(np.tril(rs.matches(sets), -1))]))


def test_leads_connect_what_is_near():
    fp = np.array([0, (1 << 17) - 1, (1 << 34) - 1, (1 << 64) - 1], np.uint64)
    assert rs.leads(fp).tolist() == [0, 0, 0, 3]
