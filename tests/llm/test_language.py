from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panel_engine.llm import language
from tests.llm.cases import DOC_SCHEMA, awkward, empty

SYLLABLES = {"en": ["th", "ing", "er", "and", "ou"], "de": ["sch", "ung", "ein", "keit", "ß"], "fr": ["eau", "elle", "é", "que", "oi"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus(n=240):
    rnd = random.Random(5)
    return [(i, text(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.randint(1, 60)), lang, "s", 0) for i in range(n)]


def brute_marginals(scores, move):
    n, k = scores.shape
    gamma, pairs, z = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(scores[i, s] for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        z += w
        for i, s in enumerate(path):
            gamma[i, s] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return gamma / z, pairs / z


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 3, 6, 1])
    scores, move = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    gamma, pairs = language.marginals(scores, lengths, move)
    want_pairs, at = np.zeros((3, 3)), 0
    for n in lengths:
        g, p = brute_marginals(scores[at:at + n], move)
        assert np.allclose(gamma[at:at + n], g)
        want_pairs, at = want_pairs + p, at + n
    assert np.allclose(pairs, want_pairs)


def log_likelihood(texts, labels, model):
    total = 0.0
    for t, y in zip(texts, labels):
        words = language.words_of(t)
        s = language.Vocabulary(model.weights)
        ids = s.numbers(words)
        scores = s.scores[ids]
        z = 0.0
        for path in itertools.product(range(len(model.labels)), repeat=len(words)):
            z += np.exp(sum(scores[i, p] for i, p in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
        total += scores[:, y].sum() + model.transitions[y, y] * (len(words) - 1) - np.log(z)
    return total


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    texts, labels = ["the cat is", "der hund", "x"], [0, 1, 1]
    model = language.Model(["a", "b"], rng.normal(size=(language.SLOTS, 2)), rng.normal(size=(2, 2)))
    grad, move, n = language.gradient(texts, labels, model)
    assert n == 6
    for slot in language.features("cat")[:3]:
        for eps_at, got in ((("weights", slot, 1), grad[slot, 1]), (("transitions", 0, 1), move[0, 1])):
            name, i, j = eps_at
            up, down = (language.Model(model.labels, model.weights.copy(), model.transitions.copy()) for _ in range(2))
            getattr(up, name)[i, j] += 1e-5
            getattr(down, name)[i, j] -= 1e-5
            assert got == pytest.approx((log_likelihood(texts, labels, up) - log_likelihood(texts, labels, down)) / 2e-5, abs=1e-5)


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.createDataFrame(corpus(), DOC_SCHEMA).repartition(3)
    held = language.held_out("doc_id", 3, 1)
    model = language.fit(docs.where(~held))
    rows = language.label(docs.where(held), model, ("doc_id", "lang")).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and len(rows) > 40
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    rnd = random.Random(0)
    mixed = spark.createDataFrame([(0, text(rnd, "de", 40) + " " + text(rnd, "fr", 20))], "doc_id long, text string")
    r = language.label(mixed, model).first()
    assert r.lang_pred == "de" and 0.5 < r.score < 0.8 and 1 <= r.switches <= 4


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as score", "2 as t", "3 as l", "'x' as lang_pred")
    model = language.fit(docs)
    assert model.labels == ["de", "en", "es", "fr"]
    rows = language.label(docs, model).collect()
    assert len(rows) == docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (4, 5, 6)) and all(0 <= r.score <= 1 for r in rows)
    nothing = language.fit(empty(spark))
    assert nothing.labels == [] and language.label(empty(spark), nothing).count() == 0
    assert {r.lang_pred for r in language.label(docs, nothing).collect()} == {"und"}
    one = language.fit(docs.where(F.col("lang") == "en"))
    assert {r.lang_pred for r in language.label(docs.where("doc_id in (1, 7)"), one).collect()} == {"en"}


def test_copies_count_once_in_the_draw(spark, monkeypatch):
    """A language made of copies is fitted on each of its texts, and no text enters twice."""
    rows = [(i, f"das ist text {i % 3}", "de") for i in range(3000)] + [(i, f"this is text {i}", "en") for i in range(3000, 3050)]
    drawn = []

    def seen(df):
        drawn.extend((r.t, r.y) for r in df.collect())
        return df

    monkeypatch.setattr(language, "cut", seen)
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=1, train_docs=20)
    assert model.labels == ["de", "en"] and len(drawn) == len(set(drawn))
    assert sum(y == 0 for _, y in drawn) == 3 and sum(y == 1 for _, y in drawn) == 10
