from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from panel_engine.llm import secrets
from panel_engine.llm.queries import op1
from tests.llm.cases import LOREM, awkward, empty

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def brute_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


PIECES = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMN", "0123456789abcdef",
          "deadbeef", "xyz-._=+/", "é", "\U0001f600", "\n", "abcdefghijkl", "Z9"]


def test_base_spans_equal_plain_matching(spark):
    rnd = random.Random(2)
    texts = [None, "", "password: secret: abcdefghijkl", "é\U0001f600 token='abcdefghijkl' AKIA0123456789ABCD 0123456789abcdef"]
    texts += ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", secrets.written(secrets.base_spans("text"))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_base(t), t


def brute_p(token, code):
    alphabet = secrets.ENCODINGS[code][1]
    x = [alphabet.index(c) for c in token.rstrip("=")]
    n, k = len(x), len(alphabet)
    upper = lambda z: 1 / (1 + math.exp(min(500, max(-500, 1.5976 * z + 0.070566 * z ** 3))))
    z1 = (k / n * sum(x.count(v) ** 2 for v in set(x)) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    h = [v >= k / 2 for v in x]
    up, runs = sum(h), 1 + sum(a != b for a, b in zip(h, h[1:]))
    mu = 2 * up * (n - up) / n + 1
    z2 = (runs - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9)) if 0 < up < n else 40
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    z3 = (sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / var + 1 / n) * math.sqrt(n) if var else 40
    half = -max(-200, min(0, sum(math.log(max(p, 1e-30)) for p in (upper(z1), 2 * upper(abs(z2)), 2 * upper(abs(z3))))))
    return math.exp(-half) * (1 + half + half * half / 2)


def token(rnd, code, n):
    while True:
        t = "".join(rnd.choice(secrets.ENCODINGS[code][1]) for _ in range(n))
        if re.search("[0-9]", t) and re.search("[A-Za-z]", t) and (code != "base62" or re.search("[a-z]", t) and re.search("[A-Z]", t)):
            return t


def test_battery_equals_plain_formula(spark):
    rnd = random.Random(4)
    rows = [(c, token(rnd, c, n)) for c in secrets.ENCODINGS for n in (20, 33, 64)] + [("base36", "a1" * 12), ("hex", "a" * 20)]
    df = secrets.battery(spark.createDataFrame(rows, "code string, m string"))
    for r in df.collect():
        assert r.p == pytest.approx(brute_p(r.m, r.code), rel=1e-9, abs=1e-12)


def test_random_tokens_are_reported_and_structured_ones_are_not(spark):
    rnd = random.Random(9)
    real = [(i, f"{LOREM} key {token(rnd, 'base62', 40)} end") for i in range(300)]
    plain = [(1000 + i, f"{LOREM} see section{i}OfTheRepositoryManualPage{i % 7} kkkk{i}mmmmnnnnooootttt1111zzzz end") for i in range(300)]
    got = secrets.scan(spark.createDataFrame(real + plain, "doc_id long, text string")).select("doc_id", F.size("spans").alias("n")).collect()
    hit = sum(r.n for r in got if r.doc_id < 1000)
    wrong = sum(r.n for r in got if r.doc_id >= 1000)
    assert hit >= 240 and wrong <= 30


def test_short_tokens_are_tested_by_length_class(spark):
    """Lengths from 12 on are tested; what is reported of each class follows from the other tokens of its class."""
    rnd = random.Random(12)
    lengths = (12, 16, 19, 24, 32, 40)
    real = [(1000 * n + i, f"{LOREM} key {token(rnd, 'base62', n)} end") for n in lengths for i in range(200)]
    plain = [(100000 + i, f"{LOREM} see page{1 + i}of{900 + i % 90}aaaa end") for i in range(200)]
    got = secrets.scan(spark.createDataFrame(real + plain, "doc_id long, text string")).select("doc_id", F.size("spans").alias("n")).collect()
    for n in lengths:
        assert sum(r.n for r in got if r.doc_id // 1000 == n) >= (120 if n < 16 else 180), n
    assert sum(r.n for r in got if r.doc_id >= 100000) <= 20
    below = spark.createDataFrame([(i, f"key {token(rnd, 'base62', 11)} end") for i in range(50)], "doc_id long, text string")
    assert sum(r[0] for r in secrets.scan(below).select(F.size("spans")).collect()) == 0


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark).selectExpr("*", "1 as base", "2 as spans", "3 as `row`", "4 as code")
    rows = secrets.scan(docs).select("doc_id", secrets.written(F.col("base")).alias("b"), secrets.written(F.col("spans")).alias("s")).collect()
    assert len(rows) == docs.count()
    assert secrets.scan(empty(spark)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op1(spark, str(tmp_path)).collect():
        assert r.base_sha256 == hashlib.sha256(brute_base(texts[r.doc_id]).encode()).hexdigest()


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdefghijklmnop! 0123456789abcdef0123"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", secrets.redact(F.col("text"), secrets.base_spans("text")).alias("t")).collect()}
    assert got == {1: "é <secret>! <secret>", 2: "clean", 3: None}
