from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from panel_engine.llm import quality
from panel_engine.llm.queries import OP3_SQL, op3
from tests.check_catalog import difference
from tests.llm.cases import LOREM, awkward, empty


def brute_repeats(w, k=3):
    grams = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    n = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(k)})


def test_repeated_words(spark):
    rnd = random.Random(1)
    arrays = [[], ["a"], ["a", "b"], ["a"] * 9] + [[rnd.choice("abcdef") for _ in range(rnd.randint(1, 40))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, w array<string>")
    for r in df.select("i", quality.repeated_words(F.col("w")).alias("n")).collect():
        assert r.n == brute_repeats(arrays[r.i]), arrays[r.i]


def duck(docs):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    return con


def test_query_equals_sql_on_awkward_rows(spark, tmp_path):
    rnd = random.Random(8)
    docs = awkward(spark).where("doc_id is not null and doc_id != 12").dropDuplicates(["doc_id"])  # DuckDB takes no NUL
    more = [(100 + i, "\n".join(rnd.choice([LOREM, "## $$ %%", "...", "x …", "a b a b a b", "l" * 250, "", "  "]) for _ in range(rnd.randint(1, 30))), "en", "a", 1) for i in range(150)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert difference(op3(spark, str(tmp_path)), duck(docs), OP3_SQL) is None


def test_order_follows_rejection_per_cost_and_leaves_verdicts_alone(spark):
    docs = awkward(spark)
    counts = quality.counted(docs).cache()
    rules = quality.default_rules()
    order = quality.rule_order(counts, rules)
    assert sorted(order) == sorted(rules) and order[0] == "base"
    kept = {frozenset(r.asDict().items()) for r in quality.cascade(docs).select("doc_id", "kept").collect()}
    other = {frozenset(r.asDict().items()) for r in quality.cascade(docs, rules=dict(reversed(rules.items())), sample_rows=1).select("doc_id", "kept").collect()}
    assert kept == other


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as kept", "2 as n_words", "3 as __x")
    rows = quality.cascade(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.base_failed and not r.kept for r in rows if not (r.text or "").strip())
    assert quality.cascade(empty(spark)).count() == 0
