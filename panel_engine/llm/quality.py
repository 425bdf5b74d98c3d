"""Quality rules run as a short-circuit cascade, ordered by rejection per cost on a sample.

Plain SQL expressions only. Counts that the rules share come first; the rules follow in nested
conditions, so a document that one rule rejects is not put to the later ones. The sample decides the
order alone: a document is kept if it passes every rule, whatever their order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel_engine.llm.text import WORD, cut, whole, words

#: Rows that costs and rejections are measured on, and the longest text among them, in code points.
SAMPLE_ROWS, SAMPLE_LENGTH = 2000, 1 << 14
#: How often a rule is evaluated on each row of the sample when it is timed.
REPEATS = 20
LEAST_SECONDS = 0.05


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(w: Column, k: int = 3) -> Column:
    """Words inside ``k``-word windows found twice or more in the array, the first included.

    Windows are compared by a 64-bit hash. Most texts repeat none, which one hash set tells; for the
    others the hashes are sorted with their places, and the places of equal neighbours marked.
    """
    n = F.size(w) - (k - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(k)]))

    def covered(h: Column) -> Column:
        keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = bound(keyed, lambda s: F.filter(s, lambda x, p: (
            (F.get(s, p + 1)["h"] == x["h"]) | (F.get(s, p - 1)["h"] == x["h"]))))
        starts = F.array_sort(F.transform(marked, lambda x: x["i"]))
        # each start adds the words up to the next start, k at most
        return F.aggregate(
            starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-k).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(k), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"])

    def by_hash(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    return F.when(n < 2, F.lit(0).cast("long")).otherwise(bound(hashes, by_hash))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); null counts as empty."""
    t = whole(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return docs.withColumn("__w", words(text)).withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": (F.length(t) - F.length(F.regexp_replace(t, r"[^\x20\x09-\x0D]+", ""))).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": bound(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__w")),
    }).drop("__w")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text") -> dict[str, Column]:
    """Rules beyond the base ones, each true where it rejects. Bounds are wide: ordinary prose, in any language, passes."""
    t, n = whole(text), F.col("n_words")
    lines = F.split(t, "\n")
    return {
        "base": base_failed(),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "symbols": 2 * F.col("n_symbols") > n,
        "repeated_lines": F.col("n_dup_lines") * 10 > F.size(lines) * 5,
        "few_letters": 2 * F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*")) < n,
        "ellipses": F.regexp_count(t, F.lit(r"(?m)(?:\.\.\.|…)[\x20\t\r]*$")) * 10 > F.size(lines) * 5,
        "long_run": t.rlike(r"([^\x20\x09-\x0D])\1{199}"),
    }


def rule_order(docs: DataFrame, rules: Mapping[str, Column], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, most rejection per second first, as measured on up to ``sample_rows`` rows of ``docs``.

    The rows are taken before anything is counted, from as few partitions as give them, by a plain ``take`` of texts up
    to ``SAMPLE_LENGTH``: no partition beyond these is read and none is shuffled. Each rule is
    evaluated ``REPEATS`` times a row, and what a job without a rule takes is subtracted.
    """
    # bounded: sample_rows texts of SAMPLE_LENGTH code points at most
    drawn = docs.where(F.length(whole(text)) <= SAMPLE_LENGTH).take(sample_rows)
    spark = docs.sparkSession
    sample = cut(counted(spark.createDataFrame(drawn, docs.schema).repartition(spark.sparkContext.defaultParallelism), text))
    shares = sample.agg(*[F.avg(F.coalesce(r, F.lit(True)).cast("double")).alias(name) for name, r in rules.items()]).first()
    often = sample.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(rule: Column) -> float:
        start = time.perf_counter()
        often.agg(F.count_if(rule & (F.col("__i") > 0))).collect()
        return time.perf_counter() - start

    seconds(F.lit(True))
    idle = seconds(F.lit(True))
    # less than LEAST_SECONDS cannot be told from a job's own time
    return sorted(rules, key=lambda name: (-(shares[name] or 0.0) / max(seconds(rules[name]) - idle, LEAST_SECONDS), name))


def cascade(docs: DataFrame, text: str = "text", rules: Mapping[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the five counts, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule that rejects).

    Null, empty and blank texts have no words and fail the base rule. Columns of those names are
    replaced, others kept; repeated rows are judged alike. ``kept`` does not depend on the sample,
    ``rejected_by`` names another rule if another comes first.
    """
    rules = default_rules(text) if rules is None else rules
    counts = counted(docs, text)
    verdict = F.lit(None).cast("string")
    for name in reversed(rule_order(docs, rules, text, sample_rows)):
        verdict = F.when(F.coalesce(rules[name], F.lit(True)), F.lit(name)).otherwise(verdict)
    judged = counts.withColumns({"base_failed": base_failed(), "rejected_by": verdict})
    return judged.withColumn("kept", F.col("rejected_by").isNull())
