"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents lie in a permuted order (by a seeded hash), which is cut into leaf blocks by a
prefix of the hash. A source's quota of words enters the tree at its root; every node splits its quota
exactly among its children by conditional hypergeometric draws from the words below each, so a leaf
block ends with a quota of its own. Inside a leaf the documents are taken in permuted order until its
quota is used up. Nodes and leaves are bounded, so no source, however large, meets one task. Output
shards own ranges of the permuted order, which are disjoint, and rows are shuffled inside a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.llm.text import cut, n_words

#: Children of a tree node, as bits of the hash; documents in a leaf on average, at most.
FAN_BITS, LEAF_DOCS = 4, 64


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source``, ``source_size`` to ``target``: the total shared out by weight, at most ``most`` times each size.

    Sources by code point, null last, take the weights in turn. The excess over a cap goes to the others
    by weight until none is above; as that fills sources in the order of size per weight, a running sum
    in this order finds the level. One row per source, so one ordering of them is small.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(all_rows)
    # the level if this source and all after it stay below their caps
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= most * F.col("source_size"))
    final = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source"))).over(all_rows)
    cap = (most * F.col("source_size")).cast("double")
    return levels.select("source", "source_size", F.least(cap, F.coalesce(final * F.col("w"), cap)).alias("target"))


def _normal(*of: Column) -> Column:
    """A standard normal draw fixed by the hash of its arguments (sum of twelve uniforms of 16 bits)."""
    bits = [F.xxhash64(F.lit(f"draw{i}"), *of) for i in range(3)]
    parts = [F.shiftright(b, 16 * k).bitwiseAND(F.lit(0xFFFF)) for b in bits for k in range(4)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return (total + 6.0) / 65536.0 - 6.0


def _split(children: Column, quota: Column, seed: int) -> Column:
    """Children (struct child, words) with ``quota`` split among them, summing to it exactly.

    Child after child draws from a hypergeometric law: quota left, words of this child, words left. The
    law is taken by its exact mean, variance and range.
    """
    start = F.struct(
        quota.alias("left"), F.aggregate(children, F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("rest"),
        F.array().cast("array<struct<child:bigint,quota:bigint>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        left, rest, words = s["left"].cast("double"), s["rest"].cast("double"), c["words"].cast("double")
        share = words / F.greatest(rest, F.lit(1.0))
        var = left * share * (1 - share) * (rest - left) / F.greatest(rest - 1, F.lit(1.0))
        drawn = F.round(left * share + F.sqrt(F.greatest(var, F.lit(0.0))) * _normal(F.lit(seed), c["child"], c["words"], s["left"])).cast("long")
        low = F.greatest(F.lit(0).cast("long"), s["left"] - (s["rest"] - c["words"]))
        got = F.greatest(low, F.least(drawn, s["left"], c["words"]))
        return F.struct(
            (s["left"] - got).alias("left"), (s["rest"] - c["words"]).alias("rest"),
            F.concat(s["out"], F.array(F.struct(c["child"].alias("child"), got.alias("quota")))).alias("out"))

    return F.aggregate(children, start, step, lambda s: s["out"])


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (1, 2, 3),
    most: int = 3, shards: int = 16, seed: int = 7,
) -> DataFrame:
    """``key``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``shard``, ``position``.

    ``taken`` is the words the mix takes of the document: whole passes over the source, and for what is
    left of its target a draw without replacement, in which at most one document per leaf is taken in
    part. The sum over a source is its target rounded down to a word. ``shard`` and ``position`` place it in the output.
    Null texts and texts without a word have size 0; null keys and repeated rows are rows like any
    other; a null source is a source of its own. The result follows from the rows and the seed alone.
    """
    sized = cut(docs.select(F.col(key).alias("k"), F.col(source).alias("source"), n_words(text).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = cut(targets(totals.select("source", "source_size"), weights, most).join(
        totals.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    largest = goal.agg(F.max("n")).first()[0] or 0
    depth = 0
    while largest > LEAF_DOCS << (FAN_BITS * depth):
        depth += 1

    sid = F.xxhash64(F.col("source"), F.col("source").isNull())
    order = F.xxhash64(F.lit(seed), sid, F.coalesce(F.col("k").cast("string"), F.lit("")), F.col("k").isNull())
    leaf = F.shiftrightunsigned(order, 64 - FAN_BITS * depth) if depth else F.lit(0).cast("long")
    placed = sized.withColumns({"sid": sid, "order": order}).withColumn("leaf", leaf)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.select(sid.alias("sid"), "source_size", "target", passes.alias("passes"))

    words = [cut(placed.groupBy("sid", "leaf").agg(F.sum("size").alias("words")))]
    for _ in range(depth):
        words.append(words[-1].groupBy("sid", F.shiftright("leaf", FAN_BITS).alias("leaf")).agg(F.sum("words").alias("words")))
    quotas = goal.select("sid", F.lit(0).cast("long").alias("leaf"), F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long").alias("quota"))
    for level in range(depth - 1, -1, -1):
        nodes = words[level].groupBy("sid", F.shiftright("leaf", FAN_BITS).alias("leaf")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("leaf").alias("child"), "words"))).alias("children"))
        quotas = nodes.join(quotas, ["sid", "leaf"]).select("sid", F.explode(_split(F.col("children"), F.col("quota"), seed)).alias("c")).select(
            "sid", F.col("c.child").alias("leaf"), F.col("c.quota").alias("quota"))
    plan = cut(quotas.join(goal, "sid"))

    in_leaf = Window.partitionBy("sid", "leaf").orderBy("order", "size", "k").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("size").over(in_leaf)
    draw = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("quota") - (upto - F.col("size"))))
    out = placed.join(plan, ["sid", "leaf"]).withColumn("taken", F.col("passes") * F.col("size") + draw)
    place = F.xxhash64(F.lit(seed + 1), "order")
    return out.select(
        F.col("k").alias(key), "source", "size", "source_size", "target", "taken",
        F.shiftright(F.shiftrightunsigned("order", 32) * shards, 32).cast("int").alias("shard"), place.alias("position"))
