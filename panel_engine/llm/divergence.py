"""How the sources of a language differ in their terms: an audit by chi-square-like shares in whole numbers.

Terms are counted per (language, source) in tasks and summed by Spark. Shares are integers, parts of a billion,
with one added to every count, so that all arithmetic is exact. Two reports follow: for each pair of sources the
divergence over all terms, and for each source the terms it uses most beyond its language as a whole.

The second is a dominance skyband: a term with no lower group count, no higher count in the language and an
earlier spelling than another ranks before it, whatever the totals. A term dominated by ``k`` others is not among
the first ``k``. Partitions retain what is dominated by fewer than ``k`` in them, the skybands of a group merge, and
what is left is ranked exactly.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel_engine.llm.text import cut

#: Letters and whatever is not ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")
SCALE = 1_000_000_000
#: Distinct (language, source, term) a task counts before it passes its counts on.
HELD = 1 << 18
#: Cells of one block of terms by sources; counts in a bucket of terms on average.
CELLS, BUCKET = 1 << 21, 1 << 16
#: Terms in a part on average, parts that merge.
PART, MERGED = 1 << 15, 32
#: Rows held against a skyband at once.
STEP = 256


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to (lang, source, term, count, docs), summed as far as memory is meant to go."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            n = len(terms)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, n), pa.repeat(source, n), pa.array(list(terms), pa.binary()).cast(pa.string()),
                     pa.array(list(terms.values()), pa.int64()), pa.array(list(map(docs[lang, source].__getitem__, terms)), pa.int64())],
                    names=["lang", "source", "term", "c", "docs"])
        counts.clear()
        docs.clear()

    new = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            terms = TERM.findall(text.lower())  # bytes lower A to Z only
            distinct = set(terms)
            counts[lang, source].update(terms)
            docs[lang, source].update(distinct)
            new += len(distinct)
            if new > HELD:
                new = sum(map(len, counts.values()))
                if 4 * new > 3 * HELD:
                    yield from out()
                    new = 0
    yield from out()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """The counts, ``lang``, ``source``, ``term``, ``c``, ``lang_c``, of terms in at least ``least_docs`` documents of
    their language, and the groups, ``lang``, ``source``, ``n``, ``terms``, ``lang_n``, ``v``, also those without terms."""
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("text"))
    partial = rows.mapInArrow(_count, "lang string, source string, term string, c long, docs long")
    summed = partial.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    # a term's sources side by side, once each: rare terms go before anything is stored
    kept = summed.groupBy("lang", "term").agg(
        F.sum("c").alias("lang_c"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "c")).alias("by")).where(F.col("docs") >= least_docs)
    counts = cut(kept.select("lang", "term", "lang_c", F.posexplode("by").alias("pos", "s")).select("lang", "s.source", "term", "s.c", "lang_c", "pos"))
    sums = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("terms"))
    langs = counts.groupBy("lang").agg(F.count_if(F.col("pos") == 0).alias("v"), F.sum("c").alias("lang_n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return counts, cut(groups.na.fill(0, ["n", "terms", "v", "lang_n"]))


def share(count: Column | str, total: Column | str, kinds: Column | str = "v") -> Column:
    """1 + floor(SCALE (count + 1) / (total + kinds)); decimals where the product is beyond 64 bits."""
    count, total, kinds = (F.col(x) if isinstance(x, str) else x for x in (count, total, kinds))
    wide = ((count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    quotient = F.when(count < (1 << 63) // SCALE - 1, F.call_function("div", (count + 1) * F.lit(SCALE).cast("long"), total + kinds))
    return quotient.otherwise(F.call_function("div", wide, total.cast("decimal(20,0)") + kinds)) + 1


def excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two shares; their square is below 2^63."""
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key (a bucket's language): first its sources (term null, their share of an absent term), then by term the
    shares of the sources that have it; to (key, source, item, value), the excess summed over the terms met."""
    key, names, absent, at = None, [], [], {}
    block: list[tuple[np.ndarray, ...]] = []
    terms, last = 0, None

    def close() -> Iterator[pa.RecordBatch]:
        if block and len(names) > 1:
            source, term, p = (np.concatenate(x) for x in zip(*block))
            shares = np.repeat(np.array(absent, np.int64)[:, None], terms, axis=1)  # by source, so that a source's shares lie together
            shares[source, term] = p
            for i, own in enumerate(shares):
                d = own - shares
                value = (d * d // shares).sum(axis=1)
                n = len(names) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array([names[i]] * n), pa.array(names[:i] + names[i + 1:]), pa.array(np.delete(value, i))],
                    names=["key", "source", "item", "value"])
        block.clear()

    for batch in batches:
        keys = batch.column(0)
        edges = [0, *(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows] if len(keys) else []
        for a, b in zip(edges, edges[1:]):
            if keys[a].as_py() != key:
                yield from close()
                key, names, absent, at, terms, last = keys[a].as_py(), [], [], {}, 0, None
            part = batch.slice(a, b - a)
            body = part.column(2).null_count
            for source, p in zip(part.column(1)[:body].to_pylist(), part.column(3)[:body].to_pylist()):
                at[source] = len(names)
                names.append(source)
                absent.append(p)
            part = part.slice(body)
            if not part.num_rows:
                continue
            term = part.column(2)
            new = np.append(term[0].as_py() != last, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))
            last = term[-1].as_py()
            source = np.fromiter(map(at.__getitem__, part.column(1).to_pylist()), np.int64, part.num_rows)
            number, p = terms + np.cumsum(new) - 1, part.column(3).to_numpy()
            most = max(1, CELLS // len(names))
            while number[-1] >= most:
                full = int(np.searchsorted(number, most))
                block.append((source[:full], number[:full], p[:full]))
                terms = most
                yield from close()
                source, number, p = source[full:], number[full:] - most, p[full:]
            block.append((source, number, p))
            terms = int(number[-1]) + 1
    yield from close()


def source_pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: the divergence of each source from each other one of its language.

    The terms of a language are dealt to buckets by a hash, and its sources, a row each, go to every bucket. A bucket
    sums all pairs over its terms in blocks of bounded size; sums of buckets are added by Spark.
    """
    buckets = 1 + counts.count() // BUCKET
    shared = counts.join(groups.select("lang", "source", "n", "v"), ["lang", "source"])
    cells = shared.select(
        F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)).cast("int").alias("b"), "lang", "source", "term", share("c", "n").alias("p"))
    absent = groups.where("v > 0").select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b"), "lang", "source",
        F.lit(None).cast("string").alias("term"), share(F.lit(0), "n").alias("p"))
    dealt = cells.unionByName(absent).repartition(buckets, "b").sortWithinPartitions("b", "lang", F.asc_nulls_first("term"))
    sums = dealt.select(F.concat_ws(":", "b", "lang").alias("key"), "source", "term", "p").mapInArrow(
        _paired, "key string, source string, item string, value long")
    found = sums.groupBy(F.expr("substring(key, locate(':', key) + 1)").alias("lang"), "source", "item").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    # languages without a kept term still have pairs of sources
    none = groups.where("v = 0").select("lang", "source")
    return found.unionByName(none.join(none.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long")))


def skyband(count: np.ndarray, other: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows dominated by fewer than ``k`` others: higher ``count``, lower ``other``, earlier ``term``.

    Ties in a count leave it to the rest. Dominators come earlier in the order below, and among the first ``k`` of a
    row each is itself in the skyband, so rows are held against what is kept so far alone.
    """
    spelled = np.empty(len(term), np.int32)
    spelled[np.argsort(term, kind="stable")] = np.arange(len(term))
    order = np.lexsort((spelled, other, -count))
    low, early = np.unique(other, return_inverse=True)[1][order].astype(np.int32), spelled[order]
    kept = np.empty(0, np.int64)
    for i in range(0, len(order), STEP):
        block = np.arange(i, min(i + STEP, len(order)))
        # of the block itself, whatever comes earlier, kept or not: a row's dominators all count
        rivals = np.concatenate([kept, block])
        over = (low[rivals] <= low[block][:, None]) & (early[rivals] < early[block][:, None])
        over[:, len(kept):] &= block < block[:, None]
        kept = np.concatenate([kept, block[np.count_nonzero(over, axis=1) < k]])
    return order[kept]


def _bands(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, part, term, c, lang_c) sorted by the first three, to the skyband of each part."""
    held: list[pa.RecordBatch] = []
    key = None

    def close() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        term = np.array([t.encode() for t in table.column("term").to_pylist()], object)
        kept = skyband(table.column("c").to_numpy(), table.column("lang_c").to_numpy(), term, k)
        return table.take(pa.array(kept)).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in batch.columns[:3]:
            changed |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            own = tuple(c[a].as_py() for c in batch.columns[:3])
            if held and own != key:
                yield close()
            key = own
            held.append(batch.slice(a, b - a))
            if sum(h.num_rows for h in held) > 4 * PART:  # a skyband of skybands is the skyband
                held.append(close())
    if held:
        yield close()


def leading_terms(counts: DataFrame, groups: DataFrame, k: int = 200) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``, ``rank``: the ``k`` terms first in excess over the language's share.

    Only terms with a share above the language's count; ties go to the earlier term in UTF-8. A group's terms are dealt to
    parts of some ``PART`` terms by a hash, and the skybands of ``MERGED`` parts merge at a time until a group is one.
    """
    totals = groups.select("lang", "source", "n", "v", "lang_n", "terms")

    def shares(df: DataFrame) -> DataFrame:
        return df.join(totals, ["lang", "source"]).withColumn("p", share("c", "n")).withColumn("q", share("lang_c", "lang_n"))

    columns = ["lang", "source", "part", "term", "c", "lang_c"]
    schema = "lang string, source string, part long, term string, c long, lang_c long"
    band, most = shares(counts).where("p > q"), groups.agg(F.max("terms")).first()[0] or 0
    size = PART
    while True:
        # each merge takes the parts of several before
        parts = F.ceil(F.col("terms") / size).cast("long")
        dealt = band.withColumn("part", F.pmod(F.xxhash64("term"), parts)).select(*columns).repartition("lang", "source", "part")
        band = dealt.sortWithinPartitions("lang", "source", "part").mapInArrow(lambda batches: _bands(batches, k), schema)
        if size >= most:
            break
        band, size = band.join(totals.select("lang", "source", "terms"), ["lang", "source"]), size * MERGED
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        shares(band).select("lang", "source", F.col("term").alias("item"), excess("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, k: int = 200) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank``.

    Null languages, sources and texts read as empty; a group without terms has shares of zero counts and, in a
    language without kept terms, pairs of value 0. Repeated rows count as often as they occur; other columns are ignored;
    an empty table gives an empty result.
    """
    counts, groups = term_counts(docs, lang, source, text, least_docs)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(counts, groups).withColumn("rank", F.row_number().over(best))
    terms = leading_terms(counts, groups, k)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(terms.withColumn("part", F.lit("term")).select(*names))
