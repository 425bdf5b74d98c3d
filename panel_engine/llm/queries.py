"""One query for each corpus operator: the operator over its whole table, then the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panel_engine.llm import (
    ann, bpe, divergence, language, mixing, packing, periodic, quality, recompression, secrets, simhash, suffixdedup, toxicity)
from panel_engine.llm.catalog import query
from panel_engine.llm.text import read


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query("op4_byte_level_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest().alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"))


@query("op5_mixing_sources")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "position")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) AS r(j) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(string_split(t, chr(10))) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered,
    len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\t\r]*$'))) AS ellipses
  FROM w LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * n_symbols > n_words OR n_dup_lines * 10 > n_lines * 5 OR 2 * lettered < n_words OR ellipses * 10 > n_lines * 5
    OR len(list_filter(list_distinct(string_split(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'), '')),
      lambda c: contains(t, repeat(c, 200)))) > 0) AS kept
FROM counts
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.cascade(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[n(k) for k in secrets.BASE], F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = language.held_out("doc_id", 3, 1)
    model = language.fit(docs.where(~held))
    return language.label(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_letter_words", "switches")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), language.held_out("doc_id", 5, 0)
    model = toxicity.fit(docs.where(~held), read(spark, sf_dir, "labels").where(~held))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"))


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


@query("op7_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
later AS (SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY s)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(13) AS r(j)),
lost AS (SELECT doc_id, list(i) AS lost FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(lost), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN lost IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(lost, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = recompression.remove_repeats(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixdedup.remove_repeats(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
each AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_c FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM each JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(lang_c) AS n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n, any_value(l.v) AS v, any_value(l.n) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts USING (lang, source) LEFT JOIN langs l USING (lang) GROUP BY g.lang, g.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (n + v)::HUGEINT)::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (k.lang_c + 1) // (lang_n + v)::HUGEINT)::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v IS NULL),
found AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(read(spark, sf_dir, "documents"), periodic.with_periodic_tail())
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.before")).alias("start"), "longest.length",
        (-F.col("longest.finer")).alias("period"), F.expr("1000 * longest.length div -longest.finer").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
