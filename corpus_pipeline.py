"""From raw documents to encoded training data: five stages over the corpus operators.

Each stage takes all that the one before kept, as rows with the columns of ``documents``, and is
stored before the next one reads it. Language identification drops what it rejects, near-duplicates
keep one document of a group, secrets are redacted in place, the mix drops and repeats documents to meet
its targets, and the last stage returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panel_engine.llm import bpe, language, mixing, resemblance, secrets
from panel_engine.sources.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose likeliest language has less than this share of its words is rejected.
LEAST_SHARE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model names for at least ``LEAST_SHARE`` of their words; a null
    lang is filled in. Texts without a letter are rejected."""
    model = language.fit(docs)
    named = language.label(docs.withColumn("body", F.col("text")), model, ("doc_id", "body", "lang", "source", "n_chars"), "text", rows=256)
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.select("doc_id", F.col("body").alias("text"), F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by SimHash, linked where their sets of five-word
    shingles have a Jaccard similarity of 0.8 or more.

    The row with the smallest id stays, of those that share it the one with the smallest hash of its columns;
    rows that share an id but lie in different groups each count in their own. Rows without an id stay.
    """
    # a row is known by its id and a hash of what it holds
    row = F.struct("doc_id", F.xxhash64(*COLUMNS[1:], *[F.col(c).isNull() for c in COLUMNS[1:]]).alias("h"))
    rows = docs.select(*COLUMNS, row.alias("row")).where(F.col("doc_id").isNotNull())
    groups = resemblance.groups(rows, "row", "text", shingle=5)
    first = groups.groupBy("component").agg(F.min("row").alias("row")).select("row").distinct()
    once = rows.join(first, "row").dropDuplicates(["row"])  # rows of one id and one hash are the same
    return once.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret replaced by a mark; documents without one stay as they are."""
    found = secrets.scan(docs, keep=("text", "lang", "source", "n_chars"))
    text = secrets.redact(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken in part counts if at least half of it is taken.

    A document without a word stays once: it neither adds to a source nor takes from it.
    """
    plan = mixing.mix(docs).select("doc_id", "size", "taken")
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    # ids are unique here; rows that share one nevertheless are each taken as often as the one taken most
    plan = plan.groupBy(F.col("doc_id").alias("k")).agg(F.max(times).alias("times")).where("times > 0")
    drawn = docs.select(*COLUMNS).join(plan, F.col("doc_id").eqNullSafe(F.col("k")))
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``ids`` and whether the decoded bytes are the text again."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN), ranks)
    same = F.col("data") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identified), ("simhash_near_dedup", deduplicated), ("secret_scan", redacted),
    ("mixing", mixed), ("byte_bpe", encoded),
]
#: SQL cannot express the hashes and learned models of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
