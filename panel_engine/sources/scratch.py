"""Intermediate tables in storage that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors all live in this process (``local[...]``) gets a folder
    of its own; any other master has no folder that all of them see, and that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage with a written table: columnar, prunable, and it outlives executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str, counters: Mapping[str, Column]) -> tuple[DataFrame, dict[str, object]]:
    """``materialize``, and aggregates over the rows counted in the pass that writes them.

    They are observed in the writing stage itself, of which each task counts once, however often it is tried.
    """
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(name) for name, c in counters.items()]), label)
    return table, dict(seen.get)
