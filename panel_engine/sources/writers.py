"""Sinks: parquet, CSV, JSON documents and distinct-id tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    df.write.mode(mode).option("header", True).partitionBy(*partition_by).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """A report, schema or meta document: the frame has one row."""
    df.write.mode("overwrite").json(path)
    return path


def document(df: DataFrame, fields: dict[str, Column | object]) -> DataFrame:
    """One-row document of aggregates and constants over ``df``."""
    aggs = [v.alias(k) for k, v in fields.items() if isinstance(v, Column)]
    out = df.agg(*aggs) if aggs else df.sparkSession.range(1).select()
    consts = {}
    for name, value in fields.items():
        if isinstance(value, Column):
            continue
        consts[name] = F.array(*[F.lit(x) for x in value]) if isinstance(value, (list, tuple)) else F.lit(value)
    return out.withColumns(consts).select(*fields) if consts else out


def distinct_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.select(F.col(id_col).alias("id")).distinct()
