"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panel_engine.catalog.base import query
from panel_engine.catalog.frames import table
from panel_engine.sources import readers, writers
from panel_engine.sources.scratch import new_path
from panel_engine.sources.versioned import VersionedTable

ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderstatus": "string"}


@query("s1_typed_csv_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def typed_csv(spark, sf_dir):
    path = new_path(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "orders").drop("o_orderdate"), path)
    return readers.read_typed_csv(spark, path, ORDER_TYPES)


@query("s2_lenient_csv_scan", "SELECT o_orderkey, o_totalprice, CAST(NULL AS DOUBLE) AS valore_misura FROM orders")
def lenient_csv(spark, sf_dir):
    path = new_path(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), path)
    return readers.read_typed_csv(
        spark, path, {"o_orderkey": "bigint", "o_totalprice": "double", "valore_misura": "double"}, ["valore_misura"])


def _monthly_drop(spark, sf_dir) -> str:
    """Orders as ``ORD-<year>-<month>.csv`` entries; the column layout changes after 1998."""
    folder = new_path(spark, "drop")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderpriority",
        F.date_format(F.col("o_orderdate").cast("date"), "'ORD-'yyyy-MM'.csv'").alias("file"))
    old = F.col("file") < "ORD-1999"
    writers.write_csv(orders.where(old), folder, "append", ["file"])
    writers.write_csv(orders.where(~old).select("o_totalprice", "o_orderkey", "o_custkey", "file"), folder, "append", ["file"])
    return folder


_UNION_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  CASE WHEN o_orderdate < DATE '1999-01-01' THEN o_orderpriority END AS o_orderpriority,
  strftime(o_orderdate, 'ORD-%Y-%m.csv') AS source_file
FROM orders"""


def _with_short_name(df):
    return df.withColumn(
        "source_file", F.regexp_extract(readers.SOURCE_FILE, r"(ORD-\d+-\d+\.csv)", 1)).drop(readers.SOURCE_FILE)


@query("s3_union_monthly_csv", _UNION_SQL)
def union_monthly(spark, sf_dir):
    return _with_short_name(readers.union_csv_files(spark, _monthly_drop(spark, sf_dir), "ORD", [1990, 2010]))


@query("s4_year_pruned_files", _UNION_SQL + " WHERE year(o_orderdate) BETWEEN 1996 AND 1999")
def year_pruned(spark, sf_dir):
    return _with_short_name(readers.union_csv_files(spark, _monthly_drop(spark, sf_dir), "ORD", [1999, "1996"]))


@query("s4_file_report", """
WITH months AS (SELECT strftime(o_orderdate, 'ORD-%Y-%m.csv') AS file, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL)
SELECT file, year, 'read' AS status, CAST(n AS BIGINT) AS rows FROM months WHERE year BETWEEN 1990 AND 1998
UNION ALL SELECT NULL, CAST(y AS INTEGER), 'missing_year', 0 FROM range(1990, 1999) AS r(y) WHERE y NOT IN (SELECT year FROM months)""")
def file_report(spark, sf_dir):
    report = readers.file_report(spark, _monthly_drop(spark, sf_dir), "ORD", [1990, 1998])
    return report.select(F.regexp_extract("file", r"(ORD-\d+-\d+\.csv)", 1).alias("file"), "year", "status", "rows")


@query("s5_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def parquet_scan(spark, sf_dir):
    return readers.read_table(spark, f"{sf_dir}/orders.parquet").where("o_totalprice > 250000").select(
        "o_orderkey", "o_totalprice")


@query("s6_parquet_sink", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def parquet_sink(spark, sf_dir):
    path = writers.write_parquet(table(spark, sf_dir, "customer"), new_path(spark, "sink") + "/nested")
    return spark.read.parquet(path)


@query("s6_versioned_sink", """
SELECT c_custkey, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer""")
def versioned_sink(spark, sf_dir):
    """A table of which one partition is replaced; the other files stay."""
    sink = VersionedTable(spark, new_path(spark, "versions"), ["c_mktsegment"])
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    sink.write(rows)
    sink.write(rows.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 1), only_partitions=True)
    return sink.read()


@query("s7_csv_sink_per_model", """
SELECT l_returnflag AS model, l_partkey AS feature, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag, l_partkey""")
def csv_sink(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    path = writers.write_csv(counts, new_path(spark, "sink"), partition_by=["model"])
    return spark.read.option("header", True).csv(path).select(
        F.col("model").cast("string").alias("model"), F.col("feature").cast("bigint").alias("feature"),
        F.col("n").cast("bigint").alias("n"))


@query("s8_format_dispatch", """
SELECT 'parquet' AS format, c_custkey FROM customer UNION ALL SELECT 'csv' AS format, c_custkey FROM customer""")
def format_dispatch(spark, sf_dir):
    path = writers.write_csv(table(spark, sf_dir, "customer"), new_path(spark, "sink") + ".csv")
    parts = [("parquet", f"{sf_dir}/customer.parquet"), ("csv", path)]
    frames = [
        readers.read_table(spark, p).select(F.lit(f).alias("format"), F.col("c_custkey").cast("bigint").alias("c_custkey"))
        for f, p in parts]
    return frames[0].unionByName(frames[1])


@query("s9_header_normalised_csv", """
SELECT p_name AS feature, round(p_retailprice, 4) AS perm_score, p_brand AS interaction_partners FROM part""")
def header_normalised(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_name").alias(" Feature"), F.col("p_retailprice").alias("PERM-Importance (mean)"),
        F.col("p_brand").alias("Interaction Partners"), F.col("p_size").alias("Perm.Norm-x"))
    path = writers.write_csv(part, new_path(spark, "csv"))
    out = readers.select_aliased(spark.read.option("header", True).csv(path), {
        "feature": ["feature"], "perm_score": ["perm_norm", "perm_importance_mean"],
        "interaction_partners": ["top_interaction_partners", "interaction_partners"]})
    return out.withColumn("perm_score", F.round(F.col("perm_score").cast("double"), 4))


@query("s10_json_document", """
SELECT 'orders_summary' AS step, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_ids, '1,2' AS lag_steps FROM orders""")
def json_document(spark, sf_dir):
    doc = writers.document(table(spark, sf_dir, "orders"), {
        "step": "orders_summary", "n_rows": F.count(F.lit(1)), "n_ids": F.count_distinct("o_custkey"),
        "lag_steps": ["1", "2"]})
    path = writers.write_json(doc, new_path(spark, "json"))
    back = spark.read.schema(doc.schema).json(path)
    return back.withColumn("lag_steps", F.concat_ws(",", "lag_steps"))


@query("s12_distinct_ids", "SELECT DISTINCT l_partkey AS id FROM lineitem")
def distinct_ids(spark, sf_dir):
    return writers.distinct_ids(table(spark, sf_dir, "lineitem"), "l_partkey")
