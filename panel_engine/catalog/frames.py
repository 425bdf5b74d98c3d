"""Frames over the driver tables that give the operators their column roles.

Each frame exists as a DataFrame and as the equal SQL text; nulls, events and categories
come from the same arithmetic on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panel_engine.functions import scalars as S



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- merged panel: parts as entities, shipments as monthly observations ---------------

PANEL = """
SELECT l_partkey AS id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
  CAST(day(l_shipdate) AS INTEGER) AS day, CAST(l_shipdate AS DATE) AS cf_date, l_orderkey AS obs,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax * 100.0 END AS scs,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS milk,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice / 20000.0 END AS protein,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_discount * 80.0 END AS fat,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 4.0 + l_quantity / 40.0 END AS lactose,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 400.0 + l_extendedprice / 100.0 END AS ec,
  CASE l_returnflag WHEN 'A' THEN 'bruna' WHEN 'N' THEN 'frisona' END AS breed,
  CASE WHEN l_linenumber = 1 THEN CAST(l_shipdate AS DATE) END AS calving_date,
  CASE WHEN l_linenumber = 1 THEN 1 END AS calving,
  CASE WHEN l_linenumber = 2 AND l_linestatus = 'F' THEN 'mastitis' END AS diagnosis,
  CASE WHEN l_linenumber = 2 AND l_linestatus = 'F'
       THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS t_date,
  CASE WHEN l_linenumber <= 5 THEN DATE '1993-06-01' + CAST(l_partkey % 1200 AS INTEGER) END AS birth_date
FROM lineitem"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    day = c("l_shipdate").cast("date")
    sick = (c("l_linenumber") == 2) & (c("l_linestatus") == "F")
    return li.select(
        c("l_partkey").alias("id"), F.year(day).alias("year"), F.month(day).alias("month"),
        F.day(day).alias("day"), day.alias("cf_date"), c("l_orderkey").alias("obs"),
        F.when(c("l_suppkey") % 7 != 0, c("l_tax") * 100.0).alias("scs"),
        F.when(c("l_orderkey") % 9 != 0, c("l_quantity")).alias("milk"),
        F.when(c("l_orderkey") % 11 != 0, c("l_extendedprice") / 20000.0).alias("protein"),
        F.when(c("l_suppkey") % 5 != 0, c("l_discount") * 80.0).alias("fat"),
        F.when(c("l_orderkey") % 4 != 0, 4.0 + c("l_quantity") / 40.0).alias("lactose"),
        F.when(c("l_suppkey") % 3 != 0, 400.0 + c("l_extendedprice") / 100.0).alias("ec"),
        F.when(c("l_returnflag") == "A", "bruna").when(c("l_returnflag") == "N", "frisona").alias("breed"),
        F.when(c("l_linenumber") == 1, day).alias("calving_date"),
        F.when(c("l_linenumber") == 1, 1).alias("calving"),
        F.when(sick, "mastitis").alias("diagnosis"),
        F.when(sick, F.date_add(day, c("l_quantity").cast("int"))).alias("t_date"),
        F.when(c("l_linenumber") <= 5,
               F.date_add(F.lit("1993-06-01").cast("date"), (c("l_partkey") % 1200).cast("int"))).alias("birth_date"),
    )


# ---- transformed panel: the shape the imputer, anchors and samples expect ---------------

FEATURES = f"""
SELECT id, year, month, cf_date, obs, scs, milk, protein, fat, lactose, ec, breed,
  CAST(2 + id % 7 AS INTEGER) AS age,
  CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
       WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
  CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'early_lactation' WHEN 2 THEN 'peak'
       WHEN 3 THEN 'mid_lactation' ELSE 'late_lactation' END AS lactation_phase,
  CAST(1 + obs % 9 AS INTEGER) AS months_since_calving,
  sin((month - 1) * (2.0 * pi() / 12.0)) AS month_sin, cos((month - 1) * (2.0 * pi() / 12.0)) AS month_cos,
  CASE WHEN diagnosis IS NULL THEN 0 ELSE 1 END AS disease,
  CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS healthy
FROM ({PANEL})"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    phase = (
        F.when(c("id") % 5 == 1, "early_lactation").when(c("id") % 5 == 2, "peak")
        .when(c("id") % 5 == 3, "mid_lactation").when(c("id") % 5 == 4, "late_lactation"))
    return panel(spark, sf_dir).select(
        "id", "year", "month", "cf_date", "obs", "scs", "milk", "protein", "fat", "lactose", "ec", "breed",
        (2 + c("id") % 7).cast("int").alias("age"), S.season("month").alias("season"),
        phase.alias("lactation_phase"), (1 + c("obs") % 9).cast("int").alias("months_since_calving"),
        F.sin(S.month_angle("month")).alias("month_sin"), F.cos(S.month_angle("month")).alias("month_cos"),
        F.when(c("diagnosis").isNull(), 0).otherwise(1).alias("disease"),
        F.when(c("id") % 2 == 0, 1).otherwise(0).alias("healthy"),
    )


# ---- daily observations per user: dense enough for consecutive days ---------------------

DAYS = """
SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(year(ts) AS INTEGER) AS year,
  CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS dom, event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, value AS raw_value
FROM events"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    c = F.col
    return ev.select(
        "event_id", "user_id", c("ts").cast("date").alias("day"), F.year("ts").alias("year"),
        F.month("ts").alias("month"), F.day("ts").alias("dom"), "event_type",
        F.when(c("event_id") % 7 != 0, c("value")).alias("value"), c("value").alias("raw_value"))


# ---- ranking reports: two views per model, models are brands, features are part types ---

PERM = """
SELECT s.l_returnflag AS model, p.p_brand AS feature, CAST(sum(s.l_quantity) AS VARCHAR) AS perm_score,
  max(p2.partners) AS interaction_partners
FROM lineitem s JOIN part p ON s.l_partkey = p.p_partkey
JOIN (SELECT p_brand, string_agg(name, ', ' ORDER BY name) AS partners FROM (
        SELECT DISTINCT p_brand, 'Brand#' || CAST(p_size AS VARCHAR) AS name FROM part WHERE p_size <= 25)
      GROUP BY p_brand) p2 ON p.p_brand = p2.p_brand
GROUP BY s.l_returnflag, p.p_brand"""

SHAP = """
SELECT s.l_returnflag AS model, p.p_brand AS feature, CAST(sum(s.l_linenumber) AS VARCHAR) AS mean_abs_shap,
  CAST(round(sum(CASE WHEN s.l_linestatus = 'F' THEN s.l_discount ELSE -s.l_discount END)
       / sum(s.l_discount) * 20.0, 3) AS VARCHAR) AS spearman
FROM lineitem s JOIN part p ON s.l_partkey = p.p_partkey
WHERE NOT (s.l_returnflag = 'R' AND p.p_brand IN ('Brand#1', 'Brand#2'))
GROUP BY s.l_returnflag, p.p_brand"""


def rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    names = part.where("p_size <= 25").select(
        "p_brand", F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("name")).distinct()
    partners = names.groupBy("p_brand").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list("name"))).alias("interaction_partners"))
    rows = li.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    perm = (
        rows.groupBy("l_returnflag", "p_brand").agg(F.sum("l_quantity").cast("string").alias("perm_score"))
        .join(partners, "p_brand")
        .select(F.col("l_returnflag").alias("model"), F.col("p_brand").alias("feature"),
                "perm_score", "interaction_partners"))
    signed = F.when(F.col("l_linestatus") == "F", F.col("l_discount")).otherwise(-F.col("l_discount"))
    shap = (
        rows.where(~((F.col("l_returnflag") == "R") & F.col("p_brand").isin("Brand#1", "Brand#2")))
        .groupBy("l_returnflag", "p_brand")
        .agg(F.sum("l_linenumber").cast("string").alias("mean_abs_shap"),
             F.round(F.sum(signed) / F.sum("l_discount") * 20.0, 3).cast("string").alias("spearman"))
        .select(F.col("l_returnflag").alias("model"), F.col("p_brand").alias("feature"), "mean_abs_shap", "spearman"))
    return perm, shap
