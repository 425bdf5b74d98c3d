"""Projections, filters, joins, set operations, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.catalog.base import query
from panel_engine.catalog.frames import DAYS, FEATURES, PANEL, days, features, panel, table
from panel_engine.functions import scalars as S
from panel_engine.operators import clean, consensus, joins, quality, sampling, skew, timeline
from panel_engine.operators.impute import HierarchicalImputer
from panel_engine.operators.ordered import dense_rank_desc
from panel_engine.operators.timeline import MONTH_IDX
from panel_engine.plans import modelling

# ---- projections and filters ----------------------------------------------------------


@query("p1_rename", "SELECT o_custkey AS id, o_totalprice AS milk, o_orderkey FROM orders")
def rename(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "id", "o_totalprice": "milk"}).select(
        "id", "milk", "o_orderkey")


@query("p2_drop_ignore_missing", "SELECT c_custkey, c_acctbal FROM customer")
def drop_missing(spark, sf_dir):
    return table(spark, sf_dir, "customer").drop("c_name", "c_nationkey", "c_mktsegment", "no_such_column")


@query("p3_exact_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_partkey FROM lineitem")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey").dropDuplicates()


@query("p4_year_lower_bound", f"SELECT id, year, month, obs FROM ({PANEL}) WHERE year > 1998")
def year_bound(spark, sf_dir):
    return clean.year_after(panel(spark, sf_dir), "year", 1998).select("id", "year", "month", "obs")


@query("p5_positive", f"SELECT event_id, value - 20.0 AS value FROM ({DAYS}) WHERE value - 20.0 > 0")
def positive(spark, sf_dir):
    shifted = days(spark, sf_dir).select("event_id", (F.col("value") - 20.0).alias("value"))
    return clean.keep_positive(shifted, "value")


@query("p6_fallback_fill", f"SELECT event_id, coalesce(value, raw_value) AS value FROM ({DAYS})")
def fallback_fill(spark, sf_dir):
    filled = clean.fill_from(days(spark, sf_dir), "value", "raw_value")
    return clean.fill_from(filled, "value", "absent_column").select("event_id", "value")


@query("p7_iqr_filter", f"""
WITH d AS ({DAYS}), q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM d)
SELECT event_id, value FROM d, q WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def iqr_filter(spark, sf_dir):
    return clean.iqr_filter(days(spark, sf_dir).select("event_id", "value"), "value")


_CASCADE = [("milk", True), ("fat", True), ("protein", True), ("scs", False)]


def _cascade_sql() -> str:
    ctes, last = [f"s0 AS (SELECT id, obs, cf_date, milk, fat, protein * milk AS protein, scs FROM ({PANEL}))"], "s0"
    for i, (c, pos) in enumerate(_CASCADE, 1):
        ctes.append(f"p{i} AS (SELECT * FROM {last}{f' WHERE {c} > 0' if pos else ''})")
        ctes.append(f"q{i} AS (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM p{i})")
        ctes.append(f"s{i} AS (SELECT p{i}.* FROM p{i}, q{i} WHERE {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))")
        last = f"s{i}"
    return f"WITH {', '.join(ctes)} SELECT id, obs, cf_date, milk, fat, protein, scs FROM {last}"


@query("p8_quality_cascade", _cascade_sql())
def quality_cascade(spark, sf_dir):
    rows = panel(spark, sf_dir).select(
        "id", "obs", "cf_date", "milk", "fat", (F.col("protein") * F.col("milk")).alias("protein"), "scs")
    return clean.quality_cascade(rows, _CASCADE)


@query("p9_equality_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def equality_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select("event_id", "user_id")


@query("p10_drop_nulls", f"SELECT id, obs, milk, fat FROM ({PANEL}) WHERE milk IS NOT NULL AND fat IS NOT NULL")
def drop_nulls(spark, sf_dir):
    return clean.drop_null_rows(panel(spark, sf_dir), ["milk", "fat"]).select("id", "obs", "milk", "fat")


@query("p11_birth_year_range", f"""
SELECT id, obs, birth_date FROM ({PANEL}) WHERE year(birth_date) > 1993 AND year(birth_date) < 1996""")
def birth_range(spark, sf_dir):
    return panel(spark, sf_dir).where(F.year("birth_date").between(1994, 1995)).select("id", "obs", "birth_date")


@query("p12_plausible_age", f"""
SELECT id, obs, CAST(floor((cf_date - birth_date) / 365.25) AS INTEGER) AS age FROM ({PANEL})
WHERE floor((cf_date - birth_date) / 365.25) BETWEEN 2 AND 7""")
def plausible_age(spark, sf_dir):
    aged = panel(spark, sf_dir).withColumn("age", S.age_years("cf_date", "birth_date"))
    return aged.where(F.col("age").between(2, 7)).select("id", "obs", "age")


_BREED_SQL = """CASE WHEN code = '01' THEN 'bruna' WHEN code = '02' THEN 'frisona' WHEN code = '04' THEN 'pezzata' END"""
_CODES = "SELECT l_orderkey AS obs, '0' || CAST(l_linenumber AS VARCHAR) AS code FROM lineitem"


def _codes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("obs"), F.concat(F.lit("0"), F.col("l_linenumber").cast("string")).alias("code"))


@query("p13_code_mapping", f"SELECT obs, code, {_BREED_SQL} AS breed FROM ({_CODES})")
def code_mapping(spark, sf_dir):
    return _codes(spark, sf_dir).withColumn("breed", S.map_codes("code", config.BREED_BY_CODE))


@query("p14_allow_list", f"SELECT obs, {_BREED_SQL} AS breed FROM ({_CODES}) WHERE code IN ('01', '02')")
def allow_list(spark, sf_dir):
    mapped = _codes(spark, sf_dir).select("obs", S.map_codes("code", config.BREED_BY_CODE).alias("breed"))
    return clean.keep_allowed(mapped, "breed", ["bruna", "frisona"])


@query("p15_required_attributes", f"""
SELECT id, obs, breed FROM ({FEATURES})
WHERE breed IS NOT NULL AND lactation_phase IS NOT NULL AND lactation_phase <> 'early_lactation'""")
def required_attributes(spark, sf_dir):
    return clean.drop_null_rows(features(spark, sf_dir), ["breed", "lactation_phase"]).where(
        F.col("lactation_phase") != "early_lactation").select("id", "obs", "breed")


_HISTORY = f"""
SELECT id, obs, disease, healthy, "disease_t-1", "disease_t-2" FROM (
  SELECT id, obs, disease, healthy, CAST(obs % 2 AS INTEGER) AS "disease_t-1", CAST(id % 3 AS INTEGER) AS "disease_t-2"
  FROM ({FEATURES}))"""


def _history(spark, sf_dir):
    return features(spark, sf_dir).select(
        "id", "obs", "disease", "healthy", (F.col("obs") % 2).cast("int").alias("disease_t-1"),
        (F.col("id") % 3).cast("int").alias("disease_t-2"))


@query("p16_pattern_predicate", f"""
SELECT id, obs, CASE WHEN disease = 1 THEN 1 ELSE 0 END AS positive FROM ({_HISTORY})
WHERE "disease_t-1" = 0 AND "disease_t-2" = 0
  AND ((disease = 1 AND healthy = 0) OR (disease = 0 AND healthy = 1))""")
def pattern_predicate(spark, sf_dir):
    return sampling.candidate_classes(_history(spark, sf_dir), "disease", "healthy", [1, 0, 0], [0, 0, 0]).select(
        "id", "obs", F.col("__class").alias("positive"))


@query("p17_ordered_projection", f"SELECT id, year, month, disease, age FROM ({FEATURES})")
def ordered_projection(spark, sf_dir):
    return clean.ordered_projection(features(spark, sf_dir), ["id", "year", "month", "disease", "id", "absent", "age"])


@query("p18_default_columns", """
SELECT o_orderkey, 0 AS calving, CAST(NULL AS VARCHAR) AS diagnosis, o_totalprice FROM orders""")
def default_columns(spark, sf_dir):
    df = clean.ensure_columns(table(spark, sf_dir, "orders"), {
        "calving": (0, "int"), "diagnosis": (None, "string"), "o_totalprice": (None, "double")})
    return df.select("o_orderkey", "calving", "diagnosis", "o_totalprice")


_WIDE_SQL = f"""
WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, year, month ORDER BY obs, milk NULLS LAST,
  protein NULLS LAST, fat NULLS LAST) AS rn FROM ({FEATURES})) WHERE rn = 1),
l AS (SELECT id, year, month, milk, fat, age,
  lag(milk, 1) OVER w AS "milk_t-1", lag(milk, 2) OVER w AS "milk_t-2",
  lag(fat, 1) OVER w AS "fat_t-1", lag(fat, 2) OVER w AS "fat_t-2"
  FROM u WINDOW w AS (PARTITION BY id ORDER BY year * 12 + month))"""


def _unique_features(spark, sf_dir):
    u = timeline.unique_periods(features(spark, sf_dir), ["id", "year", "month"], ["obs", "milk", "protein", "fat"])
    return timeline.with_month_index(u)


@query("p20_wide_feature_columns", _WIDE_SQL + """
SELECT id, year, month, milk, fat, age, "milk_t-1", "milk_t-2", "fat_t-1", "fat_t-2" FROM l""")
def wide_columns(spark, sf_dir):
    df = modelling.lagged_rows(_unique_features(spark, sf_dir), [1, 2], ["milk", "fat"])
    cols = modelling.wide_feature_columns(df.columns, [1, 2], ["milk", "fat"], ["age"])
    return clean.ordered_projection(df, ["id", "year", "month", *cols])


@query("p21_complete_rows", f"""
SELECT id, obs FROM ({FEATURES}) WHERE scs IS NOT NULL AND milk IS NOT NULL AND protein IS NOT NULL
  AND fat IS NOT NULL AND lactose IS NOT NULL AND ec IS NOT NULL""")
def complete_rows(spark, sf_dir):
    return features(spark, sf_dir).where(clean.complete(config.MEASURES)).select("id", "obs")


# ---- joins ------------------------------------------------------------------------------

_SHIPPED = "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'"


@query("j1_semi_join", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN ({_SHIPPED})")
def semi_join(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return joins.in_universe(table(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey", "o_totalprice")


def _joined(spark, sf_dir):
    od = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    cu = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), "c_acctbal", F.col("c_mktsegment").alias("status"))
    rare = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy(
        F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("signups"))
    return od, cu, rare


@query("j2_multi_join", """
WITH a AS (SELECT o.o_custkey AS id, o.o_orderkey, o.o_orderstatus AS status_x, c.c_acctbal, c.c_mktsegment AS status_y
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
e AS (SELECT user_id AS id, CAST(count(*) AS BIGINT) AS signups FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT coalesce(a.id, e.id) AS id, o_orderkey, status_x, c_acctbal, status_y, signups
FROM a FULL OUTER JOIN e ON a.id = e.id""")
def multi_join(spark, sf_dir):
    od, cu, rare = _joined(spark, sf_dir)
    return joins.merge_all(od, [joins.Join(cu, ["id"], "inner"), joins.Join(rare, ["id"], "outer")], ["absent"])


@query("j3_harmonised_keys", """
SELECT CAST(n.n_regionkey AS VARCHAR) AS k, n.n_name, r.r_name, s.s_suppkey
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def harmonised_keys(spark, sf_dir):
    su = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("n"), "s_suppkey")
    na = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), "n_name", F.col("n_regionkey").alias("k"))
    re = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("k"), "r_name")
    return joins.merge(joins.merge(su, na, ["n"], "inner"), re, ["k"], "inner").select("k", "n_name", "r_name", "s_suppkey")


@query("j4_reduce_join", """
SELECT p_partkey AS k, p.p_brand, x.n, y.q FROM part p
JOIN (SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) x ON p_partkey = x.l_partkey
JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) y ON p_partkey = y.l_partkey""")
def reduce_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k"))
    return joins.reduce_join([
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand"),
        li.agg(F.count(F.lit(1)).alias("n")), li.agg(F.sum("l_quantity").alias("q"))], ["k"], "inner")


@query("j5_entity_fill", f"""
WITH p AS ({PANEL}), f AS (SELECT id, arg_min(breed, (cf_date, obs, breed)) AS b FROM p WHERE breed IS NOT NULL GROUP BY id)
SELECT p.id, p.obs, p.cf_date, p.milk, coalesce(p.breed, f.b) AS breed FROM p LEFT JOIN f ON p.id = f.id""")
def entity_fill(spark, sf_dir):
    rows = panel(spark, sf_dir).select("id", "obs", "cf_date", "milk", "breed")
    return joins.fill_from_entity(rows, "id", "breed", ["cf_date", "obs"])


@query("j6_interval_label", f"""
WITH d AS ({DAYS})
SELECT event_id, user_id, day, CASE WHEN EXISTS (SELECT 1 FROM d e WHERE e.user_id = v.user_id AND e.event_type = 'error'
  AND e.day - v.day > 0 AND e.day - v.day < 3) THEN 1 ELSE 0 END AS label
FROM d v WHERE event_type = 'view'""")
def interval_label(spark, sf_dir):
    rows = days(spark, sf_dir)
    views = rows.where("event_type = 'view'").select("event_id", "user_id", "day")
    errors = rows.where("event_type = 'error'").select("user_id", F.col("day").alias("error_day"))
    return timeline.event_within(views, errors, "user_id", "day", "error_day", 1, 2, "label")


@query("j7_group_stat_lookup", f"""
WITH f AS ({FEATURES}), m AS (SELECT breed, season, median(milk) AS med FROM f
  WHERE milk IS NOT NULL AND breed IS NOT NULL GROUP BY breed, season HAVING count(milk) >= 5)
SELECT f.id, f.obs, f.cf_date, f.season, f.breed, round(coalesce(f.milk, m.med), 6) AS milk
FROM f LEFT JOIN m ON f.breed = m.breed AND f.season = m.season""")
def group_stat_lookup(spark, sf_dir):
    rows = features(spark, sf_dir).select("id", "obs", "cf_date", "season", "breed", "milk")
    imputer = HierarchicalImputer(
        columns=["milk"], entity_levels=[], population_levels=[["breed", "season"]], global_fallback=False, clip_imputed=False)
    return imputer.fit_transform(rows).withColumn("milk", F.round("milk", 6))


@query("j8_one_to_one_attach", """
SELECT o_orderkey, o_custkey, n FROM orders LEFT JOIN (
  SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def one_to_one(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"))
    return joins.attach_one_to_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), rows, ["o_orderkey"])


@query("j9_offset_lookup", f"""
WITH u AS (SELECT DISTINCT ON (id, year * 12 + month) id, year * 12 + month AS idx, obs FROM ({PANEL})
           ORDER BY id, year * 12 + month, obs)
SELECT a.id, a.idx AS month_idx, b.obs AS obs_2_back, c.obs AS obs_1_back, a.obs FROM u a
JOIN u c ON a.id = c.id AND c.idx = a.idx - 1 JOIN u b ON a.id = b.id AND b.idx = a.idx - 2""")
def offset_lookup(spark, sf_dir):
    months = timeline.with_month_index(panel(spark, sf_dir)).groupBy("id", MONTH_IDX).agg(F.min("obs").alias("obs"))
    steps = timeline.sequences(months, "id", ["obs"], 3).where("__n_steps = 3")
    at = [F.col("steps")[i][0].cast("bigint") for i in range(3)]
    return steps.select("id", F.col(MONTH_IDX).alias("month_idx"), at[0].alias("obs_2_back"), at[1].alias("obs_1_back"), "obs")


@query("j10_key_intersection", """
SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def key_intersection(spark, sf_dir):
    od = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    f, o, p = (od.where(F.col("o_orderstatus") == s) for s in "FOP")
    return joins.intersect_keys(f, [o, p], ["id"])


@query("j11_ranked_views_full_join", """
WITH a AS (SELECT l_partkey AS f, dense_rank() OVER (ORDER BY sum(l_quantity) DESC) AS r FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_partkey AS f, dense_rank() OVER (ORDER BY sum(l_tax) DESC) AS r FROM
  (SELECT l_partkey, CAST(round(l_tax * 100) AS BIGINT) AS l_tax FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1)
SELECT coalesce(a.f, b.f) AS feature, CAST(coalesce(a.r, (SELECT max(r) FROM a) + 1) AS INTEGER) AS rank_a,
  CAST(coalesce(b.r, (SELECT max(r) FROM b) + 1) AS INTEGER) AS rank_b
FROM a FULL OUTER JOIN b ON a.f = b.f""")
def ranked_full_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "feature")
    a = li.where("l_returnflag = 'A'").groupBy("feature").agg(F.sum("l_quantity").alias("score"))
    b = li.where("l_returnflag = 'R'").groupBy("feature").agg(
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("score"))
    ra = dense_rank_desc(a, "score", "rank_a").drop("score")
    rb = dense_rank_desc(b, "score", "rank_b").drop("score")
    both = ra.join(rb, "feature", "full")
    worst = ra.agg((F.max("rank_a") + 1).alias("wa")).crossJoin(rb.agg((F.max("rank_b") + 1).alias("wb")))
    return both.crossJoin(F.broadcast(worst)).select(
        "feature", F.coalesce("rank_a", "wa").cast("int").alias("rank_a"), F.coalesce("rank_b", "wb").cast("int").alias("rank_b"))


@query("j12_sum_with_count", """
SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS total, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey""")
def sum_with_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("j13_null_safe_join", f"""
WITH p AS (SELECT id, obs, breed FROM ({PANEL})), n AS (SELECT breed, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY breed)
SELECT p.id, p.obs, p.breed, n.n FROM p LEFT JOIN n ON p.breed IS NOT DISTINCT FROM n.breed""")
def null_safe_join(spark, sf_dir):
    rows = panel(spark, sf_dir).select("id", "obs", "breed")
    return joins.merge(rows, rows.groupBy("breed").agg(F.count(F.lit(1)).alias("n")), ["breed"], "left", null_safe=True)


@query("j2_hot_key_join", """
WITH l AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN 1 ELSE l_suppkey END AS k, l_orderkey, l_linenumber, l_quantity FROM lineitem)
SELECT l.k, l.l_orderkey, l.l_linenumber, l.l_quantity, s.s_nationkey FROM l LEFT JOIN supplier s ON l.k = s.s_suppkey""")
def hot_key_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(None)).when(F.col("l_orderkey") % 3 == 1, F.lit(1)).otherwise(F.col("l_suppkey")).alias("k"),
        "l_orderkey", "l_linenumber", "l_quantity")
    su = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return skew.salted_merge(li, su, ["k"], "left", store=False)


# ---- sorts and set operations -------------------------------------------------------------


@query("o1_stable_sort", f"SELECT id, year, month, milk, obs FROM ({PANEL}) ORDER BY id, year, month, milk NULLS LAST")
def stable_sort(spark, sf_dir):
    keys = [F.asc_nulls_last(c) for c in ("id", "year", "month", "milk")]
    return panel(spark, sf_dir).select("id", "year", "month", "milk", "obs").orderBy(*keys)


@query("o2_top_k_by_rank", """
SELECT model, feature, rank FROM (
  SELECT model, feature, CAST(rank AS INTEGER) AS rank, row_number() OVER (PARTITION BY model ORDER BY rank, feature) AS rn FROM (
    SELECT l_returnflag AS model, CAST(l_suppkey AS VARCHAR) AS feature,
      dense_rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC) AS rank FROM lineitem GROUP BY 1, 2)) WHERE rn <= 3""")
def top_k_by_rank(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_suppkey").cast("string").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return consensus.top_k(dense_rank_desc(counts, "n", "rank", ["model"]), "rank", 3).select("model", "feature", "rank")


@query("o3_custom_label_order", """
SELECT feature, label, to_select FROM (
  SELECT p_brand AS feature, CASE WHEN count(*) % 3 = 0 THEN 'core' WHEN count(*) % 3 = 1 THEN 'support' ELSE 'peripheral' END AS label,
    CASE WHEN count(*) % 3 = 2 THEN 'no' ELSE 'yes' END AS to_select FROM part GROUP BY p_brand)
ORDER BY CASE to_select WHEN 'yes' THEN 0 ELSE 1 END, CASE label WHEN 'core' THEN 0 WHEN 'support' THEN 1 ELSE 2 END, feature""")
def custom_label_order(spark, sf_dir):
    kind = F.count(F.lit(1)) % 3
    labels = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.when(kind == 0, "core").when(kind == 1, "support").otherwise("peripheral").alias("label"),
        F.when(kind == 2, "no").otherwise("yes").alias("to_select"))
    return consensus.vote_order(labels)


@query("o4_report_order", """
SELECT stratum, level, CASE WHEN level = 'R' THEN NULL ELSE round(m, 6) END AS metric FROM (
  SELECT 'flag' AS stratum, l_returnflag AS level, avg(l_quantity) AS m FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT 'status', l_linestatus, avg(l_quantity) FROM lineitem GROUP BY l_linestatus)
ORDER BY stratum, metric DESC NULLS LAST""")
def report_order(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    parts = [
        li.groupBy(F.col(c).alias("level")).agg(F.avg("l_quantity").alias("m")).select(
            F.lit(s).alias("stratum"), "level", F.when(F.col("level") != "R", F.round("m", 6)).alias("metric"))
        for s, c in (("flag", "l_returnflag"), ("status", "l_linestatus"))]
    return quality.report_order(parts[0].unionByName(parts[1]), ["metric"])


@query("u1_union_all", "SELECT l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderkey AS k FROM orders")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).unionByName(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))


def _strata(spark, sf_dir, status):
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(
        "o_orderpriority", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"))


_STRATA = """SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
  CAST(day(o_orderdate) AS INTEGER) AS d FROM orders WHERE o_orderstatus = """


@query("u2_strata_intersection", f"{_STRATA}'F' INTERSECT {_STRATA}'P'")
def strata_intersection(spark, sf_dir):
    return _strata(spark, sf_dir, "F").intersect(_strata(spark, sf_dir, "P"))


@query("u3_strata_difference", f"{_STRATA}'F' EXCEPT {_STRATA}'P'")
def strata_difference(spark, sf_dir):
    return _strata(spark, sf_dir, "F").subtract(_strata(spark, sf_dir, "P"))


@query("u4_distinct_union", "SELECT l_partkey AS f FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_suppkey FROM lineitem")
def distinct_union(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("f")).unionByName(
        li.select(F.col("l_suppkey").alias("f"))).distinct()


@query("u5_top_pool_union", """
WITH s AS (SELECT l_returnflag AS model, CAST(l_suppkey AS VARCHAR) AS feature, sum(l_quantity) AS a, sum(l_linenumber) AS b FROM lineitem GROUP BY 1, 2),
r AS (SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY a DESC, feature) AS ra, row_number() OVER (PARTITION BY model ORDER BY b DESC, feature) AS rb FROM s)
SELECT model, string_agg(feature, ',' ORDER BY feature) AS pool FROM r WHERE ra <= 3 OR rb <= 3 GROUP BY model""")
def top_pool_union(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_suppkey").cast("string").alias("feature")).agg(
        F.sum("l_quantity").alias("a"), F.sum("l_linenumber").alias("b"))
    perm = dense_rank_desc(s, "a", "rank_perm", ["model"])
    shap = dense_rank_desc(s, "b", "rank_shap", ["model"])
    return consensus.top_pool(perm, shap, 3).select("model", F.concat_ws(",", F.array_sort("pool")).alias("pool"))


@query("u6_distinct_keys", f"SELECT DISTINCT id, year, month FROM ({PANEL})")
def distinct_keys(spark, sf_dir):
    return panel(spark, sf_dir).select("id", "year", "month").dropDuplicates(["id", "year", "month"])


# ---- scalar functions ---------------------------------------------------------------------


@query("t1_reference_date", f"""
SELECT id, obs, coalesce(CASE WHEN id % 3 = 0 THEN cf_date END, calving_date, t_date) AS reference FROM ({PANEL})""")
def reference_date(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("id", "obs", S.reference_date(
        [F.when(F.col("id") % 3 == 0, F.col("cf_date")), "calving_date", "t_date"]).alias("reference"))


@query("t2_age_years", f"SELECT id, obs, CAST(floor((cf_date - birth_date) / 365.25) AS INTEGER) AS age FROM ({PANEL})")
def age_years(spark, sf_dir):
    return panel(spark, sf_dir).select("id", "obs", S.age_years("cf_date", "birth_date").alias("age"))


@query("t3_age_class", f"""
SELECT id, obs, age, CASE WHEN age > 1.5 AND age <= 3.5 THEN '2_3' WHEN age > 3.5 AND age <= 5.5 THEN '4_5'
  WHEN age > 5.5 AND age <= 7.5 THEN '6_7' END AS age_class FROM ({FEATURES})""")
def age_class(spark, sf_dir):
    return features(spark, sf_dir).select(
        "id", "obs", "age", S.bin_right_closed("age", config.AGE_EDGES, config.AGE_LABELS).alias("age_class"))


@query("t4_season", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM orders""")
def season(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.season(F.month("o_orderdate")).alias("season"))


@query("t5_cyclic_month", """
SELECT o_orderkey, round(sin((month(o_orderdate) - 1) * (2.0 * pi() / 12.0)), 9) + 0.0 AS month_sin,
  round(cos((month(o_orderdate) - 1) * (2.0 * pi() / 12.0)), 9) + 0.0 AS month_cos FROM orders""")
def cyclic_month(spark, sf_dir):
    angle = S.month_angle(F.month("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.round(F.sin(angle), 9) + 0.0).alias("month_sin"),
        (F.round(F.cos(angle), 9) + 0.0).alias("month_cos"))  # + 0.0: no negative zero


_SINCE = "(year * 12 + month) - (year(other) * 12 + month(other))"


@query("t6_months_since_event", f"""
SELECT id, obs, CASE WHEN {_SINCE} >= 0 THEN CAST({_SINCE} AS INTEGER) END AS months
FROM (SELECT *, CAST(cf_date + (CAST(id % 400 AS INTEGER) - 300) AS DATE) AS other FROM ({PANEL}))""")
def months_since(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("other", F.date_add("cf_date", (F.col("id") % 400 - 300).cast("int")))
    return p.select("id", "obs", S.months_since("year", "month", "other").alias("months"))


@query("t7_lactation_phase", f"""
SELECT id, obs, CASE WHEN m = 0 THEN 'peripartum' WHEN m = 1 THEN 'early_lactation' WHEN m IN (2, 3) THEN 'peak'
  WHEN m IN (4, 5, 6) THEN 'mid_lactation' WHEN m >= 7 THEN 'late_lactation' END AS lactation_phase
FROM (SELECT id, obs, obs % 10 - 1 AS m FROM ({PANEL}))""")
def lactation_phase(spark, sf_dir):
    return panel(spark, sf_dir).select("id", "obs", S.lactation_phase(F.col("obs") % 10 - 1).alias("lactation_phase"))


@query("t8_month_index", f"SELECT id, obs, CAST(year * 12 + month AS INTEGER) AS month_idx FROM ({PANEL})")
def month_index(spark, sf_dir):
    return panel(spark, sf_dir).select("id", "obs", S.month_index("year", "month").alias("month_idx"))


@query("t9_safe_date", """
SELECT o_orderkey, try_cast(format('{:04d}-{:02d}-{:02d}', CAST(year(o_orderdate) AS INTEGER),
  CAST(month(o_orderdate) AS INTEGER), CAST(1 + o_orderkey % 31 AS INTEGER)) AS DATE) AS d FROM orders""")
def safe_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.safe_date(
        F.year("o_orderdate"), F.month("o_orderdate"), (1 + F.col("o_orderkey") % 31)).alias("d"))


@query("t10_tolerant_date_parse", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS d FROM orders""")
def tolerant_date(spark, sf_dir):
    day, kind = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 3
    text = (
        F.when(kind == 0, F.date_format(day, "d/M/yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise("31/02/2020"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_date(text, ["d/M/yyyy", "yyyy-MM-dd"]).alias("d"))


@query("t11_tolerant_number", """
SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events""")
def tolerant_number(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "n/a").when(F.col("event_id") % 3 != 0, F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.safe_double(text).alias("v"))


@query("t12_binary_flag", """
SELECT doc_id, coalesce(CAST(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS INTEGER), 0) AS flag FROM labels""")
def binary_flag(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 == 0, "unknown").when(F.col("doc_id") % 5 != 0, F.col("quality").cast("string"))
    return table(spark, sf_dir, "labels").select("doc_id", S.binary_flag(text).alias("flag"))


@query("t13_clip_imputed", f"""
SELECT event_id, CASE WHEN value IS NULL THEN greatest(20.0, least(60.0, raw_value)) ELSE value END AS value FROM ({DAYS})""")
def clip_imputed(spark, sf_dir):
    d = days(spark, sf_dir)
    return d.select("event_id", S.clip_where(
        F.coalesce("value", "raw_value"), F.col("value").isNull(), 20.0, 60.0).alias("value"))


@query("t14_year_month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def year_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.year_month_key(F.year("o_orderdate"), F.month("o_orderdate")).alias("ym"))


_LIST = "coalesce(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> ''), [])"
_RAW = "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE replace(p_name, ' ', ' , ,') || ', ' || p_type END AS raw FROM part"


def _raw_lists(spark, sf_dir):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ,")), F.lit(", "), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 != 0, raw).alias("raw"))


@query("t16_split_list", f"SELECT p_partkey, array_to_string({_LIST}, '|') AS items, CAST(len({_LIST}) AS INTEGER) AS n FROM ({_RAW})")
def split_list(spark, sf_dir):
    items = S.split_list("raw")
    return _raw_lists(spark, sf_dir).select("p_partkey", F.concat_ws("|", items).alias("items"), F.size(items).alias("n"))


@query("t17_count_in_pool", f"""
SELECT p_partkey, CAST(len(list_filter(list_slice({_LIST}, 1, 2), lambda x: x IN ('large', 'bolt', 'hot', 'LARGE'))) AS INTEGER) AS n
FROM ({_RAW})""")
def count_in_pool(spark, sf_dir):
    pool = F.array(*[F.lit(x) for x in ("large", "bolt", "hot", "LARGE")])
    return _raw_lists(spark, sf_dir).select("p_partkey", S.count_in_pool(S.split_list("raw"), pool, 2).alias("n"))


@query("t18_dead_zone_sign", f"""
SELECT event_id, CASE WHEN v IS NULL OR abs(v) <= 0.5 THEN 'zero' WHEN v > 0 THEN 'pos' ELSE 'neg' END AS sign
FROM (SELECT event_id, value / 50.0 - 1.0 AS v FROM ({DAYS}))""")
def dead_zone_sign(spark, sf_dir):
    return days(spark, sf_dir).select("event_id", S.dead_zone_sign(F.col("value") / 50.0 - 1.0, 0.5).alias("sign"))


_VIEWS = """SELECT p_partkey, 1 + p_partkey % 17 AS a, 1 + p_size % 13 AS b, p_size % 4 AS n,
  CASE WHEN p_partkey % 2 = 0 THEN 'zero' ELSE 'pos' END AS s FROM part"""


@query("t19_consensus_label", f"""
SELECT p_partkey,
  CASE WHEN a <= 10 AND b <= 10 THEN 'core' WHEN a <= 3 OR b <= 3 OR n >= 2 THEN 'supportive'
       WHEN (a <= 10 OR b <= 10) AND s <> 'zero' THEN 'supportive' ELSE 'peripheral' END AS label,
  CASE WHEN a <= 10 AND b <= 10 THEN 'two_view_rank_agreement' WHEN a <= 3 OR b <= 3 THEN 'single_view_rank'
       WHEN n >= 2 THEN 'interaction_support'
       WHEN (a <= 10 OR b <= 10) AND s <> 'zero' THEN 'monotonic_direction_support' ELSE 'weak_support' END AS reason
FROM ({_VIEWS})""")
def consensus_label(spark, sf_dir):
    v = S.consensus_label(
        1 + F.col("p_partkey") % 17, 1 + F.col("p_size") % 13, F.col("p_size") % 4,
        F.when(F.col("p_partkey") % 2 == 0, "zero").otherwise("pos"), 10, 3, 2)
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.label", "v.reason")


@query("t20_stratum_key", """
SELECT o_orderpriority, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y,
  CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS positives,
  CAST(count(*) FILTER (WHERE o_totalprice <= 200000) AS BIGINT) AS negatives FROM orders GROUP BY 1, 2, 3""")
def stratum_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("y"),
        F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).alias("__class"))
    return sampling.stratum_counts(rows, ["o_orderpriority", "o_orderstatus", "y"])


@query("t21_one_hot", f"""
SELECT id, obs, breed, CASE WHEN breed = 'bruna' THEN 1 ELSE 0 END AS breed_bruna,
  CASE WHEN breed = 'frisona' THEN 1 ELSE 0 END AS breed_frisona FROM ({PANEL})""")
def one_hot(spark, sf_dir):
    out, _ = modelling.one_hot(panel(spark, sf_dir).select("id", "obs", "breed"), ["breed", "absent"], {"breed": ["bruna", "frisona"]})
    return out


@query("t22_report_rounding", """
SELECT l_returnflag, round(100.0 * avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 2) AS pct,
  round(avg(l_quantity) / 7.0, 4) AS metric FROM lineitem GROUP BY l_returnflag""")
def report_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(100.0 * F.avg((F.col("l_discount") > 0.05).cast("double")), 2).alias("pct"),
        F.round(F.avg("l_quantity") / 7.0, 4).alias("metric"))


@query("f1_row_expressions", f"""
SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band,
  CASE WHEN value IS NULL OR abs(value - 40) <= 10 THEN 'zero' WHEN value > 40 THEN 'pos' ELSE 'neg' END AS sign FROM ({DAYS})""")
def row_expressions(spark, sf_dir):
    v = F.col("value")
    return days(spark, sf_dir).select(
        "event_id", F.when(v > 50, "high").when(v > 10, "mid").otherwise("low").alias("band"),
        S.dead_zone_sign(v - 40, 10).alias("sign"))
