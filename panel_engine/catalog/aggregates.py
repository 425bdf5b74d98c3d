"""Aggregations, windows, sampling, imputation and quality metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.catalog.base import query
from panel_engine.catalog.frames import DAYS, FEATURES, PANEL, days, features, panel, table
from panel_engine.operators import clean, consensus, impute, quality, reduce, sampling, timeline
from panel_engine.operators.impute import HierarchicalImputer, HierarchicalImputerModel
from panel_engine.operators.ordered import cumulative, dense_rank_desc, grouped_quantiles
from panel_engine.operators.timeline import MONTH_IDX
from panel_engine.plans import modelling, preparation
from panel_engine.sources.scratch import materialize, new_path

# ---- per-key reductions -----------------------------------------------------------------


@query("a1_first_non_null", f"""
SELECT user_id, day, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value, min(event_type) AS event_type
FROM ({DAYS}) GROUP BY user_id, day""")
def first_non_null(spark, sf_dir):
    d = days(spark, sf_dir)
    values = reduce.first_non_null(d, ["user_id", "day"], ["value"], ["event_id"])
    return values.join(reduce.first_non_null(d, ["user_id", "day"], ["event_type"]), ["user_id", "day"])


@query("a2_earliest_date", f"SELECT id, min(birth_date) AS birth_date FROM ({PANEL}) GROUP BY id")
def earliest_date(spark, sf_dir):
    return reduce.earliest(panel(spark, sf_dir), "id", "birth_date")


_VOTE = """
SELECT {k}, {c} FROM (SELECT {k}, {c}, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {c}) AS rn
  FROM {t} WHERE {c} IS NOT NULL GROUP BY {k}, {c}) WHERE rn = 1"""


@query("a3_majority_vote", _VOTE.format(k="o_custkey", c="o_orderpriority", t="orders"))
def majority_vote(spark, sf_dir):
    return reduce.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("a4_event_collapse", """
SELECT l_partkey AS id, l_shipdate::DATE AS day, CAST(count(*) AS BIGINT) AS same_day_records FROM lineitem
GROUP BY 1, 2 HAVING coalesce(sum(CASE WHEN l_linenumber = 1 THEN l_quantity END), 0)
  + coalesce(sum(CASE WHEN l_linenumber = 2 THEN 0 END), 0) > 0""")
def event_collapse(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_shipdate").cast("date").alias("day"),
        F.when(n == 1, F.col("l_quantity")).alias("female_alive"), F.when(n == 2, 0.0).alias("female_dead"))
    return reduce.collapse_events(rows, ["id", "day"], ["female_alive", "female_dead", "absent"], "same_day_records")


@query("a5_earliest_per_period", """
SELECT o_custkey, y, m, o_orderkey, d FROM (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, o_orderkey,
    CAST(o_orderdate AS DATE) AS d,
    row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), month(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def earliest_per_period(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), "o_orderkey",
        F.col("o_orderdate").cast("date").alias("d"))
    return reduce.earliest_per_period(rows, ["o_custkey", "y", "m"], ["d", "o_orderkey"])


@query("a6_group_median", f"""
SELECT breed, season, CAST(count(milk) AS BIGINT) AS n, round(median(milk), 6) AS median FROM ({FEATURES})
WHERE breed IS NOT NULL AND milk IS NOT NULL GROUP BY breed, season HAVING count(milk) >= 10""")
def group_median(spark, sf_dir):
    stats = impute.group_medians(features(spark, sf_dir), ["milk"], [["breed", "season"]], 10, False)
    return stats.select(F.col("key_values")[0].alias("breed"), F.col("key_values")[1].alias("season"), "n",
                        F.round("median", 6).alias("median"))


_AGED = f"""SELECT *, CASE WHEN age > 1.5 AND age <= 3.5 THEN '2_3' WHEN age > 3.5 AND age <= 5.5 THEN '4_5'
  WHEN age > 5.5 AND age <= 7.5 THEN '6_7' END AS age_class FROM ({FEATURES})"""
_LEVELS = [*config.ENTITY_LEVELS, *config.POPULATION_LEVELS]


def _stats_sql(measures, min_n, levels=_LEVELS) -> str:
    parts = []
    for c in measures:
        for i, keys in enumerate(levels):
            known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
            values = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
            parts.append(
                f"SELECT '{c}' AS feature, {i} AS level, '{' -> '.join(keys)}' AS level_keys, {values} AS key_values, "
                f"count(*) AS n, median(CAST({c} AS DOUBLE)) AS median FROM aged WHERE {c} IS NOT NULL AND {known} "
                f"GROUP BY {', '.join(keys)} HAVING count(*) >= {min_n}")
        parts.append(
            f"SELECT '{c}', {len(levels)}, 'GLOBAL', '', count(*), median(CAST({c} AS DOUBLE)) FROM aged "
            f"WHERE {c} IS NOT NULL HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


@query("a7_multi_level_statistics", f"""
WITH aged AS ({_AGED}), stats AS ({_stats_sql(["milk", "fat"], 5)})
SELECT feature, CAST(level AS INTEGER) AS level, level_keys, key_values, CAST(n AS BIGINT) AS n, round(median, 6) AS median FROM stats""")
def multi_level_statistics(spark, sf_dir):
    model = HierarchicalImputer(columns=["milk", "fat"], min_group_n=5).fit(features(spark, sf_dir))
    return model.stats.select("feature", "level", "level_keys", F.concat_ws("|", "key_values").alias("key_values"), "n",
                              F.round("median", 6).alias("median"))


@query("a8_global_median", "SELECT round(median(l_extendedprice), 6) AS median, CAST(count(*) AS BIGINT) AS n FROM lineitem")
def global_median(spark, sf_dir):
    q = grouped_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.5])
    return q.select(F.round("q_0", 6).alias("median"), "n")


_DIST = """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS n_ids, CAST(min(n) AS BIGINT) AS min,
  median(n) AS median, CAST(max(n) AS BIGINT) AS max FROM (SELECT count(*) AS n FROM ({src}) GROUP BY {k})"""


@query("a9_count_distribution", _DIST.format(src="SELECT * FROM events WHERE event_type = 'purchase'", k="user_id"))
def count_distribution(spark, sf_dir):
    return reduce.count_distribution(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "user_id")


@query("a10_reconciliation", """
WITH b AS (SELECT o_custkey AS id, count(*) AS n, max(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS price,
    max(CASE WHEN o_orderdate < DATE '1996-01-01' THEN 1 ELSE 0 END) AS old FROM orders GROUP BY 1),
a AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_totalprice <= 400000 AND o_orderdate >= DATE '1996-01-01' GROUP BY 1),
j AS (SELECT b.n AS nb, coalesce(a.n, 0) AS na, price, old FROM b LEFT JOIN a ON a.id = b.id)
SELECT CAST(count(*) AS BIGINT) AS entities, CAST(count(*) FILTER (WHERE nb <> na) AS BIGINT) AS changed,
  CAST(count(*) FILTER (WHERE na = 0) AS BIGINT) AS lost_entirely, CAST(sum(nb - na) AS BIGINT) AS events_removed,
  CAST(count(*) FILTER (WHERE nb <> na AND price = 1) AS BIGINT) AS by_price,
  CAST(count(*) FILTER (WHERE nb <> na AND old = 1) AS BIGINT) AS by_old FROM j""")
def reconciliation(spark, sf_dir):
    od = table(spark, sf_dir, "orders")
    price, old = F.col("o_totalprice") > 400000, F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return reduce.reconcile(od, od.where(~price & ~old), "o_custkey", {"price": price, "old": old})


@query("a11_rule_counters", f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS missing_rows,
  CAST(count(DISTINCT CASE WHEN value IS NULL THEN user_id END) AS BIGINT) AS missing_ids,
  CAST(count(*) FILTER (WHERE value > 60) AS BIGINT) AS high_rows,
  CAST(count(DISTINCT CASE WHEN value > 60 THEN user_id END) AS BIGINT) AS high_ids FROM ({DAYS})""")
def rule_counters(spark, sf_dir):
    return reduce.rule_counters(days(spark, sf_dir), "user_id", {
        "missing": F.col("value").isNull(), "high": F.col("value") > 60})


# ---- correlation and distribution shift -------------------------------------------------

_M = ["scs", "milk", "protein", "fat", "lactose", "ec"]


def _corr_sql(src, cols=_M, groups="") -> str:
    g = f"{groups}, " if groups else ""
    by = f" GROUP BY {groups}" if groups else ""
    return " UNION ALL ".join(
        f"SELECT {g}'{a}' AS feature_a, '{b}' AS feature_b, "
        f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS corr FROM {src}{by}"
        for a, b in combinations(cols, 2))


@query("a12_correlation_matrix", f"""
WITH f AS ({FEATURES}), c AS ({_corr_sql('f')}) SELECT feature_a, feature_b, round(corr, 6) + 0.0 AS corr FROM c""")
def correlation_matrix(spark, sf_dir):
    return quality.correlation_pairs(features(spark, sf_dir), _M).withColumn("corr", F.round("corr", 6) + 0.0)


_FILLS = {"scs": 4.0, "milk": 25.0, "protein": 2.5, "fat": 4.0, "lactose": 4.6, "ec": 900.0}
_POST = f"""SELECT * REPLACE ({', '.join(f'coalesce({c}, {v}) AS {c}' for c, v in _FILLS.items())}) FROM f"""


def _post(df):
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in _FILLS.items()})


@query("a13_correlation_shift", f"""
WITH f AS ({FEATURES}), g AS ({_POST}), a AS ({_corr_sql('f')}), b AS ({_corr_sql('g')}),
d AS (SELECT feature_a, feature_b, abs(a.corr - b.corr) AS delta FROM a JOIN b USING (feature_a, feature_b))
SELECT feature, round(avg(delta), 6) AS mean_abs_delta_corr FROM (
  SELECT feature_a AS feature, delta FROM d UNION ALL SELECT feature_b, delta FROM d UNION ALL SELECT '__global__', delta FROM d)
GROUP BY feature""")
def correlation_shift(spark, sf_dir):
    pre = features(spark, sf_dir)
    shift = quality.correlation_shift(pre, _post(pre), _M, [])
    per_feature = quality.shift_by_feature(shift, [])
    overall = shift.agg(F.avg("delta").alias("mean_abs_delta_corr")).withColumn("feature", F.lit("__global__"))
    return per_feature.unionByName(overall).withColumn("mean_abs_delta_corr", F.round("mean_abs_delta_corr", 6))


def _nwd_sql(groups: str = "") -> str:
    """CTEs x (pre cells) and y (post cells) must exist: (groups, feature, value)."""
    g = f"{groups}, feature"
    return f"""
vals AS (SELECT {g}, value, sum(x) AS x, sum(y) AS y FROM (
  SELECT {g}, value, 1 AS x, 0 AS y FROM x WHERE value IS NOT NULL UNION ALL
  SELECT {g}, value, 0, 1 FROM y WHERE value IS NOT NULL) GROUP BY {g}, value),
cdf AS (SELECT {g}, value, lead(value) OVER w AS nxt, sum(x) OVER w / sum(x) OVER (PARTITION BY {g}) AS fx,
  sum(y) OVER w / sum(y) OVER (PARTITION BY {g}) AS fy FROM vals WINDOW w AS (PARTITION BY {g} ORDER BY value)),
wd AS (SELECT {g}, coalesce(sum(abs(fx - fy) * (nxt - value)), 0) AS distance FROM cdf GROUP BY {g}),
iq AS (SELECT {g}, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM x WHERE value IS NOT NULL GROUP BY {g}),
nwd AS (SELECT wd.*, CASE WHEN iqr > 0 THEN distance / iqr WHEN distance = 0 THEN 0 END AS nw FROM wd LEFT JOIN iq USING ({g}))"""


def _cells_sql(src, groups="") -> str:
    g = f"{groups}, " if groups else ""
    return " UNION ALL ".join(f"SELECT {g}'{c}' AS feature, {c} AS value FROM {src}" for c in _M)


@query("a14_wasserstein", f"""
WITH f AS ({FEATURES}), g AS ({_POST}), x AS ({_cells_sql('f', 'season')}), y AS ({_cells_sql('g', 'season')}), {_nwd_sql('season')}
SELECT season, feature, round(distance, 6) AS distance, round(nw, 6) AS normalized_wasserstein FROM nwd""")
def wasserstein(spark, sf_dir):
    pre = features(spark, sf_dir)
    a, b = (quality.to_cells(d, _M, ["season"]) for d in (pre, _post(pre)))
    keys = ["season", "feature"]
    return quality.wasserstein(a, b, keys).withColumns({
        c: F.round(c, 6) for c in ("distance", "normalized_wasserstein")})


@query("a15_duplicate_report", """
SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_rows_detected,
  CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_keys_detected, CAST(count(*) AS BIGINT) AS deduplicated_rows_kept
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicate_report(spark, sf_dir):
    return reduce.duplicate_report(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a16_missing_and_imputed", f"""
WITH f AS ({FEATURES}) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(*) AS BIGINT) AS n_rows, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS pct_missing_pre, "
    f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL AND breed IS NOT NULL) / count(*), 2) AS pct_imputed FROM f" for c in _M))
def missing_and_imputed(spark, sf_dir):
    pre = features(spark, sf_dir)
    known = F.col("breed").isNotNull()
    post = pre.withColumns({c: F.when(known, F.coalesce(c, F.lit(v))).otherwise(F.col(c)) for c, v in _FILLS.items()})
    out = quality.missing_and_imputed(pre, post, _M, [])
    return out.withColumns({c: F.round(c, 2) for c in ("pct_missing_pre", "pct_imputed")})


_STRATA = ["breed", "season"]


def _stratified(src) -> str:
    cols = ", ".join(_M)
    return " UNION ALL ".join(
        [f"SELECT '__all__' AS stratum, '__all__' AS level, {cols} FROM {src}"]
        + [f"SELECT '{s}', coalesce({s}, 'NA'), {cols} FROM {src}" for s in _STRATA])


_G = "stratum, level"
_REPORT_CTES = f"""
WITH f AS ({FEATURES}), g AS ({_POST}), pf AS ({_stratified('f')}), pg AS ({_stratified('g')}),
a AS ({_corr_sql('pf', groups=_G)}), b AS ({_corr_sql('pg', groups=_G)}),
d AS (SELECT {_G}, feature_a, feature_b, abs(a.corr - b.corr) AS delta FROM a JOIN b USING ({_G}, feature_a, feature_b)),
x AS ({_cells_sql('pf', _G)}), y AS ({_cells_sql('pg', _G)}), {_nwd_sql(_G)}"""


@query("a17_stratified_report", _REPORT_CTES + f""",
e AS (SELECT {_G}, feature, avg(delta) AS dc FROM (
  SELECT {_G}, feature_a AS feature, delta FROM d UNION ALL SELECT {_G}, feature_b, delta FROM d) GROUP BY {_G}, feature),
n AS (SELECT {_G}, feature, count(*) AS n_rows, 100.0 * count(*) FILTER (WHERE value IS NULL) / count(*) AS miss FROM x GROUP BY {_G}, feature)
SELECT {_G}, feature, CAST(n_rows AS BIGINT) AS n_rows, round(miss, 2) AS pct_missing_pre, round(miss, 2) AS pct_imputed,
  round(dc, 4) AS mean_abs_delta_corr, round(nw, 4) AS normalized_wasserstein
FROM n LEFT JOIN e USING ({_G}, feature) LEFT JOIN nwd USING ({_G}, feature)""")
def stratified_report(spark, sf_dir):
    pre = materialize(features(spark, sf_dir).select(*_M, *_STRATA), "before")
    return quality.feature_report(pre, _post(pre), _M, _STRATA)


@query("a18_stratum_report", """
WITH s AS (SELECT o_orderpriority, month(o_orderdate) AS m, count(*) FILTER (WHERE o_totalprice > 480000) AS p,
  count(*) FILTER (WHERE o_totalprice <= 480000 AND o_orderstatus = 'F') AS q FROM orders
  WHERE o_totalprice > 480000 OR o_orderstatus = 'F' GROUP BY 1, 2)
SELECT CAST(count(*) FILTER (WHERE p > 0) AS BIGINT) AS positive_strata, CAST(count(*) FILTER (WHERE q > 0) AS BIGINT) AS negative_strata,
  CAST(count(*) FILTER (WHERE p > 0 AND q > 0) AS BIGINT) AS overlap_strata,
  CAST(count(*) FILTER (WHERE p > 0 AND q = 0) AS BIGINT) AS dropped_positive_only_strata,
  CAST(count(*) FILTER (WHERE q > 0 AND p = 0) AS BIGINT) AS dropped_negative_only_strata,
  CAST(count(*) FILTER (WHERE p > 0 AND q > 0 AND least(p // 2, q // 9) = 0) AS BIGINT) AS dropped_insufficient_overlap_strata FROM s""")
def stratum_report(spark, sf_dir):
    price = F.col("o_totalprice") > 480000
    rows = table(spark, sf_dir, "orders").where(price | (F.col("o_orderstatus") == "F")).select(
        "o_orderpriority", F.month("o_orderdate").alias("m"), F.when(price, 1).otherwise(0).alias("__class"))
    return sampling.stratum_report(rows, ["o_orderpriority", "m"], (2, 9))


_LABELS = f"""SELECT model, feature, CASE WHEN rn <= 5 THEN 'core' WHEN rn <= 12 THEN 'supportive' ELSE 'peripheral' END AS model_label
FROM (SELECT l_returnflag AS model, p_brand AS feature, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC, p_brand) AS rn
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@query("a19_vote_counting", f"""
SELECT feature, CASE WHEN c >= 2 OR c + s >= 2 THEN 'yes' ELSE 'no' END AS to_select,
  CASE WHEN c >= 2 THEN 'core' WHEN c + s >= 2 THEN 'support' ELSE 'peripheral' END AS label,
  CAST(c AS BIGINT) AS core_votes, CAST(s AS BIGINT) AS supportive_votes, CAST(4 - c - s AS BIGINT) AS peripheral_votes
FROM (SELECT feature, count(*) FILTER (WHERE model_label = 'core') AS c, count(*) FILTER (WHERE model_label = 'supportive') AS s
  FROM ({_LABELS}) GROUP BY feature)""")
def vote_counting(spark, sf_dir):
    sums = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_returnflag").alias("model"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("q")))
    ranked = dense_rank_desc(sums, "q", "r", ["model"])
    best = consensus.top_k(ranked, "r", 12).select("model", "feature", F.lit(1).alias("top12"))
    core = consensus.top_k(ranked, "r", 5).select("model", "feature", F.lit(1).alias("top5"))
    keys = ["model", "feature"]
    labels = sums.join(best, keys, "left").join(core, keys, "left").select(
        *keys, F.when(F.col("top5") == 1, "core").when(F.col("top12") == 1, "supportive").otherwise("peripheral").alias("model_label"))
    return consensus.vote(labels, ["A", "N", "R", "absent"])


@query("a20_class_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(disease) AS BIGINT) AS positives, CAST(sum(1 - disease) AS BIGINT) AS negatives,
  CAST(count(DISTINCT id) AS BIGINT) AS unique_ids FROM ({FEATURES})""")
def class_summary(spark, sf_dir):
    return reduce.class_summary(features(spark, sf_dir), "id", "disease")


@query("a21_ever_flag", f"""
WITH p AS ({PANEL})
SELECT id, obs, cf_date, max(CASE WHEN diagnosis IS NOT NULL OR scs >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS unhealthy FROM p""")
def ever_flag(spark, sf_dir):
    sick = F.col("diagnosis").isNotNull() | (F.col("scs") >= 8)
    return timeline.ever_flag(panel(spark, sf_dir), "id", sick, "unhealthy").select("id", "obs", "cf_date", "unhealthy")


def imputed_sql(min_n: int) -> str:
    """CTEs up to ``filled``: candidate medians per level beside every row."""
    joins_, picks = [], []
    ctes = [f"aged AS ({_AGED})"]
    for i, keys in enumerate(_LEVELS):
        cols = ", ".join(f"CASE WHEN count({c}) >= {min_n} THEN median({c}) END AS {c}_{i}" for c in _M)
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        ctes.append(f"l{i} AS (SELECT {', '.join(keys)}, {cols} FROM aged WHERE {known} GROUP BY {', '.join(keys)})")
        joins_.append(f"LEFT JOIN l{i} ON " + " AND ".join(f"aged.{k} = l{i}.{k}" for k in keys))
    ctes.append("gl AS (SELECT " + ", ".join(f"median({c}) AS {c}_6" for c in _M) + " FROM aged)")
    for c in _M:
        lo, hi = config.PLAUSIBLE_RANGES[c]
        options = ", ".join(f"{c}_{i}" for i in range(7))
        names = [*(" -> ".join(k) for k in _LEVELS), "GLOBAL"]
        tag = " ".join(f"WHEN {c}_{i} IS NOT NULL THEN '{n}'" for i, n in enumerate(names))
        picks.append(
            f"CASE WHEN aged.{c} IS NULL THEN greatest({lo}, least({hi}, coalesce({options}))) ELSE aged.{c} END AS f_{c}, "
            f"CASE WHEN aged.{c} IS NULL THEN CASE {tag} END END AS t_{c}, "
            f"(aged.{c} IS NULL AND (coalesce({options}) < {lo} OR coalesce({options}) > {hi})) AS x_{c}")
    ctes.append(f"filled AS (SELECT aged.*, {', '.join(picks)} FROM aged {' '.join(joins_)} CROSS JOIN gl)")
    return "WITH " + ", ".join(ctes)


@query("a22_level_usage", imputed_sql(5) + " SELECT feature, level, CAST(count(*) AS BIGINT) AS filled, CAST(count(*) FILTER (WHERE clipped) AS BIGINT) AS clipped FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, t_{c} AS level, x_{c} AS clipped FROM filled WHERE t_{c} IS NOT NULL" for c in _M)
       + ") GROUP BY feature, level")
def level_usage(spark, sf_dir):
    rows = materialize(features(spark, sf_dir), "features")
    return preparation.impute_counted(rows, min_group_n=5)[2]


@query("f2_hierarchical_imputer", imputed_sql(10) + " SELECT id, obs, cf_date, " + ", ".join(f"round(f_{c}, 8) AS {c}" for c in _M) + " FROM filled")
def hierarchical_imputer(spark, sf_dir):
    """Fit on all rows, store the medians, load them and fill."""
    rows = materialize(features(spark, sf_dir), "features")
    path = HierarchicalImputer(min_group_n=10).fit(rows).save(new_path(spark, "imputer"))
    filled = HierarchicalImputerModel.load(spark, path).transform(rows)
    return filled.select("id", "obs", "cf_date", *[F.round(c, 8).alias(c) for c in _M])


# ---- windows ------------------------------------------------------------------------------


@query("w1_forward_fill", f"""
SELECT id, obs, cf_date, calving_date, last_value(calving_date IGNORE NULLS) OVER (PARTITION BY id
  ORDER BY year, month, cf_date NULLS LAST, calving_date NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_calving
FROM ({PANEL})""")
def forward_fill(spark, sf_dir):
    out = timeline.forward_fill(panel(spark, sf_dir), "id", ["year", "month", "cf_date"], "calving_date", "last_calving")
    return out.select("id", "obs", "cf_date", "calving_date", "last_calving")


_DAY_ROWS = f"SELECT user_id, day, dom, min(event_id) AS first_event, count(*) AS n FROM ({DAYS}) GROUP BY user_id, day, dom"


def _day_rows(spark, sf_dir):
    return days(spark, sf_dir).groupBy("user_id", "day", "dom").agg(
        F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")).withColumn(MONTH_IDX, F.unix_date("day"))


@query("w2_lags", f"""
WITH d AS ({_DAY_ROWS})
SELECT user_id, day, first_event, lag(first_event, 1) OVER w AS "first_event_t-1", lag(first_event, 2) OVER w AS "first_event_t-2"
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def lags(spark, sf_dir):
    out = timeline.add_lags(_day_rows(spark, sf_dir), "user_id", ["first_event"], [1, 2])
    return out.select("user_id", "day", "first_event", "`first_event_t-1`", "`first_event_t-2`")


@query("w3_consecutive_mask", f"""
WITH d AS ({_DAY_ROWS})
SELECT user_id, day FROM (SELECT user_id, day, lag(day, 1) OVER w AS l1, lag(day, 2) OVER w AS l2
  FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)) WHERE day - l1 = 1 AND day - l2 = 2""")
def consecutive_mask(spark, sf_dir):
    out = timeline.add_lags(_day_rows(spark, sf_dir), "user_id", [], [1, 2])
    return out.where(timeline.consecutive([1, 2])).select("user_id", "day")


@query("w4_first_known_per_entity", f"""
SELECT id, arg_min(breed, (year, month, cf_date, obs, breed)) FILTER (WHERE breed IS NOT NULL) AS breed FROM ({PANEL}) GROUP BY id""")
def first_known(spark, sf_dir):
    return reduce.first_non_null(panel(spark, sf_dir), ["id"], ["breed"], ["year", "month", "cf_date", "obs"])


@query("w5_dense_rank", """
SELECT o_orderpriority, o_orderkey, o_totalprice,
  CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS INTEGER) AS rank FROM orders""")
def dense_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return dense_rank_desc(rows, "o_totalprice", "rank", ["o_orderpriority"])


@query("w6_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return reduce.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("w7_sequence_completeness", f"""
WITH u AS (SELECT DISTINCT id, year, month, year * 12 + month AS i FROM ({PANEL}))
SELECT id, year, month FROM (SELECT *, count(*) OVER (PARTITION BY id ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM u)
WHERE n = 3""")
def sequence_completeness(spark, sf_dir):
    months = modelling.monthly_panel(panel(spark, sf_dir), ["obs"], min_year=0, order=["obs"])
    flags = modelling.eligibility(months, [1, 2], ["obs"], [], 3)
    return flags.where("sequence_ok").select("id", "year", "month")


@query("w8_cumulative_distribution", """
SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS cdf FROM events""")
def cumulative_distribution(spark, sf_dir):
    hist = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    return cumulative(hist, "value", ["n"], ["event_type"]).select(
        "event_type", "value", F.round(F.col("upto_n") / F.col("all_n"), 9).alias("cdf"))


# ---- sampling -------------------------------------------------------------------------------

_CANDIDATES = """SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS cls FROM orders"""


@query("m1_exact_ratio_sample", f"""
WITH c AS ({_CANDIDATES}), n AS (SELECT o_orderpriority, o_orderstatus, least(count(*) FILTER (WHERE cls = 1) // 1, count(*) FILTER (WHERE cls = 0) // 3) AS blocks
  FROM c GROUP BY 1, 2),
r AS (SELECT c.*, blocks, row_number() OVER (PARTITION BY c.o_orderpriority, c.o_orderstatus, cls ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) AS rn
  FROM c JOIN n USING (o_orderpriority, o_orderstatus))
SELECT o_orderkey, o_orderpriority, o_orderstatus, cls FROM r WHERE rn <= blocks * CASE WHEN cls = 1 THEN 1 ELSE 3 END""")
def exact_ratio_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_totalprice") > 400000, 1).otherwise(0).alias("__class"))
    return sampling.sample_exact_ratio(rows, ["o_orderpriority", "o_orderstatus"], "1:3", ["o_orderkey"], 42).withColumnRenamed(
        "__class", "cls")


@query("m2_drop_null_strata", f"SELECT id, obs, breed, lactation_phase FROM ({FEATURES}) WHERE breed IS NOT NULL AND lactation_phase IS NOT NULL")
def drop_null_strata(spark, sf_dir):
    return clean.drop_null_rows(features(spark, sf_dir), ["breed", "lactation_phase"]).select("id", "obs", "breed", "lactation_phase")
