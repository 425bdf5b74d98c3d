"""The composed steps a user calls, over frames derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.catalog.aggregates import _M, _REPORT_CTES, _STRATA, _post, imputed_sql
from panel_engine.catalog.base import query
from panel_engine.catalog.frames import DAYS, FEATURES, PANEL, PERM, SHAP, days, features, panel, rankings, table
from panel_engine.operators import clean, reduce, timeline
from panel_engine.operators.timeline import MONTH_IDX
from panel_engine.plans import construction, modelling, preparation, selection
from panel_engine.plans.monthly import MonthlyControl
from panel_engine.sources.scratch import materialize, new_path

# ---- flagship: daily panel to labelled anchors ----------------------------------------------


@query("entry_daily_anchors", f"""
WITH d AS ({DAYS}), first_value AS (
  SELECT user_id, day, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM d GROUP BY user_id, day),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM first_value),
k AS (SELECT user_id, day, value FROM first_value, q WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
l AS (SELECT *, lag(day, 1) OVER w AS d1, lag(day, 2) OVER w AS d2, lag(value, 1) OVER w AS "value_t-1", lag(value, 2) OVER w AS "value_t-2"
  FROM k WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, value, "value_t-1", "value_t-2", CASE WHEN EXISTS (SELECT 1 FROM d e WHERE e.user_id = l.user_id
  AND e.event_type = 'error' AND e.day - l.day > 0 AND e.day - l.day < 3) THEN 1 ELSE 0 END AS label
FROM l WHERE day - d1 = 1 AND day - d2 = 2""")
def entry_daily_anchors(spark, sf_dir):
    rows = days(spark, sf_dir)
    daily = materialize(reduce.first_non_null(rows, ["user_id", "day"], ["value"], ["event_id"]), "daily")
    kept = clean.iqr_filter(daily, "value").withColumn(MONTH_IDX, F.unix_date("day"))
    lagged = timeline.add_lags(kept, "user_id", ["value"], [1, 2])
    anchors = lagged.where(timeline.consecutive([1, 2])).select("user_id", "day", "value", "`value_t-1`", "`value_t-2`")
    errors = rows.where("event_type = 'error'").select("user_id", F.col("day").alias("error_day"))
    return timeline.event_within(anchors, errors, "user_id", "day", "error_day", 1, 2, "label")


# ---- construction ---------------------------------------------------------------------------

RAW_CONTROL = f"""
SELECT id AS "idAnimale", year AS anno, month AS mese, day AS giorno, '0' || CAST(obs % 5 AS VARCHAR) AS "codiceRazzaAIA",
  scs AS "LinearScore", milk AS "LatteAlle24Ore", protein * milk AS "ProteineAlle24Ore", fat AS "GrassoAlle24Ore" FROM ({PANEL})"""


def raw_control(spark, sf_dir):
    return panel(spark, sf_dir).select(
        F.col("id").alias("idAnimale"), F.col("year").alias("anno"), F.col("month").alias("mese"), F.col("day").alias("giorno"),
        F.concat(F.lit("0"), (F.col("obs") % 5).cast("string")).alias("codiceRazzaAIA"), F.col("scs").alias("LinearScore"),
        F.col("milk").alias("LatteAlle24Ore"), (F.col("protein") * F.col("milk")).alias("ProteineAlle24Ore"),
        F.col("fat").alias("GrassoAlle24Ore"))


def _iqr_steps(first: str, steps) -> tuple[str, str]:
    ctes, last = [], first
    for i, (c, pos) in enumerate(steps, 1):
        ctes.append(f"p{i} AS (SELECT * FROM {last}{f' WHERE {c} > 0' if pos else ''})")
        ctes.append(f"q{i} AS (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM p{i})")
        ctes.append(f"s{i} AS (SELECT p{i}.* FROM p{i}, q{i} WHERE {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))")
        last = f"s{i}"
    return ", ".join(ctes), last


_STEPS, _LAST = _iqr_steps("daily", [("milk", True), ("fat", True), ("protein", True), ("scs", False)])
CONTROL = f"""
WITH raw AS (SELECT DISTINCT * FROM ({RAW_CONTROL}) WHERE anno > 1996),
coded AS (SELECT *, CASE "codiceRazzaAIA" WHEN '00' THEN 'meticcia' WHEN '01' THEN 'bruna' WHEN '02' THEN 'frisona' WHEN '04' THEN 'pezzata' END AS b FROM raw),
vote AS (SELECT "idAnimale", b AS breed FROM (SELECT "idAnimale", b, row_number() OVER (PARTITION BY "idAnimale" ORDER BY count(*) DESC, b) AS rn
  FROM coded WHERE b IS NOT NULL GROUP BY "idAnimale", b) WHERE rn = 1),
daily AS (SELECT r."idAnimale" AS id, anno AS year, mese AS month, giorno AS day, min("LinearScore") AS scs, min("LatteAlle24Ore") AS milk,
  min("ProteineAlle24Ore") AS protein, min("GrassoAlle24Ore") AS fat, any_value(vote.breed) AS breed, make_date(anno, mese, giorno) AS cf_date
  FROM raw r JOIN vote USING ("idAnimale") GROUP BY r."idAnimale", anno, mese, giorno), {_STEPS}
SELECT id, year, month, day, scs, milk, protein, fat, breed, cf_date FROM {_LAST}"""


@query("c1_control_records", CONTROL)
def control_records(spark, sf_dir):
    return construction.control_records(raw_control(spark, sf_dir), year_after=1996)


@query("c1_control_ids", f"SELECT DISTINCT id FROM ({CONTROL})")
def control_ids(spark, sf_dir):
    return construction.control_ids(control_records(spark, sf_dir))


@query("c1_control_by_period", CONTROL)
def control_by_period(spark, sf_dir):
    """The same records from state kept per file: three files, one of them first wrong and then replaced, one withdrawn."""
    raw = raw_control(spark, sf_dir).where("anno > 1996")
    state = MonthlyControl(spark, new_path(spark, "state"), year_after=1996)
    early, late = raw.where("anno <= 1998"), raw.where("anno > 1998")
    state.update({"early": early.limit(100), "stray": late.limit(100)})
    state.update({"early": early, "late": late}, withdrawn=["stray"])
    return state.records()


_IDS = "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 2"


def _ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber > 2").select(F.col("l_partkey").alias("id")).distinct()


_MEASURE_STEPS, _MEASURE_LAST = _iqr_steps("daily", [("{n}", False)])
_MEASURE = f"""
WITH raw AS (SELECT DISTINCT id, year, month, day, coalesce({{c}}, {{f}}) AS v FROM ({PANEL}) WHERE year > 1996 AND id IN ({_IDS})),
daily AS (SELECT id, year, month, day, min(v) AS {{n}} FROM raw WHERE v > 0 GROUP BY id, year, month, day), {_MEASURE_STEPS}
SELECT id, year, month, day, {{n}} FROM {_MEASURE_LAST}"""


def _raw_measure(spark, sf_dir, column, name, fallback):
    p = panel(spark, sf_dir).select(
        F.col("id").alias("idAnimale"), F.col("year").alias("anno"), F.col("month").alias("mese"),
        F.col("day").alias("giorno"), F.col(column).alias(name), F.expr(fallback).alias("fallback"))
    return p.withColumnRenamed("fallback", config.FALLBACK_MEASURE) if fallback != "0" else p.drop("fallback")


@query("c2_lactose", _MEASURE.format(c="lactose", f="milk / 10.0", n="lactose"))
def lactose(spark, sf_dir):
    raw = _raw_measure(spark, sf_dir, "lactose", config.LACTOSE, "milk / 10.0")
    return construction.daily_measure(raw, _ids(spark, sf_dir), config.LACTOSE, "lactose", year_after=1996)


@query("c2_conductivity", _MEASURE.format(c="ec", f="NULL", n="ec"))
def conductivity(spark, sf_dir):
    raw = _raw_measure(spark, sf_dir, "ec", config.CONDUCTIVITY, "0")
    return construction.daily_measure(raw, _ids(spark, sf_dir), config.CONDUCTIVITY, "ec", year_after=1996)


_CALVED = f"SELECT DISTINCT id, year, month, day, calving AS births, obs % 3 - 1 AS dead FROM ({PANEL}) WHERE year > 1996 AND id IN ({_IDS})"
CALVING = f"""
SELECT id, day, month, year, same_day_records, make_date(year, month, day) AS calving_date, 1 AS calving FROM (
  SELECT *, row_number() OVER (PARTITION BY id, year, month ORDER BY day) AS rn FROM (
    SELECT id, day, month, year, CAST(count(*) AS BIGINT) AS same_day_records FROM ({_CALVED}) GROUP BY id, day, month, year
    HAVING coalesce(sum(births), 0) + coalesce(sum(dead), 0) > 0)) WHERE rn = 1"""


def _raw_calving(spark, sf_dir):
    return panel(spark, sf_dir).select(
        F.col("id").alias("idAnimale"), F.col("day").alias("giorno"), F.col("month").alias("mese"), F.col("year").alias("anno"),
        F.col("calving").cast("double").alias("NumeroFemmineNateVive"), (F.col("obs") % 3 - 1).cast("double").alias("NumeroMaschiNatiMorti"))


@query("c3_calving_events", CALVING)
def calving_events(spark, sf_dir):
    return construction.calving_events(_raw_calving(spark, sf_dir), _ids(spark, sf_dir), year_after=1996)


@query("c3_calving_report", f"""
WITH b AS (SELECT id, count(*) AS n FROM ({_CALVED}) GROUP BY id), a AS (SELECT id, count(*) AS n FROM ({CALVING}) GROUP BY id),
j AS (SELECT b.n AS nb, coalesce(a.n, 0) AS na FROM b LEFT JOIN a USING (id))
SELECT CAST((SELECT sum(n) FROM b) AS BIGINT) AS raw_rows, (SELECT median(n) FROM b) AS raw_median, CAST((SELECT max(n) FROM a) AS BIGINT) AS final_max,
  (SELECT median(n) FROM a) AS final_median, CAST(count(*) FILTER (WHERE nb <> na) AS BIGINT) AS changed,
  CAST(count(*) FILTER (WHERE na = 0) AS BIGINT) AS lost_entirely FROM j""")
def calving_report(spark, sf_dir):
    r = construction.calving_report(_raw_calving(spark, sf_dir), _ids(spark, sf_dir), year_after=1996)
    raw = r["raw"].select(F.col("rows").alias("raw_rows"), F.col("median").alias("raw_median"))
    final = r["final"].select(F.col("max").alias("final_max"), F.col("median").alias("final_median"))
    return raw.crossJoin(final).crossJoin(r["reconciliation"].select("changed", "lost_entirely"))


@query("c4_birth_registry", f"""
SELECT id, min(birth_date) AS birth_date FROM ({PANEL}) WHERE birth_date IS NOT NULL AND scs IS NOT NULL
  AND year(birth_date) BETWEEN 1994 AND 1996 AND id IN ({_IDS}) GROUP BY id""")
def birth_registry(spark, sf_dir):
    b = F.col("birth_date")
    text = F.when(F.col("scs").isNull(), "unknown").when(F.col("milk") > 25, F.date_format(b, "yyyy-MM-dd")).otherwise(
        F.date_format(b, "d/M/yyyy"))
    raw = panel(spark, sf_dir).select(F.col("id").alias("idAnimale"), text.alias("DataNascita"))
    return construction.birth_registry(raw, _ids(spark, sf_dir), years=(1994, 1996))


_TREATED = """
SELECT 'IT' || CAST(o_custkey AS VARCHAR) AS tag, o_orderpriority AS diagnosis,
  CASE WHEN o_totalprice < 40000 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS t_date FROM orders
WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P'"""
_TAGGED = "SELECT 'IT' || CAST(c_custkey AS VARCHAR) AS tag, c_custkey AS id FROM customer WHERE c_nationkey <> 3"
TREATMENTS = f"""
SELECT id, tag AS "Marca", diagnosis, t_date, CAST(year(t_date) AS INTEGER) AS year, CAST(month(t_date) AS INTEGER) AS month, CAST(day(t_date) AS INTEGER) AS day
FROM (SELECT *, row_number() OVER (PARTITION BY tag, year(t_date), month(t_date) ORDER BY t_date) AS rn FROM ({_TREATED})
  WHERE t_date IS NOT NULL AND year(t_date) > 1996) t JOIN ({_TAGGED}) USING (tag)
WHERE rn = 1 AND id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""


def _raw_treatments(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    text = (
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).when(F.col("o_totalprice") < 40000, "31/02/2020")
        .otherwise(F.date_format(day, "dd/MM/yyyy")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("IT"), F.col("o_custkey").cast("string")).alias("CAPO_IDENTIFICATIVO"),
        F.col("o_orderpriority").alias("TIPODIAGNOSI_CODICE"), text.alias("TRAT_DT_INIZIO"))


@query("c5_treatment_events", TREATMENTS)
def treatment_events(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    tags = customers.select(
        F.col("c_custkey").alias("idAnimale"),
        F.when(F.col("c_nationkey") != 3, F.concat(F.lit("IT"), F.col("c_custkey").cast("string"))).alias("Marca"))
    ids = customers.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return construction.treatment_events(_raw_treatments(spark, sf_dir), tags, ids, "2-HIGH", year_after=1996)


@query("c5_treatment_report", f"""
WITH t AS ({_TREATED}), k AS (SELECT tag, count(*) AS n, count(*) FILTER (WHERE year(t_date) > 1996) AS na,
  max(CASE WHEN t_date IS NULL THEN 1 ELSE 0 END) AS bad, max(CASE WHEN year(t_date) <= 1996 THEN 1 ELSE 0 END) AS old FROM t GROUP BY tag)
SELECT CAST((SELECT count(*) FROM t) AS BIGINT) AS rows, CAST((SELECT count(*) FROM t WHERE t_date IS NULL) AS BIGINT) AS bad_date_rows,
  CAST((SELECT count(*) FROM t WHERE year(t_date) <= 1996) AS BIGINT) AS old_year_rows,
  CAST(count(*) FILTER (WHERE n <> na) AS BIGINT) AS changed, CAST(count(*) FILTER (WHERE na = 0) AS BIGINT) AS lost_entirely,
  CAST(count(*) FILTER (WHERE n <> na AND bad = 1) AS BIGINT) AS by_bad_date, CAST(count(*) FILTER (WHERE n <> na AND old = 1) AS BIGINT) AS by_old_year FROM k""")
def treatment_report(spark, sf_dir):
    r = construction.treatment_report(_raw_treatments(spark, sf_dir), "2-HIGH", year_after=1996)
    rules = r["rules"].select("rows", "bad_date_rows", "old_year_rows")
    return rules.crossJoin(r["reconciliation"].select("changed", "lost_entirely", "by_bad_date", "by_old_year"))


_SOURCES = f"""
control AS (SELECT id, year, month, day, min(milk) AS milk, min(cf_date) AS cf_date FROM ({PANEL}) WHERE breed IS NOT NULL GROUP BY id, year, month, day),
lact AS (SELECT id, year, month, day, min(lactose) AS lactose FROM ({PANEL}) WHERE lactose IS NOT NULL GROUP BY id, year, month, day),
cond AS (SELECT id, year, month, day, min(ec) AS ec FROM ({PANEL}) WHERE ec IS NOT NULL GROUP BY id, year, month, day),
calv AS (SELECT id, year, month, min(calving_date) AS calving_date, 1 AS calving FROM ({PANEL}) WHERE calving_date IS NOT NULL GROUP BY id, year, month),
trea AS (SELECT id, CAST(year(t_date) AS INTEGER) AS year, CAST(month(t_date) AS INTEGER) AS month, min(t_date) AS t_date FROM ({PANEL})
  WHERE t_date IS NOT NULL GROUP BY 1, 2, 3),
regi AS (SELECT id, min(birth_date) AS birth_date FROM ({PANEL}) WHERE birth_date IS NOT NULL AND breed = 'bruna' AND milk > 20 GROUP BY id)"""


@query("c6_merged_panel", f"""
WITH {_SOURCES},
m1 AS (SELECT c.*, lact.lactose, cond.ec FROM control c LEFT JOIN lact USING (id, day, month, year) LEFT JOIN cond USING (id, day, month, year)),
m2 AS (SELECT coalesce(m1.id, calv.id) AS id, coalesce(m1.month, calv.month) AS month, coalesce(m1.year, calv.year) AS year, milk, cf_date, lactose, ec,
  calving_date, calving FROM m1 FULL OUTER JOIN calv ON m1.id = calv.id AND m1.month = calv.month AND m1.year = calv.year),
m3 AS (SELECT coalesce(m2.id, trea.id) AS id, coalesce(m2.month, trea.month) AS month, coalesce(m2.year, trea.year) AS year, milk, cf_date, lactose, ec,
  calving_date, calving, t_date FROM m2 FULL OUTER JOIN trea ON m2.id = trea.id AND m2.month = trea.month AND m2.year = trea.year)
SELECT DISTINCT m3.*, regi.birth_date FROM m3 JOIN regi USING (id)""")
def merged_panel(spark, sf_dir):
    p = panel(spark, sf_dir)
    day = ["id", "year", "month", "day"]
    control = p.where("breed is not null").groupBy(*day).agg(F.min("milk").alias("milk"), F.min("cf_date").alias("cf_date"))
    lact = p.where("lactose is not null").groupBy(*day).agg(F.min("lactose").alias("lactose"))
    cond = p.where("ec is not null").groupBy(*day).agg(F.min("ec").alias("ec"))
    calv = p.where("calving_date is not null").groupBy("id", "year", "month").agg(
        F.min("calving_date").alias("calving_date"), F.min("day").alias("day"), F.lit(1).alias("calving"))
    trea = p.where("t_date is not null").groupBy("id", F.year("t_date").alias("year"), F.month("t_date").alias("month")).agg(
        F.min("t_date").alias("t_date"), F.min("day").alias("day"))
    regi = p.where("birth_date is not null and breed = 'bruna' and milk > 20").groupBy("id").agg(F.min("birth_date").alias("birth_date"))
    return construction.merged_panel(control, lact, cond, calv, trea, regi)


# ---- preparation ----------------------------------------------------------------------------


@query("c7_pre_processing", f"""
WITH p AS ({PANEL}), b AS (SELECT id, min(birth_date) AS bd FROM p WHERE birth_date IS NOT NULL GROUP BY id),
a AS (SELECT p.*, coalesce(birth_date, bd) AS birth, CAST(floor((coalesce(cf_date, calving_date, t_date) - coalesce(birth_date, bd)) / 365.25) AS INTEGER) AS age
  FROM p JOIN b USING (id)), k AS (SELECT * FROM a WHERE age BETWEEN 2 AND 7),
f AS (SELECT id, arg_min(breed, (year, month, cf_date, calving_date IS NULL, calving_date, t_date IS NULL, t_date, breed)) AS fb FROM k WHERE breed IS NOT NULL GROUP BY id)
SELECT k.id, obs, cf_date, milk, birth AS birth_date, age, coalesce(calving, 0) AS calving, coalesce(breed, fb) AS breed FROM k LEFT JOIN f USING (id)""")
def pre_processing(spark, sf_dir):
    out = preparation.pre_process(panel(spark, sf_dir))
    return out.select("id", "obs", "cf_date", "milk", "birth_date", "age", "calving", "breed")


_DIT = f"""
WITH p AS (SELECT *, max(CASE WHEN diagnosis IS NOT NULL OR scs >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS sick,
  last_value(calving_date IGNORE NULLS) OVER (PARTITION BY id ORDER BY year, month, cf_date NULLS LAST, calving_date NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lc FROM ({PANEL}) WHERE breed IS NOT NULL),
s AS (SELECT *, (year * 12 + month) - (year(lc) * 12 + month(lc)) AS m FROM p),
k AS (SELECT * FROM s WHERE m >= 0),
l AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM k t WHERE t.id = k.id AND t.t_date - k.cf_date > 0 AND t.t_date - k.cf_date < 30) THEN 1 ELSE 0 END AS disease FROM k)
SELECT id, obs, cf_date, milk, 1 - sick AS healthy, {{season}}CAST(m AS INTEGER) AS months_since_calving, {{phase}}disease FROM l
WHERE cf_date IS NOT NULL AND m <> 0"""
_SEASON = """CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, """
_CYCLE = """round(sin((month - 1) * (2.0 * pi() / 12.0)), 9) + 0.0 AS month_sin, round(cos((month - 1) * (2.0 * pi() / 12.0)), 9) + 0.0 AS month_cos, """
_PHASE = """CASE WHEN m = 1 THEN 'early_lactation' WHEN m IN (2, 3) THEN 'peak' WHEN m IN (4, 5, 6) THEN 'mid_lactation' ELSE 'late_lactation' END AS lactation_phase, """


def _features_of(spark, sf_dir, season_mode, lactation_mode, extra):
    out = preparation.add_features(panel(spark, sf_dir), season_mode, lactation_mode)
    for c in ("month_sin", "month_cos"):
        if c in out.columns:
            out = out.withColumn(c, F.round(c, 9) + 0.0)
    return out.select("id", "obs", "cf_date", "milk", "healthy", "months_since_calving", "disease", *extra)


@query("c8_features_and_label", _DIT.format(season=_SEASON + _CYCLE, phase=_PHASE))
def features_and_label(spark, sf_dir):
    return _features_of(spark, sf_dir, "both", "both", ["season", "month_sin", "month_cos", "lactation_phase"])


@query("c8_features_cyclic_months", _DIT.format(season=_CYCLE, phase=""))
def features_cyclic_months(spark, sf_dir):
    return _features_of(spark, sf_dir, "cyclic", "months", ["month_sin", "month_cos"])


@query("c8_features_categorical", _DIT.format(season=_SEASON, phase=_PHASE))
def features_categorical(spark, sf_dir):
    return _features_of(spark, sf_dir, "cat", "phase", ["season", "lactation_phase"])


@query("c9_imputation", imputed_sql(10) + " SELECT id, obs, cf_date, " + ", ".join(f"round(f_{c}, 8) AS {c}" for c in _M) + " FROM filled")
def imputation(spark, sf_dir):
    stored = materialize(features(spark, sf_dir), "features")  # as the step before leaves it
    filled, _ = preparation.impute(stored, min_group_n=10)
    return filled.select("id", "obs", "cf_date", *[F.round(c, 8).alias(c) for c in _M])


@query("c10_imputation_report", _REPORT_CTES + """,
e AS (SELECT stratum, level, avg(delta) AS dc FROM d GROUP BY stratum, level), v AS (SELECT stratum, level, avg(nw) AS nw FROM nwd GROUP BY stratum, level),
n AS (SELECT stratum, level, count(*) AS n_rows FROM pg GROUP BY stratum, level)
SELECT stratum, level, CAST(n_rows AS BIGINT) AS n_rows, round(dc, 4) AS mean_abs_delta_corr, round(nw, 4) AS mean_nwd
FROM n LEFT JOIN e USING (stratum, level) LEFT JOIN v USING (stratum, level)""")
def imputation_report(spark, sf_dir):
    pre = features(spark, sf_dir)
    return preparation.imputation_report(pre, _post(pre), _M, _STRATA)["levels"]


# ---- anchors, samples, model-ready tables -----------------------------------------------------

# rows of one month in a fixed order: by obs, then every other column of the projection
_TIES = "obs, cf_date NULLS LAST, disease, healthy, age, season, lactation_phase NULLS LAST, months_since_calving"
_SUPPORT = ["obs", "cf_date", "healthy", "age", "season", "lactation_phase", "months_since_calving"]


def anchors_sql(lags, min_year: int = 1996) -> str:
    steps = ", ".join(
        f'lag(i, {k}) OVER w AS i_{k}, lag(disease, {k}) OVER w AS "disease_t-{k}"' for k in lags)
    valid = " AND ".join(f"i - i_{k} = {k}" for k in lags)
    history = ", ".join(f'"disease_t-{k}"' for k in lags)
    return f"""
WITH l AS (SELECT *, {steps} FROM (SELECT *, CAST(year * 12 + month AS INTEGER) AS i FROM ({FEATURES}) WHERE year >= {min_year})
  WINDOW w AS (PARTITION BY id ORDER BY i, {_TIES}))
SELECT id, year, month, i AS __month_idx, disease, {history}, {', '.join(_SUPPORT)} FROM l WHERE {valid}"""


def anchors(spark, sf_dir, lags=(1, 2)):
    return modelling.validated_anchors(
        features(spark, sf_dir).drop("age_class"), list(lags), support=_SUPPORT, min_year=1996, order=["obs", "cf_date"])


@query("c11_validated_anchors", anchors_sql([1, 2]))
def validated_anchors(spark, sf_dir):
    return anchors(spark, sf_dir)


@query("c11_validated_anchors_gap_lags", anchors_sql([2, 3]))
def validated_anchors_gap(spark, sf_dir):
    return anchors(spark, sf_dir, [2, 3])


@query("c11_anchor_meta", f"""
SELECT 'temporal_anchor_builder' AS step, '1,2' AS lag_steps, 1 AS target_available, CAST(count(*) AS BIGINT) AS validated_anchors
FROM ({anchors_sql([1, 2])})""")
def anchor_meta(spark, sf_dir):
    meta = modelling.anchor_meta(anchors(spark, sf_dir), [1, 2], "disease")
    return meta.withColumns({"lag_steps": F.array_join(F.col("lag_steps").cast("array<string>"), ","),
                             "target_available": F.col("target_available").cast("int")})


_POSITIVE = "disease = 1 AND healthy = 0"
_NEGATIVE = "disease = 0 AND healthy = 1"
_PAST = '"disease_t-1" = 0 AND "disease_t-2" = 0'
_CAND = f"""SELECT *, CASE WHEN {_POSITIVE} THEN 1 ELSE 0 END AS cls FROM ({anchors_sql([1, 2])})
  WHERE {_PAST} AND (({_POSITIVE}) OR ({_NEGATIVE})) AND season IS NOT NULL AND lactation_phase IS NOT NULL"""
SAMPLE = f"""
SELECT id, year, month, __month_idx, disease, "disease_t-1", "disease_t-2", {', '.join(_SUPPORT)} FROM (
  SELECT c.*, blocks, row_number() OVER (PARTITION BY season, lactation_phase, cls
    ORDER BY md5(id::VARCHAR || '|' || year::VARCHAR || '|' || month::VARCHAR || '|42'), id, year, month) AS rn
  FROM ({_CAND}) c JOIN (SELECT season, lactation_phase, least(count(*) FILTER (WHERE cls = 1), count(*) FILTER (WHERE cls = 0) // 2) AS blocks
    FROM ({_CAND}) GROUP BY season, lactation_phase) USING (season, lactation_phase))
WHERE rn <= blocks * CASE WHEN disease = 1 THEN 1 ELSE 2 END"""
_SAMPLE_STRATA = ["season", "lactation_phase"]


@query("c12_balanced_sample", SAMPLE)
def balanced_sample(spark, sf_dir):
    return modelling.balanced_sample(anchors(spark, sf_dir), "1:2", _SAMPLE_STRATA)


@query("c12_sampled_ids", f"SELECT DISTINCT id FROM ({SAMPLE})")
def sampled_ids(spark, sf_dir):
    return modelling.anchor_ids(balanced_sample(spark, sf_dir))


@query("c12_sampling_report", f"""
WITH c AS ({_CAND}), s AS (SELECT season, lactation_phase, count(*) FILTER (WHERE cls = 1) AS p, count(*) FILTER (WHERE cls = 0) AS q FROM c GROUP BY 1, 2), z AS ({SAMPLE})
SELECT CAST((SELECT count(*) FROM ({anchors_sql([1, 2])}) WHERE lactation_phase IS NOT NULL) AS BIGINT) AS input_rows,
  CAST((SELECT count(*) FROM c WHERE cls = 1) AS BIGINT) AS positive_candidates, CAST((SELECT count(*) FROM c WHERE cls = 0) AS BIGINT) AS negative_candidates,
  CAST((SELECT count(*) FROM z) AS BIGINT) AS sampled_rows, CAST((SELECT count(*) FROM z WHERE disease = 1) AS BIGINT) AS sampled_positives,
  CAST((SELECT count(*) FROM z WHERE disease = 0) AS BIGINT) AS sampled_negatives, CAST((SELECT count(DISTINCT id) FROM z) AS BIGINT) AS unique_ids,
  CAST(count(*) FILTER (WHERE p > 0) AS BIGINT) AS positive_strata, CAST(count(*) FILTER (WHERE q > 0) AS BIGINT) AS negative_strata,
  CAST(count(*) FILTER (WHERE p > 0 AND q > 0) AS BIGINT) AS overlap_strata, CAST(count(*) FILTER (WHERE p > 0 AND q = 0) AS BIGINT) AS dropped_positive_only_strata,
  CAST(count(*) FILTER (WHERE q > 0 AND p = 0) AS BIGINT) AS dropped_negative_only_strata,
  CAST(count(*) FILTER (WHERE p > 0 AND q > 0 AND least(p, q // 2) = 0) AS BIGINT) AS dropped_insufficient_overlap_strata FROM s""")
def sampling_report(spark, sf_dir):
    stored = anchors(spark, sf_dir)
    sample = modelling.balanced_sample(stored, "1:2", _SAMPLE_STRATA)
    return modelling.sampling_report(stored, sample, "1:2", _SAMPLE_STRATA)


_LAGGED, _KEPT = ["milk", "protein"], ["age", "months_since_calving"]
# one row per month (the first by obs), lags by row, completeness of all lagged columns
_MONTHS = f"""SELECT * FROM (SELECT *, CAST(year * 12 + month AS INTEGER) AS i, row_number() OVER (PARTITION BY id, year, month
  ORDER BY obs, cf_date NULLS LAST, scs NULLS LAST, milk NULLS LAST, protein NULLS LAST) AS rn FROM ({FEATURES}) WHERE year >= 1996) WHERE rn = 1"""
_WIDE = "SELECT *, " + ", ".join(
    f'lag({c}, {k}) OVER w AS "{c}_t-{k}"' for c in [*_LAGGED, "disease", "i"] for k in (1, 2)) + f" FROM ({_MONTHS}) WINDOW w AS (PARTITION BY id ORDER BY i)"
_LAG_OK = f"""SELECT id, year, month FROM ({_WIDE}) WHERE i - "i_t-1" = 1 AND i - "i_t-2" = 2 AND milk IS NOT NULL AND protein IS NOT NULL
  AND "milk_t-1" IS NOT NULL AND "milk_t-2" IS NOT NULL AND "protein_t-1" IS NOT NULL AND "protein_t-2" IS NOT NULL"""
_SEQ_OK = f"""SELECT id, year, month FROM (SELECT *, count(*) OVER (PARTITION BY id ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n
  FROM ({_MONTHS}) WHERE milk IS NOT NULL AND protein IS NOT NULL) WHERE n = 3"""
_SHARED = f"""SELECT id, year, month, disease, healthy, __month_idx, "disease_t-1", "disease_t-2", obs, cf_date, age, season, lactation_phase, months_since_calving
FROM ({anchors_sql([1, 2])}) JOIN ({_LAG_OK}) USING (id, year, month) JOIN ({_SEQ_OK}) USING (id, year, month)"""
_MONTH_ORDER = ["obs", "cf_date", "scs", "milk", "protein"]


def _shared(spark, sf_dir):
    stored = anchors(spark, sf_dir)
    out = modelling.shared_anchors(
        features(spark, sf_dir), stored, [1, 2], _LAGGED, _KEPT, support=_SUPPORT, min_year=1996, order=_MONTH_ORDER,
        fail_on_null=False)
    return stored, out


@query("c13_shared_anchors", _SHARED)
def shared_anchors(spark, sf_dir):
    return _shared(spark, sf_dir)[1]


@query("c13_shared_report", f"""
WITH a AS ({anchors_sql([1, 2])}), s AS ({_SHARED}), k AS (SELECT count(*) AS n FROM ({FEATURES}) WHERE year >= 1996 GROUP BY id, year, month)
SELECT CAST((SELECT count(*) FROM a) AS BIGINT) AS input_anchor_rows, CAST((SELECT count(*) FROM a JOIN ({_LAG_OK}) USING (id, year, month)) AS BIGINT) AS ml_eligible_rows,
  CAST((SELECT count(*) FROM a JOIN ({_SEQ_OK}) USING (id, year, month)) AS BIGINT) AS dl_eligible_rows, CAST((SELECT count(*) FROM s) AS BIGINT) AS shared_final_rows,
  CAST((SELECT count(DISTINCT id) FROM s) AS BIGINT) AS shared_unique_ids, CAST((SELECT count(*) FROM s WHERE disease = 1) AS BIGINT) AS positive_rows,
  CAST((SELECT count(*) FROM s WHERE disease = 0) AS BIGINT) AS negative_rows, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_rows_detected,
  CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_keys_detected, CAST(count(*) AS BIGINT) AS deduplicated_rows_kept FROM k""")
def shared_report(spark, sf_dir):
    stored, shared = _shared(spark, sf_dir)
    return modelling.shared_report(
        features(spark, sf_dir), stored, shared, [1, 2], _LAGGED, _KEPT, min_year=1996, order=_MONTH_ORDER)


@query("l1_lagged_wide", f"""
SELECT w.id, w.year, w.month, milk, protein, CAST(age AS DOUBLE) AS age, CAST(months_since_calving AS DOUBLE) AS months_since_calving,
  "milk_t-1", "milk_t-2", "protein_t-1", "protein_t-2", w.disease
FROM ({_WIDE}) w JOIN (SELECT DISTINCT id, year, month FROM ({anchors_sql([1, 2])})) USING (id, year, month)""")
def lagged_wide(spark, sf_dir):
    return modelling.lagged_wide(
        features(spark, sf_dir), anchors(spark, sf_dir), [1, 2], _LAGGED, _KEPT, min_year=1996, order=_MONTH_ORDER)


_DUMMIES = ", ".join(
    f"CAST(coalesce(m.{c} = '{v}', false) AS INTEGER) AS {c}_{v}" for c in ("season", "lactation_phase") for v in config.ENCODED_LEVELS[c])


@query("l1_lagged_wide_encoded", f"""
SELECT m.id, m.year, m.month, w.milk, w.protein, CAST(m.age AS DOUBLE) AS age, {_DUMMIES}, "milk_t-1", "milk_t-2", "protein_t-1", "protein_t-2", w.disease
FROM ({_WIDE}) w JOIN ({_MONTHS}) m USING (id, year, month) JOIN (SELECT DISTINCT id, year, month FROM ({anchors_sql([1, 2])})) USING (id, year, month)""")
def lagged_wide_encoded(spark, sf_dir):
    return modelling.lagged_wide(
        features(spark, sf_dir), anchors(spark, sf_dir), [1, 2], _LAGGED, ["age", "season", "lactation_phase"], min_year=1996,
        encoded=["season", "lactation_phase"], order=_MONTH_ORDER)


@query("l2_sequences", f"""
SELECT id, year, month, disease, CAST(list_sum(list_transform(steps, lambda s: s[1])) AS DOUBLE) AS milk_sum, steps[1][1] AS oldest_milk,
  round(steps[3][2], 8) AS newest_protein, CAST(len(steps) AS INTEGER) AS n_steps FROM (
  SELECT id, year, month, disease, list([milk, protein]) OVER (PARTITION BY id ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS steps
  FROM ({_MONTHS}) WHERE milk IS NOT NULL AND protein IS NOT NULL) JOIN (SELECT DISTINCT id, year, month FROM ({anchors_sql([1, 2])})) USING (id, year, month)
WHERE len(steps) = 3""")
def sequences(spark, sf_dir):
    out = modelling.sequence_table(
        features(spark, sf_dir), anchors(spark, sf_dir), ["milk", "protein"], 3, min_year=1996, order=_MONTH_ORDER)
    return out.select(
        "id", "year", "month", "disease",
        F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s[0]).alias("milk_sum"),
        F.col("steps")[0][0].alias("oldest_milk"), F.round(F.col("steps")[2][1], 8).alias("newest_protein"),
        F.size("steps").alias("n_steps"))


# ---- consensus ----------------------------------------------------------------------------------

MATRIX = f"""
WITH perm AS (SELECT model, feature, CAST(perm_score AS DOUBLE) AS s, interaction_partners AS ip FROM ({PERM})),
shap AS (SELECT model, feature, CAST(mean_abs_shap AS DOUBLE) AS s, CAST(spearman AS DOUBLE) AS sp FROM ({SHAP})),
rp AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY s DESC) AS r FROM perm),
rs AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY s DESC) AS r FROM shap),
pool AS (SELECT model, feature FROM (SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY r, feature) AS k FROM rp) WHERE k <= 3
  UNION SELECT model, feature FROM (SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY r, feature) AS k FROM rs) WHERE k <= 3),
pp AS (SELECT model, list(feature) AS pool FROM pool GROUP BY model),
ni AS (SELECT rp.model, rp.feature, rp.r, len(list_filter(list_slice(list_transform(string_split(ip, ','), lambda x: trim(x)), 1, 3),
  lambda x: list_contains(pp.pool, x))) AS n FROM rp JOIN pp USING (model)),
wp AS (SELECT model, max(r) + 1 AS w FROM rp GROUP BY model), ws AS (SELECT model, max(r) + 1 AS w FROM rs GROUP BY model),
v AS (SELECT coalesce(ni.feature, rs.feature) AS feature, coalesce(ni.model, rs.model) AS model, ni.r AS p, rs.r AS q, n,
  CASE WHEN sp IS NULL OR abs(sp) <= 0.5 THEN 'zero' WHEN sp > 0 THEN 'pos' ELSE 'neg' END AS sign, coalesce(abs(sp), 0) AS sa
  FROM ni FULL OUTER JOIN rs ON ni.model = rs.model AND ni.feature = rs.feature),
z AS (SELECT feature, v.model, coalesce(p, wp.w) AS p, coalesce(q, ws.w) AS q, sign, sa, coalesce(n, 0) AS n FROM v JOIN wp ON v.model = wp.model JOIN ws ON v.model = ws.model)
SELECT feature, model, CAST(p AS INTEGER) AS rank_perm, CAST(q AS INTEGER) AS rank_shap, sign AS spearman_sign, sa AS spearman_abs, CAST(n AS INTEGER) AS n_interactions_with_top,
  CASE WHEN p <= 10 AND q <= 10 THEN 'core' WHEN p <= 3 OR q <= 3 OR n >= 2 OR ((p <= 10 OR q <= 10) AND sign <> 'zero') THEN 'supportive' ELSE 'peripheral' END AS model_label,
  CASE WHEN p <= 10 AND q <= 10 THEN 'two_view_rank_agreement' WHEN p <= 3 OR q <= 3 THEN 'single_view_rank' WHEN n >= 2 THEN 'interaction_support'
    WHEN (p <= 10 OR q <= 10) AND sign <> 'zero' THEN 'monotonic_direction_support' ELSE 'weak_support' END AS label_reason FROM z"""


@query("c14_model_matrix", MATRIX)
def consensus_matrix(spark, sf_dir):
    perm, shap = rankings(spark, sf_dir)
    return selection.select_features(perm, shap, ["A", "N", "R"])[1]


@query("c14_feature_votes", f"""
SELECT feature, CASE WHEN c >= 2 OR c + s >= 2 THEN 'yes' ELSE 'no' END AS to_select, CASE WHEN c >= 2 THEN 'core' WHEN c + s >= 2 THEN 'support' ELSE 'peripheral' END AS label,
  CAST(c AS BIGINT) AS core_votes, CAST(s AS BIGINT) AS supportive_votes, CAST(3 - c - s AS BIGINT) AS peripheral_votes FROM (
  SELECT feature, count(*) FILTER (WHERE model_label = 'core') AS c, count(*) FILTER (WHERE model_label = 'supportive') AS s FROM ({MATRIX}) GROUP BY feature)""")
def feature_votes(spark, sf_dir):
    perm, shap = rankings(spark, sf_dir)
    return selection.select_features(perm, shap, ["A", "N", "R"])[0]
