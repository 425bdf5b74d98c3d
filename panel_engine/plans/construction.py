"""From raw periodic records to the merged panel.

Steps that feed several later plans end in a stored table (``store=True``): a plan built
lazily over a shared, expensive input would repeat that input once per reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.functions.scalars import map_codes, parse_date, safe_date
from panel_engine.operators import clean, joins, reduce
from panel_engine.sources.readers import SOURCE_FILE
from panel_engine.sources.scratch import materialize
from panel_engine.sources.writers import distinct_ids

DAY_KEYS = ["idAnimale", "anno", "mese", "giorno"]
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd")
YEAR_FIRST = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "d/M/yyyy")


def source_order(raw: DataFrame, order: Sequence[str]) -> Sequence[str]:
    """The order that "first" follows: as given, else by source file where the rows name theirs."""
    return order or ([SOURCE_FILE] if SOURCE_FILE in raw.columns else ())


def control_records(
    raw: DataFrame, year_after: int | None = 2018, order: Sequence[str] = (), iqr_k: float = 1.5,
) -> DataFrame:
    """Daily control panel: one breed per entity by vote, first value per day, outliers out.

    Repeated rows count once in the vote; they do not change a first value.
    """
    measures = ["LinearScore", "LatteAlle24Ore", "ProteineAlle24Ore", "GrassoAlle24Ore"]
    rows = clean.year_after(raw, "anno", year_after)
    once = rows.dropDuplicates().withColumn("razza", map_codes("codiceRazzaAIA", config.BREED_BY_CODE))
    breeds = reduce.majority(once, "idAnimale", "razza")
    daily = reduce.first_non_null(rows, DAY_KEYS, measures, source_order(raw, order))
    return finished_control(daily, breeds, iqr_k)


def finished_control(daily: DataFrame, breeds: DataFrame, iqr_k: float) -> DataFrame:
    """Control records from first values per day and a breed per entity."""
    daily = clean.keep_allowed(daily.join(breeds, "idAnimale"), "razza", config.BREEDS_KEPT)
    daily = daily.withColumn("DataControlloFunzionaleLatte", safe_date("anno", "mese", "giorno"))
    # each fence below is one look at the table: store it instead of repeating the aggregation
    daily = materialize(daily, "control")
    steps = [("LatteAlle24Ore", True), ("GrassoAlle24Ore", True), ("ProteineAlle24Ore", True), ("LinearScore", False)]
    return clean.quality_cascade(daily, steps, iqr_k).withColumnsRenamed(config.CONTROL_NAMES)


def control_ids(control: DataFrame) -> DataFrame:
    return distinct_ids(control, "id")


def daily_measure(
    raw: DataFrame, ids: DataFrame, measure: str, name: str, year_after: int | None = 2018,
    order: Sequence[str] = (), iqr_k: float = 1.5,
) -> DataFrame:
    """One positive value per entity-day, filled from the fallback column, outliers out."""
    rows = joins.in_universe(clean.year_after(raw, "anno", year_after), ids, "idAnimale")
    rows = clean.keep_positive(clean.fill_from(rows, measure, config.FALLBACK_MEASURE), measure)
    order = source_order(raw, order)
    # stored, so that no task holds the join's rows and the groups
    rows = materialize(rows.select(*dict.fromkeys([*DAY_KEYS, measure, *order])), "positive")
    return finished_measure(reduce.first_non_null(rows, DAY_KEYS, [measure], order), measure, name, iqr_k)


def finished_measure(daily: DataFrame, measure: str, name: str, iqr_k: float) -> DataFrame:
    """A daily measure from first values per day."""
    daily = materialize(daily, "measure")
    return clean.iqr_filter(daily, measure, iqr_k).withColumnsRenamed({**config.CONTROL_NAMES, measure: name})


def calving_rows(raw: DataFrame, ids: DataFrame, year_after: int | None = 2018) -> DataFrame:
    rows = clean.year_after(raw, "anno", year_after).dropDuplicates()
    return joins.in_universe(rows, ids, "idAnimale").withColumnsRenamed(config.CONTROL_NAMES)


def calving_events(raw: DataFrame, ids: DataFrame, year_after: int | None = 2018) -> DataFrame:
    """At most one calving per entity-month: births summed per day, empty events dropped."""
    days = calving_days(raw, ids, year_after)
    return first_calvings(days.where("births > 0").drop("births"))


def calving_days(raw: DataFrame, ids: DataFrame, year_after: int | None = 2018) -> DataFrame:
    """Rows and births per entity-day, days without births included; stored, so that no task holds all steps' groups."""
    rows = materialize(calving_rows(raw, ids, year_after), "calvings")
    return materialize(reduce.collapse_events(
        rows, ["id", "day", "month", "year"], config.BIRTH_COUNTERS, "same_day_records", total="births"), "days")


def first_calvings(days: DataFrame) -> DataFrame:
    """Calving events from days with births."""
    first = reduce.earliest_per_period(days, ["id", "year", "month"], ["day"])
    return first.withColumns({"calving_date": safe_date("year", "month", "day"), "calving": F.lit(1)})


def calving_report(raw: DataFrame, ids: DataFrame, year_after: int | None = 2018) -> dict[str, DataFrame]:
    days = calving_days(raw, ids, year_after)
    periods = days.groupBy("id", "year", "month").agg(
        F.sum("same_day_records").alias("rows"), F.max((F.col("births") > 0).cast("long")).alias("kept"))  # of each the first day is kept
    counts = materialize(periods.groupBy("id").agg(F.sum("rows").alias("n_before"), F.sum("kept").alias("n_after")), "counts")
    return {
        "same_day": days.agg(F.count_if(F.col("same_day_records") > 2).alias("days_with_more_than_two_rows")),
        "raw": reduce.distribution_of(counts.where("id is not null").select(F.col("n_before").alias("n"))),
        "final": reduce.distribution_of(counts.where("id is not null and n_after > 0").select(F.col("n_after").alias("n"))),
        "reconciliation": reduce.reconcile_counts(counts, "n_before", "n_after"),
    }


def birth_registry(
    raw: DataFrame, ids: DataFrame, formats: Sequence[str] = YEAR_FIRST, years: tuple[int, int] = (2018, 2022),
) -> DataFrame:
    """Earliest plausible birth date per entity."""
    rows = joins.in_universe(raw.select("idAnimale", "DataNascita"), ids, "idAnimale")
    rows = rows.withColumn("DataNascita", parse_date("DataNascita", formats))
    rows = rows.where(F.year("DataNascita").between(*years))
    return reduce.earliest(rows, "idAnimale", "DataNascita").withColumnsRenamed(
        {"idAnimale": "id", "DataNascita": "birth_date"})


def diagnosed_rows(raw: DataFrame, diagnosis: str, formats: Sequence[str] = DAY_FIRST) -> DataFrame:
    """Rows of one diagnosis with their parsed date; unparsable dates stay, as null."""
    rows = raw.where(F.col("TIPODIAGNOSI_CODICE") == diagnosis).where(F.col("TRAT_DT_INIZIO").isNotNull())
    return rows.withColumn("t_date", parse_date("TRAT_DT_INIZIO", formats)).withColumnsRenamed(
        {"CAPO_IDENTIFICATIVO": "Marca", "TIPODIAGNOSI_CODICE": "diagnosis"})


def treatment_events(
    raw: DataFrame, eartags: DataFrame, ids: DataFrame, diagnosis: str, keep_all_years: bool = False,
    formats: Sequence[str] = DAY_FIRST, year_after: int = 2019,
) -> DataFrame:
    """Earliest treatment per ear tag and month, mapped to entities of the universe."""
    rows = diagnosed_rows(raw, diagnosis, formats).where(F.col("t_date").isNotNull())
    rows = clean.year_after(rows.withColumn("year", F.year("t_date")), "year", None if keep_all_years else year_after)
    rows = rows.withColumns({"month": F.month("t_date"), "day": F.day("t_date")})
    first = reduce.earliest_per_period(rows, ["Marca", "year", "month"], ["t_date", "TRAT_DT_INIZIO"])
    tags = eartags.withColumnRenamed("idAnimale", "id").where(F.col("Marca").isNotNull())
    joined = joins.reduce_join([tags, first.drop("TRAT_DT_INIZIO")], ["Marca"], "inner")
    return joins.in_universe(joined, ids).select("id", "Marca", "diagnosis", "t_date", "year", "month", "day")


def treatment_report(
    raw: DataFrame, diagnosis: str, keep_all_years: bool = False, year_after: int = 2019,
) -> dict[str, DataFrame]:
    """Event counts per step and how many ear tags lost events, by cause."""
    rows = diagnosed_rows(raw, diagnosis)
    parsed = rows.where(F.col("t_date").isNotNull())
    bad = F.col("t_date").isNull()
    old = F.lit(False) if keep_all_years else F.year("t_date") <= year_after
    kept = parsed if keep_all_years else parsed.where(~old)
    return {
        "raw": reduce.count_distribution(rows, "Marca"),
        "parsed": reduce.count_distribution(parsed, "Marca"),
        "kept": reduce.count_distribution(kept, "Marca"),
        "rules": reduce.rule_counters(rows, "Marca", {"bad_date": bad, "old_year": old}),
        "reconciliation": reduce.reconcile(rows, kept, "Marca", {"bad_date": bad, "old_year": old}),
    }


def merged_panel(
    control: DataFrame, lactose: DataFrame, conductivity: DataFrame, calving: DataFrame,
    treatments: DataFrame, registry: DataFrame, drop_columns: Sequence[str] = tuple(config.MERGE_DROPPED_COLUMNS),
    fail_if_empty: bool = False, store: bool = True,
) -> DataFrame:
    """The canonical multi-source join."""
    day, month = ["id", "day", "month", "year"], ["id", "month", "year"]
    out = joins.merge_all(control, [
        joins.Join(lactose, day, "left", "lactose"),
        joins.Join(conductivity, day, "left", "conductivity"),
        joins.Join(calving, month, "outer", "calving"),
        joins.Join(treatments, month, "outer", "treatments"),
        joins.Join(registry, ["id"], "inner", "registry"),
    ], drop_columns, fail_if_empty=fail_if_empty, store=store)
    return materialize(out, "merged") if store else out
