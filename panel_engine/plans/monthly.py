"""Construction steps month by month: the results of ``construction`` from state kept per source file.

Each step reduces a file to what later files cannot change, and finishes from the merged months. Adding, replacing
or withdrawing a file reads that file and the partial rows of the months it reaches into; the outcome equals the step
over all current files together, with rows in the order of their file names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.functions.scalars import map_codes
from panel_engine.operators import clean, joins, reduce
from panel_engine.plans import construction
from panel_engine.plans.construction import DAY_KEYS
from panel_engine.sources.readers import SOURCE_FILE
from panel_engine.sources.state import FILE, PeriodState

MONTH = ["anno", "mese"]
CONTROL_MEASURES = ["LinearScore", "LatteAlle24Ore", "ProteineAlle24Ore", "GrassoAlle24Ore"]


def _firsts(spark: SparkSession, root: str, measures: Sequence[str], prepare) -> PeriodState:
    """First non-null values per entity-day: of the first file that has one, the smallest."""
    return PeriodState(
        spark, root, MONTH, lambda rows: reduce.first_non_null(prepare(rows), DAY_KEYS, measures),
        lambda parts: reduce.first_non_null(parts, DAY_KEYS, measures, [FILE]))


class MonthlyControl:
    """``construction.control_records`` from monthly files."""

    def __init__(self, spark: SparkSession, root: str, year_after: int | None = 2018):
        self.days = _firsts(spark, f"{root}/days", CONTROL_MEASURES, lambda rows: clean.year_after(rows, "anno", year_after))
        self.votes = PeriodState(
            spark, f"{root}/votes", ["anno"], lambda rows: _votes(clean.year_after(rows, "anno", year_after)),
            lambda parts: parts.groupBy("idAnimale", "razza", "anno").agg(F.sum("votes").alias("votes")))

    def update(self, files: Mapping[str, DataFrame] | None = None, withdrawn: Sequence[str] = ()) -> list[tuple]:
        """The months that were merged anew. A killed update is repeated as it was called."""
        self.votes.update(files, [f for f in withdrawn if f in self.votes.manifest()["files"]])
        return self.days.update(files, [f for f in withdrawn if f in self.days.manifest()["files"]])

    def records(self, iqr_k: float = 1.5) -> DataFrame:
        votes = self.votes.merged().groupBy("idAnimale", "razza").agg(F.sum("votes").alias("votes"))
        breeds = votes.groupBy("idAnimale").agg(F.min_by("razza", F.struct(-F.col("votes"), F.col("razza"))).alias("razza"))
        return construction.finished_control(self.days.merged(), breeds, iqr_k)


def _votes(rows: DataFrame) -> DataFrame:
    """A file's votes; rows that repeat in it count once."""
    coded = rows.drop(SOURCE_FILE).dropDuplicates().withColumn("razza", map_codes("codiceRazzaAIA", config.BREED_BY_CODE))
    return coded.where(F.col("razza").isNotNull()).groupBy("idAnimale", "razza", "anno").agg(F.count(F.lit(1)).alias("votes"))


class MonthlyMeasure:
    """``construction.daily_measure`` from monthly files."""

    def __init__(self, spark: SparkSession, root: str, measure: str, name: str, year_after: int | None = 2018):
        self.measure, self.name = measure, name

        def prepare(rows: DataFrame) -> DataFrame:
            rows = clean.year_after(rows, "anno", year_after)
            return clean.keep_positive(clean.fill_from(rows, measure, config.FALLBACK_MEASURE), measure)

        self.days = _firsts(spark, root, [measure], prepare)
        self.update = self.days.update

    def records(self, ids: DataFrame, iqr_k: float = 1.5) -> DataFrame:
        return construction.finished_measure(joins.in_universe(self.days.merged(), ids, "idAnimale"), self.measure, self.name, iqr_k)


class MonthlyCalvings:
    """``construction.calving_events`` from monthly files; a row that repeats in its file counts once."""

    def __init__(self, spark: SparkSession, root: str, year_after: int | None = 2018):
        counters = config.BIRTH_COUNTERS

        def partial(rows: DataFrame) -> DataFrame:
            rows = clean.year_after(rows, "anno", year_after).drop(SOURCE_FILE).dropDuplicates()
            born = sum((F.coalesce(F.sum(c).cast("double"), F.lit(0.0)) for c in counters if c in rows.columns), F.lit(0.0))
            return rows.groupBy(*DAY_KEYS).agg(F.count(F.lit(1)).alias("rows"), born.alias("born"))

        self.days = PeriodState(spark, root, MONTH, partial, lambda parts: parts.groupBy(*DAY_KEYS).agg(
            F.sum("rows").alias("rows"), F.sum("born").alias("born")))
        self.update = self.days.update

    def records(self, ids: DataFrame) -> DataFrame:
        days = joins.in_universe(self.days.merged().where("born > 0"), ids, "idAnimale").drop("born")
        return construction.first_calvings(days.withColumnsRenamed({**config.CONTROL_NAMES, "rows": "same_day_records"}))
