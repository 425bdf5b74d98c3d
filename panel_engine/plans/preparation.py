"""From the merged panel to the labelled, imputed panel. Steps end in stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel_engine import config
from panel_engine.functions import scalars as S
from panel_engine.operators import clean, joins, quality, timeline
from panel_engine.operators.impute import GLOBAL, LEVEL_PREFIX, HierarchicalImputer, HierarchicalImputerModel, add_age_class
from panel_engine.sources.scratch import materialize, materialize_counted

DATES = ["birth_date", "cf_date", "calving_date", "t_date"]
TEMPORAL_ORDER = ["year", "month", "cf_date", "calving_date", "t_date"]


def coerce_dates(df: DataFrame, columns: Sequence[str] = tuple(DATES)) -> DataFrame:
    return df.withColumns({
        c: S.as_date(c, df.schema[c].dataType.simpleString()) for c in columns if c in df.columns})


def pre_process(df: DataFrame, min_age: int = 2, max_age: int = 7, store: bool = True) -> DataFrame:
    """Birth date per entity, plausible age, binary calving flag, one breed per entity."""
    clean.require_columns(df, ["id", "birth_date"])
    df = joins.fill_from_entity(coerce_dates(df), "id", "birth_date")
    df = df.where(F.col("birth_date").isNotNull())
    known = [c for c in ("cf_date", "calving_date", "t_date") if c in df.columns]
    reference = S.reference_date(known) if known else F.lit(None).cast("date")
    df = df.withColumn("age", S.age_years(reference, "birth_date")).where(F.col("age").between(min_age, max_age))
    df = clean.ensure_columns(df, {"calving": (0, "int"), "breed": (None, "string")})
    df = df.withColumn("calving", S.binary_flag("calving"))
    if store:
        df = materialize(df, "aged")
    out = joins.fill_from_entity(df, "id", "breed", [c for c in TEMPORAL_ORDER if c in df.columns])
    return materialize(out, "preprocessed") if store else out


def add_features(
    df: DataFrame, season_mode: str = "both", lactation_mode: str = "both",
    window_days: int = config.LABEL_WINDOW_DAYS, high_scs: float = config.HIGH_SCS, store: bool = True,
) -> DataFrame:
    """Health flag, season, lactation and the treatment-ahead label."""
    if season_mode not in {"cat", "cyclic", "both"}:
        raise ValueError(f"season_mode: {season_mode!r}")
    if lactation_mode not in {"phase", "months", "both"}:
        raise ValueError(f"lactation_mode: {lactation_mode!r}")
    clean.require_columns(df, ["id", "year", "month"])
    df = clean.ensure_columns(coerce_dates(df), {
        "breed": (None, "string"), "diagnosis": (None, "string"), "scs": (None, "double"), "calving": (0, "int"),
        "calving_date": (None, "date"), "cf_date": (None, "date"), "t_date": (None, "date")})
    df = df.where(F.col("breed").isNotNull()).withColumns({
        "scs": S.safe_double("scs"), "calving": S.binary_flag("calving")})

    df = timeline.entity_context(
        df, "id", ["year", "month", "cf_date"], last={"__last_calving": "calving_date"},
        ever={"__sick": F.col("diagnosis").isNotNull() | (F.col("scs") >= high_scs)})
    columns = {"healthy": 1 - F.col("__sick")}
    if season_mode in {"cat", "both"}:
        columns["season"] = S.season("month")
    if season_mode in {"cyclic", "both"}:
        columns["month_sin"] = F.sin(S.month_angle("month"))
        columns["month_cos"] = F.cos(S.month_angle("month"))
    recorded = S.safe_date("year", "month", F.lit(1)).isNotNull()
    columns["months_since_calving"] = F.when(recorded, S.months_since("year", "month", "__last_calving"))
    df = df.withColumns(columns).drop("__sick", "__last_calving")

    df = df.withColumn("lactation_phase", S.lactation_phase("months_since_calving"))
    df = df.where(F.col("months_since_calving").isNotNull())
    if store:  # the label reads it as checks, as events and as the rows to label
        df = materialize(df, "phased")
    df = timeline.event_within(df, df, "id", "cf_date", "t_date", 1, window_days - 1, "disease")
    df = df.where(F.col("cf_date").isNotNull() & (F.col("lactation_phase") != "peripartum"))
    dropped = {"cat": ["month_sin", "month_cos"], "cyclic": ["season"]}.get(season_mode, [])
    out = df.drop(*dropped, *(["lactation_phase"] if lactation_mode == "months" else []))
    return materialize(out, "features") if store else out


def impute(
    df: DataFrame, model: HierarchicalImputerModel | None = None, min_group_n: int = 5,
    global_fallback: bool = True, clip_imputed: bool = True, metadata: bool = False, store: bool = True,
) -> tuple[DataFrame, HierarchicalImputerModel]:
    """Fit on ``df`` and fill it, or fill it with a fitted model."""
    columns = [c for c in config.MEASURES if c in df.columns]
    if not columns:
        raise ValueError("no column to impute")
    if model is None:
        model = HierarchicalImputer(
            columns=columns, min_group_n=min_group_n, global_fallback=global_fallback,
            clip_imputed=clip_imputed).fit(df)
    out = model.transform(df, metadata)
    return (materialize(out, "imputed") if store else out), model


def impute_counted(
    df: DataFrame, model: HierarchicalImputerModel | None = None, **options: object,
) -> tuple[DataFrame, HierarchicalImputerModel, DataFrame]:
    """``impute``, and its level usage (feature, level, filled, clipped), counted while the result is stored."""
    out, model = impute(df, model, metadata=True, store=False, **options)
    cells = [(c, level) for c in model.measures for level in [*map(" -> ".join, model.levels), GLOBAL]]
    counters = {}
    for i, (c, level) in enumerate(cells):
        here = F.col(f"{LEVEL_PREFIX}{c}") == level
        counters |= {f"f{i}": F.count_if(here), f"c{i}": F.count_if(here & F.col(f"__clipped_{c}"))}
    stored, seen = materialize_counted(out, "imputed", counters)
    usage = df.sparkSession.createDataFrame(
        [(c, level, seen[f"f{i}"], seen[f"c{i}"]) for i, (c, level) in enumerate(cells) if seen[f"f{i}"]],
        "feature string, level string, filled long, clipped long")
    return stored.select(*[c for c in stored.columns if not c.startswith((LEVEL_PREFIX, "__clipped_"))]), model, usage


def imputation_report(
    pre: DataFrame, post: DataFrame, columns: Sequence[str] = tuple(config.MEASURES),
    strata: Sequence[str] = tuple(config.REPORT_STRATA), store: bool = True,
) -> dict[str, DataFrame]:
    """``features``: per stratum, level and feature; ``levels``: per stratum and level.

    Both sides feed several aggregations, so they are stored first.
    """
    pre, post = add_age_class(pre, replace="age" in pre.columns), add_age_class(post, replace="age" in post.columns)
    columns = [c for c in columns if c in pre.columns and c in post.columns]
    strata = [s for s in strata if s in pre.columns and s in post.columns]
    keep = [*columns, *strata]
    pre, post = pre.select(*keep), post.select(*keep)
    if store:
        pre, post = materialize(pre, "before"), materialize(post, "after")
    features, levels = quality.report(pre, post, columns, strata)
    return {"features": features, "levels": levels}
