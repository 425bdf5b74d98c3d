"""From the imputed panel to anchors, samples and model-ready tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel_engine import config
from panel_engine.functions import scalars as S
from panel_engine.operators import clean, joins, reduce, sampling, timeline
from panel_engine.operators.impute import add_age_class
from panel_engine.operators.timeline import MONTH_IDX, lag_name
from panel_engine.sources.scratch import materialize
from panel_engine.sources.writers import distinct_ids, document


def check_lags(lags: Sequence[int]) -> list[int]:
    lags = sorted(set(lags))
    if not lags or any(not isinstance(k, int) or k <= 0 for k in lags):
        raise ValueError("lags must be positive integers")
    return lags


def entity_id(df: DataFrame, entity: str) -> Column:
    """The entity's number. Whole numbers keep their type; text must be one, or the query fails."""
    kind, c = df.schema[entity].dataType, F.col(entity)
    if isinstance(kind, T.StringType):
        number = F.coalesce(c.try_cast("bigint"), c.try_cast("decimal(38,9)").try_cast("bigint"))
        return F.when(c.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit(f"{entity} is not a number: "), c)).cast("bigint")).otherwise(number)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return S.safe_double(entity).cast("long")
    return c


def _panel(df: DataFrame, min_year: int, target: str, entity: str | None = None) -> DataFrame:
    """Integer periods from ``min_year`` on, binary target and health flag."""
    df = df.withColumns({"year": S.safe_double("year").cast("int"), "month": S.safe_double("month").cast("int")})
    df = df.where(F.col("year").isNotNull() & F.col("month").isNotNull() & (F.col("year") >= min_year))
    if entity:
        df = df.withColumn(entity, entity_id(df, entity)).where(F.col(entity).isNotNull())
    return df.withColumns({c: S.binary_flag(c) for c in (target, "healthy") if c in df.columns})


# ---- anchors ------------------------------------------------------------------------

def validated_anchors(
    df: DataFrame, lags: Sequence[int] = tuple(config.LAG_STEPS), target: str = "disease", entity: str = "id",
    support: Sequence[str] = tuple(config.SUPPORT_COLUMNS), min_year: int = config.MIN_YEAR,
    keep_index: bool = True, order: Sequence[str] = (), duplicates: str = "strict", fail_if_empty: bool = False,
    store: bool = True,
) -> DataFrame:
    """Rows whose lagged months all exist, exactly k months back.

    ``duplicates="strict"`` counts rows, so a month with two rows breaks the months after it;
    ``"dedupe_first"`` keeps the first row per month beforehand.
    """
    lags = check_lags(lags)
    clean.require_columns(df, [entity, "year", "month"])
    df = timeline.with_month_index(_panel(add_age_class(df, replace=False), min_year, target))
    history = [target] if target in df.columns else []
    df = clean.ordered_projection(df, [entity, "year", "month", MONTH_IDX, *history, *support, *order])
    if duplicates == "strict":
        rows = timeline.row_history(df, entity, history, lags, order)
    elif duplicates == "dedupe_first":
        rows = timeline.add_lags(timeline.unique_periods(df, [entity, MONTH_IDX], order), entity, history, lags)
    else:
        raise ValueError(f"duplicates: {duplicates!r}")
    rows = rows.where(timeline.consecutive(lags))
    out = clean.ordered_projection(rows, [
        entity, "year", "month", *([MONTH_IDX] if keep_index else []), *history,
        *[lag_name(c, k) for k in lags for c in history], *support])
    if store:  # samples, shared sets and reports all read the anchors again
        out = materialize(out, "anchors")
    return clean.require_rows(out, "no validated anchors left") if fail_if_empty else out


def anchor_schema(anchors: DataFrame, lags: Sequence[int], target: str, support: Sequence[str], entity: str = "id") -> DataFrame:
    """One-row document naming the anchor columns by role."""
    history = [lag_name(target, k) for k in lags if lag_name(target, k) in anchors.columns]
    present = [c for c in support if c in anchors.columns]
    has_target = target in anchors.columns
    return document(anchors.limit(0), {
        "id_column": entity, "time_columns": ["year", "month"], "target_column": target if has_target else None,
        "month_index_column": MONTH_IDX, "target_history_columns": history, "support_columns": present,
        "anchor_columns": list(dict.fromkeys(
            [entity, "year", "month", MONTH_IDX, *([target] if has_target else []), *history, *present])),
    })


def anchor_meta(anchors: DataFrame, lags: Sequence[int], target: str) -> DataFrame:
    return document(anchors, {
        "step": "temporal_anchor_builder", "lag_steps": list(lags),
        "target_available": target in anchors.columns, "validated_anchors": F.count(F.lit(1))})


# ---- sampling -----------------------------------------------------------------------

def sample_candidates(
    anchors: DataFrame, target: str = "disease", healthy: str = "healthy",
    positive: Sequence[int] = (1, 0, 0), negative: Sequence[int] = (0, 0, 0),
    strata: Sequence[str] = tuple(config.SAMPLE_STRATA), entity: str = "id",
) -> DataFrame:
    """Anchors that match either pattern and have all strata, with ``__class``."""
    flags = [target, healthy, *[lag_name(target, k) for k in range(1, len(positive))]]
    clean.require_columns(anchors, [entity, "year", "month", *flags, *strata])
    df = clean.drop_null_rows(anchors.withColumns({c: S.binary_flag(F.col(f"`{c}`")) for c in flags}), strata)
    return sampling.candidate_classes(df, target, healthy, positive, negative)


def balanced_sample(
    anchors: DataFrame, ratio: tuple[int, int] | str = "1:1", strata: Sequence[str] = tuple(config.SAMPLE_STRATA),
    seed: int = 42, target: str = "disease", healthy: str = "healthy", positive: Sequence[int] = (1, 0, 0),
    negative: Sequence[int] = (0, 0, 0), entity: str = "id", fail_if_empty: bool = False, store: bool = True,
) -> DataFrame:
    """Exact positives:negatives inside every shared stratum."""
    rows = sample_candidates(anchors, target, healthy, positive, negative, strata, entity)
    if store:  # read for its counts, for its hash buckets and for its rows
        rows = materialize(rows, "candidates")
    out = sampling.sample_exact_ratio(rows, strata, ratio, [entity, "year", "month"], seed).drop("__class")
    return clean.require_rows(out, "no stratum holds both classes at this ratio") if fail_if_empty else out


def sampling_report(
    anchors: DataFrame, sampled: DataFrame, ratio: tuple[int, int] | str = "1:1",
    strata: Sequence[str] = tuple(config.SAMPLE_STRATA), target: str = "disease", entity: str = "id", **candidates,
) -> DataFrame:
    """One-row document: candidates, strata kept and dropped, sampled classes."""
    rows = sample_candidates(anchors, target=target, strata=strata, entity=entity, **candidates)
    eligible = clean.drop_null_rows(anchors, strata).agg(F.count(F.lit(1)).alias("input_rows"))
    classes = rows.agg(F.count_if(F.col("__class") == 1).alias("positive_candidates"),
                       F.count_if(F.col("__class") == 0).alias("negative_candidates"))
    drawn = reduce.class_summary(sampled, entity, target).withColumnsRenamed({
        "rows": "sampled_rows", "positives": "sampled_positives", "negatives": "sampled_negatives"})
    return eligible.crossJoin(classes).crossJoin(drawn).crossJoin(sampling.stratum_report(rows, strata, ratio))


# ---- one anchor set for lagged and sequence models ----------------------------------

def one_hot(
    df: DataFrame, features: Sequence[str], levels: Mapping[str, Sequence[str]] = config.ENCODED_LEVELS,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Dummy columns ``<col>_<level>`` of the declared ``levels``, originals kept, and which each feature got.

    A null or an undeclared value is all zeros. The columns follow from the declaration, not from
    the rows, so they are the same for every part of the data and nothing is collected. A feature without
    declared levels raises; ``level_pairs`` gives its long form.
    """
    present = [f for f in dict.fromkeys(features) if f in df.columns]
    if undeclared := [f for f in present if f not in levels]:
        raise ValueError(f"no levels declared for {undeclared}")
    dummies = {f: [f"{f}_{v}" for v in levels[f]] for f in present}
    columns = {name: F.coalesce((F.col(f).cast("string") == str(v)).cast("int"), F.lit(0)) for f in present for name, v in zip(dummies[f], levels[f])}
    return (df.withColumns(columns) if columns else df), dummies


def level_pairs(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form of one-hot columns: keys, ``feature``, ``level``, one row per value that is not null."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").where(F.col("level").isNotNull())


def wide_feature_columns(
    columns: Sequence[str], lags: Sequence[int], lag_variables: Sequence[str], keep_variables: Sequence[str],
    dummies: Mapping[str, Sequence[str]] | None = None,
) -> list[str]:
    """Present columns in model order: measures, kept variables (an encoded one as its dummies), lags by measure."""
    dummies = dummies or {}
    kept = [d for c in keep_variables for d in (sorted(dummies[c]) if c in dummies else [c])]
    lagged = [lag_name(b, k) for b in lag_variables for k in lags]
    present = set(columns)
    return [c for c in dict.fromkeys([*lag_variables, *kept, *lagged]) if c in present]


def monthly_panel(
    df: DataFrame, features: Sequence[str], target: str = "disease", entity: str = "id",
    min_year: int = config.MIN_YEAR, encoded: Sequence[str] = (), order: Sequence[str] = (),
) -> DataFrame:
    """Numeric features and target, one row per entity-month, month index."""
    clean.require_columns(df, [entity, "year", "month"], "panel")
    df = _panel(df.drop(*config.PANEL_META_COLUMNS), min_year, target, entity)
    df = clean.ordered_projection(df, [entity, "year", "month", *features, *encoded, target, *order])
    numeric = [c for c in dict.fromkeys(features) if c in df.columns and c not in encoded]
    df = df.withColumns({c: S.safe_double(c) for c in numeric})
    return timeline.with_month_index(timeline.unique_periods(df, [entity, "year", "month"], order))


def anchor_keys(anchors: DataFrame, entity: str = "id", min_year: int = config.MIN_YEAR) -> DataFrame:
    return _panel(anchors.select(entity, "year", "month"), min_year, "", entity).distinct()


def lagged_rows(
    panel: DataFrame, lags: Sequence[int], lag_variables: Sequence[str], target: str = "disease", entity: str = "id",
) -> DataFrame:
    present = [c for c in lag_variables if c in panel.columns]
    if not present:
        raise ValueError("no lag variable in the panel")
    history = [target] if target in panel.columns else []
    return timeline.add_lags(panel, entity, list(dict.fromkeys([*present, *history])), lags)


def eligibility(
    panel: DataFrame, lags: Sequence[int], lag_variables: Sequence[str], keep_variables: Sequence[str],
    length: int = config.SEQUENCE_LENGTH, target: str = "disease", entity: str = "id", encoded: Sequence[str] = (),
) -> DataFrame:
    """Per entity-month: ``lag_ok`` (complete, strictly consecutive lagged row) and
    ``sequence_ok`` (the last ``length`` months all exist with all features).

    Both come from one window over the monthly panel.
    """
    features = list(dict.fromkeys([*lag_variables, *keep_variables]))
    clean.require_columns(panel, features, "panel")
    wide, dummies = one_hot(panel, encoded)
    wide = lagged_rows(wide, lags, lag_variables, target, entity)
    columns = wide_feature_columns(wide.columns, lags, lag_variables, keep_variables, dummies)
    history = [target, *[lag_name(target, k) for k in lags]]
    lag_ok = F.lit(False)
    if all(h in wide.columns for h in history):
        lag_ok = timeline.consecutive(lags) & clean.complete([*columns, *history])
    usable = reduce_and([S.safe_double(c).isNotNull() for c in features])
    return wide.select(
        entity, "year", "month", lag_ok.alias("lag_ok"),
        (timeline.periods_with(usable, entity, length) == length).alias("sequence_ok"))


def reduce_and(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def check_complete(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Raise when a sequence feature is null anywhere in the panel."""
    if not panel.where(~reduce_and([S.safe_double(c).isNotNull() for c in features])).isEmpty():
        raise ValueError("null features in the panel: impute before building sequences")
    return panel


def shared_anchors(
    panel: DataFrame, anchors: DataFrame, lags: Sequence[int] = tuple(config.LAG_STEPS),
    lag_variables: Sequence[str] = tuple(config.LAG_VARIABLES), keep_variables: Sequence[str] = tuple(config.KEEP_VARIABLES),
    support: Sequence[str] = tuple(config.SUPPORT_COLUMNS), target: str = "disease", entity: str = "id",
    length: int = config.SEQUENCE_LENGTH, min_year: int = config.MIN_YEAR, encoded: Sequence[str] = (),
    order: Sequence[str] = (), fail_on_null: bool = True, validate: bool = True, fail_if_empty: bool = False,
) -> DataFrame:
    """Anchors usable both as a lagged wide row and as a sequence, with their own columns."""
    lags = check_lags(lags)
    if length < 1:
        raise ValueError("length must be at least 1")
    keys = [entity, "year", "month"]
    features = list(dict.fromkeys([*lag_variables, *keep_variables]))
    months = monthly_panel(panel, features, target, entity, min_year, encoded, order)
    candidates = anchor_keys(anchors, entity, min_year)
    if fail_on_null:
        check_complete(months, features)
    both = eligibility(months, lags, lag_variables, keep_variables, length, target, entity, encoded)
    final = joins.intersect_keys(candidates, [both.where("lag_ok and sequence_ok")], keys)
    rows = anchors.withColumns({"year": S.safe_double("year").cast("int"), "month": S.safe_double("month").cast("int"),
                                entity: entity_id(anchors, entity)})
    if validate:  # the other side is distinct already
        joins.assert_unique(rows, keys, "anchors")
    out = joins.attach_one_to_one(final, rows, keys, validate=False)
    out = clean.ordered_projection(out, [
        *keys, target, "healthy", MONTH_IDX, *[lag_name(target, k) for k in lags], *support])
    return clean.require_rows(out, "no anchor fits both forms") if fail_if_empty else out


def shared_report(
    panel: DataFrame, anchors: DataFrame, shared: DataFrame, lags: Sequence[int], lag_variables: Sequence[str],
    keep_variables: Sequence[str], target: str = "disease", entity: str = "id", length: int = config.SEQUENCE_LENGTH,
    min_year: int = config.MIN_YEAR, order: Sequence[str] = (),
) -> DataFrame:
    """One-row document: eligibility per form, duplicates, classes of the final set."""
    keys = [entity, "year", "month"]
    features = list(dict.fromkeys([*lag_variables, *keep_variables]))
    months = monthly_panel(panel, features, target, entity, min_year, order=order)
    wanted = anchor_keys(anchors, entity, min_year)

    flags = eligibility(months, lags, lag_variables, keep_variables, length, target, entity)
    eligible = wanted.join(flags, keys, "left").agg(
        F.count(F.lit(1)).alias("input_anchor_rows"), F.count_if("lag_ok").alias("ml_eligible_rows"),
        F.count_if("sequence_ok").alias("dl_eligible_rows"))
    duplicates = reduce.duplicate_report(_panel(panel, min_year, target, entity), keys)
    final = reduce.class_summary(shared, entity, target).withColumnsRenamed({
        "rows": "shared_final_rows", "positives": "positive_rows", "negatives": "negative_rows",
        "unique_ids": "shared_unique_ids"})
    return eligible.crossJoin(final).crossJoin(duplicates)  # one row each


# ---- model-ready tables -------------------------------------------------------------

def lagged_wide(
    panel: DataFrame, anchors: DataFrame, lags: Sequence[int] = tuple(config.LAG_STEPS),
    lag_variables: Sequence[str] = tuple(config.LAG_VARIABLES), keep_variables: Sequence[str] = tuple(config.KEEP_VARIABLES),
    target: str = "disease", entity: str = "id", min_year: int = config.MIN_YEAR, encoded: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """One row per anchor: keys, base, kept and lagged columns, target."""
    lags = check_lags(lags)
    keys = [entity, "year", "month"]
    months = monthly_panel(panel, [*lag_variables, *keep_variables], target, entity, min_year, encoded, order)
    months, dummies = one_hot(months, encoded)
    wide = lagged_rows(months, lags, lag_variables, target, entity)
    features = wide_feature_columns(wide.columns, lags, lag_variables, keep_variables, dummies)
    wide = clean.ordered_projection(wide, [*keys, *features, target])
    return joins.attach_one_to_one(anchor_keys(anchors, entity, min_year), wide, keys, validate=False)


def sequence_table(
    panel: DataFrame, anchors: DataFrame, features: Sequence[str], length: int = config.SEQUENCE_LENGTH,
    target: str = "disease", entity: str = "id", min_year: int = config.MIN_YEAR, order: Sequence[str] = (),
) -> DataFrame:
    """One row per complete anchor: keys, ``steps`` (oldest first) and target."""
    keys = [entity, "year", "month"]
    months = monthly_panel(panel, features, target, entity, min_year, order=order)
    months = months.where(clean.complete(features))
    steps = timeline.sequences(months, entity, features, length).where(F.col("__n_steps") == length)
    return anchor_keys(anchors, entity, min_year).join(steps.select(*keys, "steps", target), keys)


def anchor_ids(anchors: DataFrame, entity: str = "id") -> DataFrame:
    return distinct_ids(anchors, entity)
