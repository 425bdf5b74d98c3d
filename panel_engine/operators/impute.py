"""Hierarchical group-median imputation with separate fit and transform."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panel_engine import config
from panel_engine.functions.scalars import bin_right_closed, clip_where, safe_double
from panel_engine.operators.narrowing import level_groups, long_form

GLOBAL = "GLOBAL"
LEVEL_PREFIX = "__level_"


def add_age_class(df: DataFrame, replace: bool = True) -> DataFrame:
    """Age class from ``age``; null class when the frame has no age."""
    if not replace and ("age_class" in df.columns or "age" not in df.columns):
        return df
    if "age" not in df.columns:
        return df.withColumn("age_class", F.lit(None).cast("string"))
    return df.withColumn("age_class", bin_right_closed("age", config.AGE_EDGES, config.AGE_LABELS))


@dataclass
class HierarchicalImputer:
    """Learns group medians at every level; ``fit`` returns the model."""

    columns: list[str] = field(default_factory=lambda: list(config.MEASURES))
    entity_levels: list[list[str]] = field(default_factory=lambda: [list(x) for x in config.ENTITY_LEVELS])
    population_levels: list[list[str]] = field(default_factory=lambda: [list(x) for x in config.POPULATION_LEVELS])
    min_group_n: int = 5
    global_fallback: bool = True
    clip_imputed: bool = True
    ranges: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(config.PLAUSIBLE_RANGES))

    def levels(self, columns: Sequence[str]) -> list[list[str]]:
        """Key sets in fill order, cut to the present columns, duplicates and empties dropped."""
        found: list[list[str]] = []
        for group in (self.entity_levels, self.population_levels):
            seen: list[list[str]] = []
            for level in group:
                keys = [k for k in level if k in columns]
                if keys and keys not in seen:
                    seen.append(keys)
            found += [k for k in seen if k not in found]
        return found

    def fit(self, df: DataFrame) -> HierarchicalImputerModel:
        """The model; ``df`` is read several times: pass a stored table or a cheap scan."""
        work = add_age_class(df)
        levels = self.levels(work.columns)
        measures = [c for c in self.columns if c in work.columns]
        if not measures:
            raise ValueError("none of the columns to impute is present")
        return HierarchicalImputerModel(median_tables(work, measures, levels, self.min_group_n, self.global_fallback), self, levels, measures)

    def fit_transform(self, df: DataFrame, metadata: bool = False) -> DataFrame:
        return self.fit(df).transform(df, metadata)


def median_tables(
    df: DataFrame, measures: Sequence[str], levels: Sequence[Sequence[str]], min_n: int, with_global: bool,
) -> dict[int, DataFrame]:
    """The medians of all levels as ``level_groups`` stores them: 0..L-1 are the key sets, L is the whole table."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    cells = df.select(*keys, *[safe_double(c).alias(f"__m_{i}") for i, c in enumerate(measures)])
    wanted = [*levels, []] if with_global else list(levels)
    return level_groups(cells, [f"__m_{i}" for i in range(len(measures))], [0.5], wanted, null_keys=False, least=min_n)


def named_medians(tables: dict[int, DataFrame], measures: Sequence[str], levels: Sequence[Sequence[str]]) -> DataFrame:
    """(feature, level, level_keys, key_values, n, median) of all levels."""
    level, wanted = F.col("level"), [*levels, []]
    values = reduce(lambda so_far, i: so_far.when(level == i, _key_values(wanted[i])), range(1, len(wanted)), F.when(level == 0, _key_values(wanted[0])))
    return long_form(tables, levels).select(
        F.get(F.array(*map(F.lit, measures)), F.col("feature")).alias("feature"), "level",
        F.get(F.array(*[F.lit(" -> ".join(x)) for x in levels], F.lit(GLOBAL)), level).alias("level_keys"),
        values.alias("key_values"), "n", F.col("q_0").alias("median"))


def group_medians(
    df: DataFrame, measures: Sequence[str], levels: Sequence[Sequence[str]], min_n: int, with_global: bool,
) -> DataFrame:
    """(feature, level, level_keys, key_values, n, median) of all levels.

    Level 0..L-1 are the key sets; level L is the whole table. Groups with a null key or too
    little support are absent. ``df`` is read several times: pass a stored table or a cheap scan.
    """
    return named_medians(median_tables(df, measures, levels, min_n, with_global), measures, levels)


def _key_values(keys: Sequence[str]) -> Column:
    return F.array().cast("array<string>") if not keys else F.array(*[F.col(k).cast("string") for k in keys])


class HierarchicalImputerModel:
    """Fitted medians; the state is a table per key set that groups are stored under."""

    def __init__(self, tables: dict[int, DataFrame], params: HierarchicalImputer, levels: list[list[str]], measures: list[str]):
        self.tables = tables
        self.params = params
        self.levels = levels
        self.measures = measures

    @property
    def stats(self) -> DataFrame:
        """(feature, level, level_keys, key_values, n, median) of all levels."""
        return named_medians(self.tables, self.measures, self.levels)

    def transform(self, df: DataFrame, metadata: bool = False) -> DataFrame:
        """Fill missing cells, most specific level first; observed cells never change.

        Only rows with a missing cell meet the medians, by the keys their groups are stored under: one row holds
        a group's medians and those of the finer groups in it. Of what is found the lowest level wins, per cell. With
        ``metadata``, column ``__level_<c>`` names the level that filled the cell and ``__clipped_<c>`` flags a value moved into
        its plausible range.
        """
        measures = [c for c in self.measures if c in df.columns]
        columns = df.columns
        work = add_age_class(df.withColumns({c: safe_double(c) for c in measures}))
        lacking = F.lit(False)
        for c in measures:
            lacking = lacking | F.col(c).isNull()
        have = work.where(~lacking)
        lack = self._look_up(work.where(lacking), measures)

        names = F.array(*[F.lit(" -> ".join(x)) for x in self.levels], F.lit(GLOBAL))
        filled, tags = {}, {}
        for c in measures:
            missing, value, level = F.col(c).isNull(), F.col(f"__best_{c}.value"), F.col(f"__best_{c}.level")
            clipped = F.lit(False)
            filled[c] = F.coalesce(F.col(c), value)
            if self.params.clip_imputed and c in self.params.ranges:
                low, high = self.params.ranges[c]
                clipped = F.coalesce(missing & ~value.between(low, high), F.lit(False))
                filled[c] = clip_where(filled[c], missing & value.isNotNull(), low, high)
            tags[f"{LEVEL_PREFIX}{c}"] = F.when(missing, F.get(names, level))
            tags[f"__clipped_{c}"] = clipped
        extra = list(tags) if metadata else []
        if metadata:
            lack = lack.withColumns(tags)
        lack = lack.withColumns(filled).select(*columns, *extra)
        if metadata:
            have = have.withColumns({
                k: F.lit(None).cast("string") if k.startswith(LEVEL_PREFIX) else F.lit(False) for k in extra})
        out = have.select(*columns, *extra).unionByName(lack)
        return out.drop("age_class")  # a support column of the imputer, recreated on demand

    def _look_up(self, lack: DataFrame, measures: Sequence[str]) -> DataFrame:
        """Adds ``__best_<c>`` for each measure: the lowest level that has a median, and that median."""
        wanted = [*self.levels, []]
        usable = [i for i, level in enumerate(wanted) if all(k in lack.columns for k in level)]
        every = [k for k in dict.fromkeys(k for level in self.levels for k in level) if k in lack.columns]
        best = {c: F.lit(None).cast("struct<level: int, value: double>") for c in measures}
        lack = lack.withColumns({f"__best_{c}": b for c, b in best.items()})
        for i, table in self.tables.items():
            if i not in usable:
                continue
            kinds, theirs = dict(table.dtypes), dict(lack.dtypes)

            def same(a: Column, k: str) -> Column:
                """Keys of one type are compared as they are, others as text."""
                return a == F.col(k) if kinds.get(k, inner.get(k)) == theirs[k] else a.cast("string") == F.col(k).cast("string")

            inner = {f.name: f.dataType.simpleString() for f in table.schema["found"].dataType.elementType.fields}
            right = table.withColumnsRenamed({k: f"__r_{k}" for k in wanted[i]})
            if wanted[i]:
                lack = lack.join(right, reduce(lambda a, b: a & b, [same(F.col(f"__r_{k}"), k) for k in wanted[i]]), "left")
            else:
                lack = lack.join(F.broadcast(right), F.lit(True), "left")  # one row

            def hit(x: Column) -> Column:
                finer = [x[k].isNull() | F.coalesce(same(x[k], k), F.lit(False)) for k in every if k not in wanted[i]]
                return reduce(lambda a, b: a & b, finer, x["level"].isin(usable))

            def lowest(c: str) -> Column:
                at = self.measures.index(c)
                own = F.filter("__hits", lambda x: x["cells"][at].isNotNull())
                return F.array_min(F.transform(own, lambda x: F.struct(x["level"].alias("level"), x["cells"][at]["q_0"].alias("value"))))

            lack = lack.withColumn("__hits", F.filter("found", hit)).withColumns(
                {f"__best_{c}": F.least(f"__best_{c}", lowest(c)) for c in measures}).drop("__hits", "found", *[f"__r_{k}" for k in wanted[i]])
        return lack

    def save(self, path: str) -> str:
        for i, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/stats/{i}")
        spark = next(iter(self.tables.values())).sparkSession
        doc = {"params": asdict(self.params), "levels": self.levels, "measures": self.measures,
               "tables": {i: table.schema.json() for i, table in self.tables.items()}}
        spark.createDataFrame([(json.dumps(doc),)], "doc string").write.mode("overwrite").json(f"{path}/params")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HierarchicalImputerModel:
        doc = json.loads(spark.read.schema("doc string").json(f"{path}/params").first().doc)
        params = HierarchicalImputer(**doc["params"])
        params.ranges = {k: tuple(v) for k, v in params.ranges.items()}
        tables = {int(i): spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/stats/{i}") for i, schema in doc["tables"].items()}
        return cls(tables, params, doc["levels"], doc["measures"])


def level_usage(imputed: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Cells filled per (feature, level) and cells clipped, from ``transform`` metadata."""
    cells = imputed.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{LEVEL_PREFIX}{c}").alias("level"),
                 F.col(f"__clipped_{c}").alias("clipped")) for c in measures])).alias("u")).select("u.*")
    return cells.where(F.col("level").isNotNull()).groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("filled"), F.count_if("clipped").alias("clipped"))
