"""Mergeable state kept per source file, so that one more month costs that month.

A state is a folder. Each file's rows are reduced to partial aggregates once, which are stored by period, and the
periods they lie in are merged anew from the partials of all files that reach into them. A manifest names the partials
and merged periods that are current. It is written last, under a new number: an update that fails or is killed
leaves the state as it was, and a reader sees the old or the new one, never a mixture.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panel_engine.sources.versioned import Manifest, current, in_partitions, scan

#: Which file a partial is of.
FILE = "_file"

Reduce = Callable[[DataFrame], DataFrame]


class PeriodState:
    """Partial aggregates per file and their merger per period.

    ``partial`` turns a file's rows into rows with the ``period`` columns and whatever ``merge`` needs; ``merge`` turns
    the partials of several files, told apart by ``_file``, into the period's rows. Both must keep periods apart.
    """

    def __init__(self, spark: SparkSession, root: str, period: Sequence[str], partial: Reduce, merge: Reduce):
        self.spark, self.root, self.period, self.partial, self.merge = spark, root.rstrip("/"), list(period), partial, merge
        self.versions = Manifest(spark, root)

    def manifest(self) -> dict:
        """An entry per file and per period."""
        return self.versions.load() or {"version": 0, "files": {}, "periods": [], "partial_schema": None, "merged_schema": None}

    def partials(self) -> DataFrame:
        """The partial rows of all current files, with ``_file``."""
        doc = self.manifest()
        if not doc["files"]:
            raise ValueError(f"no file in {self.root}")
        return scan(self.spark, sorted(doc["files"].values()), doc["partial_schema"])

    def merged(self) -> DataFrame:
        """The merged rows of all periods."""
        doc = self.manifest()
        if doc["merged_schema"] is None:
            raise ValueError(f"no file in {self.root}")
        return current(self.spark, self.period, doc["periods"], doc["merged_schema"])

    def _periods_of(self, paths: Sequence[str], schema: str) -> set[tuple]:
        """Periods that partials lie in: as many as there are, which a file has few of."""
        return {tuple(r) for r in scan(self.spark, paths, schema).select(*self.period).distinct().collect()} if paths else set()

    def update(self, files: Mapping[str, DataFrame] | None = None, withdrawn: Sequence[str] = ()) -> list[tuple]:
        """Add or replace ``files`` (name to rows), withdraw others; the periods that were merged anew.

        A withdrawn name that is not there is an error, as is one that is added at the same time.
        """
        files = dict(files or {})
        doc = self.manifest()
        if unknown := [f for f in withdrawn if f not in doc["files"] or f in files]:
            raise ValueError(f"not there to withdraw: {unknown}")
        before = [doc["files"][f] for f in [*files, *withdrawn] if f in doc["files"]]
        touched = self._periods_of(before, doc["partial_schema"])
        files_now = {f: p for f, p in doc["files"].items() if f not in withdrawn}
        for name, rows in files.items():
            path = f"{self.root}/partials/set={uuid.uuid4().hex}"
            part = self.partial(rows).withColumn(FILE, F.lit(name))
            part = part.select(*[c for c in part.columns if c not in self.period], *self.period)
            part.write.partitionBy(*self.period).parquet(path)
            doc["partial_schema"] = part.schema.json()
            files_now[name] = path
        touched |= self._periods_of([files_now[f] for f in files], doc["partial_schema"])
        periods = [(p, folder) for p, folder in doc["periods"] if tuple(p) not in touched]
        order = sorted(touched, key=lambda p: tuple((v is not None, v) for v in p))
        if order and files_now:
            folder = f"{self.root}/merged/set={uuid.uuid4().hex}"
            merged = self.merge(scan(self.spark, sorted(files_now.values()), doc["partial_schema"]).where(in_partitions(self.period, order)))
            merged = merged.select(*[c for c in merged.columns if c not in self.period], *self.period)
            merged.write.partitionBy(*self.period).parquet(folder)
            doc["merged_schema"] = merged.schema.json()
            periods += [(list(p), folder) for p in order]
        doc |= {"version": doc["version"] + 1, "files": files_now, "periods": periods}
        self.versions.commit(doc)
        return order
