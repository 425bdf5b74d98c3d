"""Tables whose writes are all or nothing, whole or by partition.

A write puts its files into a new folder and then, under the next number, a manifest that says which folder each
partition is read from. A write that fails or is killed has written no manifest and changes nothing; two writers
cannot take the same number; a reader follows one manifest and sees one version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Manifest:
    """Small numbered documents in a folder; the one with the highest number that was finished counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v*/_SUCCESS")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getParent().getName()[1:]) for s in system.globStatus(path) or [])

    def load(self, version: int | None = None) -> dict | None:
        found = self.versions()
        if version is not None and version not in found:
            raise ValueError(f"no version {version} in {self.root}")
        if not found:
            return None
        return json.loads(self.spark.read.schema("doc string").json(f"{self.root}/manifest/v{version or found[-1]}").first().doc)

    def commit(self, doc: dict) -> None:
        """Fails where another writer has taken the number."""
        one = self.spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1)
        one.write.json(f"{self.root}/manifest/v{doc['version']}")


def scan(spark: SparkSession, folders: Sequence[str], schema: str) -> DataFrame:
    """Folders ``set=<number>`` of one parent, as one scan."""
    known = StructType.fromJson(json.loads(schema))
    return spark.read.option("basePath", folders[0].rpartition("/")[0]).schema(known).parquet(*folders).select(*known.names)


def in_partitions(columns: Sequence[str], values: Sequence[Sequence]) -> Column:
    """Whether a row lies in one of the partitions; a null value is a partition of its own."""
    def at(one: Sequence) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, one)])

    return reduce(lambda a, b: a | b, map(at, values), F.lit(False))


def current(spark: SparkSession, columns: Sequence[str], placed: Sequence, schema: str) -> DataFrame:
    """The rows of partitions, ``placed`` being (values, folder) of each."""
    folders: dict[str, list] = {}
    for values, folder in placed:
        folders.setdefault(folder, []).append(values)
    parts = [scan(spark, [folder], schema).where(in_partitions(columns, values)) for folder, values in sorted(folders.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], StructType.fromJson(json.loads(schema)))


class VersionedTable:
    """A parquet table, partitioned by columns of few values that a document can hold (text, whole numbers)."""

    def __init__(self, spark: SparkSession, root: str, partition_by: Sequence[str]):
        if not partition_by:
            raise ValueError("a versioned table has a partition column at least")
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), list(partition_by)
        self.manifest = Manifest(spark, root)

    def write(self, df: DataFrame, only_partitions: bool = False) -> int:
        """Replace the table, or only the partitions that ``df`` has rows of; the number of the new version.

        Replacing by partition keeps the columns: another layout is an error. An empty frame empties the table, or
        replaces no partition.
        """
        doc = self.manifest.load() or {"version": 0, "partitions": [], "schema": None}
        df = df.select(*[c for c in df.columns if c not in self.partition_by], *self.partition_by)
        schema = df.schema.json()
        if only_partitions and doc["schema"] and [(f.name, f.dataType) for f in StructType.fromJson(json.loads(doc["schema"]))] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the columns differ from the table's")
        folder = f"{self.root}/data/set={uuid.uuid4().hex}"
        df.write.partitionBy(*self.partition_by).parquet(folder)
        # one row per partition
        new = [list(r) for r in scan(self.spark, [folder], schema).select(*self.partition_by).distinct().collect()]
        kept = [p for p in doc["partitions"] if p[0] not in new] if only_partitions else []
        doc = {"version": doc["version"] + 1, "partitions": kept + [(values, folder) for values in new], "schema": schema}
        self.manifest.commit(doc)
        return doc["version"]

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or an earlier one."""
        doc = self.manifest.load(version)
        if doc is None:
            raise ValueError(f"nothing written to {self.root}")
        return current(self.spark, self.partition_by, doc["partitions"], doc["schema"])
