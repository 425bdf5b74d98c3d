"""Scans: typed CSV, header-normalised CSV, multi-file union with lineage, parquet."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

SOURCE_FILE = "_source_file"


def read_typed_csv(
    spark: SparkSession, path: str, columns: Mapping[str, str], optional: Sequence[str] = (),
) -> DataFrame:
    """Project ``columns`` (name -> type) out of a CSV with header.

    A missing column raises, unless it is listed in ``optional``, then it is null. The scan
    is all-string with per-column casts: binding a type schema by position would silently
    shift columns when a file has more of them. Of several files, one whose header differs from the
    first one's fails the read; ``union_csv_files`` takes files of several layouts.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [c for c in columns if c not in raw.columns and c not in optional]
    if missing:
        raise ValueError(f"missing columns {missing} in {path}")
    return raw.select([
        (F.col(f"`{c}`").cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c)
        for c, t in columns.items()
    ])


def expand_years(years: Iterable[int | str]) -> list[int]:
    """Any set of years means every year from the smallest to the largest."""
    found = {int(y) for y in years}
    if not found:
        raise ValueError("at least one year is required")
    return list(range(min(found), max(found) + 1))


@dataclass(frozen=True)
class CsvFile:
    """A monthly file as the listing shows it."""

    path: str
    year: int
    size: int


def find_csv_files(spark: SparkSession, folder: str, code: str, years: Iterable[int | str]) -> list[CsvFile]:
    """Files named ``*<code>-<year>*.csv``, pruned before anything is opened, by path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, CsvFile] = {}
    for year in expand_years(years):
        path = hadoop.Path(f"{folder.rstrip('/')}/*{code}-{year}*.csv")
        system = path.getFileSystem(conf)
        for status in system.globStatus(path) or []:
            name = str(status.getPath())
            # an entry may be a folder of part files
            size = system.getContentSummary(status.getPath()).getLength() if status.isDirectory() else status.getLen()
            found.setdefault(name, CsvFile(name, year, size))
    return [found[name] for name in sorted(found)]


def list_csv_files(spark: SparkSession, folder: str, code: str, years: Iterable[int | str]) -> list[str]:
    return [f.path for f in find_csv_files(spark, folder, code, years)]


def header_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, str | None]:
    """The first line of each file, None where it has none. The file system is asked for it, no job is started."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def lines(path) -> Iterator[str | None]:
        system = path.getFileSystem(conf)
        if system.getFileStatus(path).isDirectory():
            parts = [s.getPath() for s in system.listStatus(path) if not re.match(r"[._]", s.getPath().getName())]
            for part in sorted(parts, key=str):
                yield from lines(part)
            return
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(path), "UTF-8"))
        try:
            yield reader.readLine()
        finally:
            reader.close()

    def first(name: str) -> str | None:
        return next((line for line in lines(jvm.org.apache.hadoop.fs.Path(name)) if line and line.strip()), None)

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(paths, pool.map(first, paths)))


READ, NO_HEADER, DAMAGED, MISSING_YEAR = "read", "no_header", "damaged", "missing_year"


def file_report(spark: SparkSession, folder: str, code: str, years: Iterable[int | str]) -> DataFrame:
    """What a union over these years has and lacks: ``file``, ``year``, ``status``, ``rows``, ``reason``.

    A row per file, and one, without a file, per year that has none. A file that cannot be read to its end is
    ``damaged``: its lines that can be read are counted with their bytes and held against its size, all files in one
    job. ``rows`` are the data lines met, the header not counted; quoted line breaks count as lines.
    """
    years = list(years)
    files = find_csv_files(spark, folder, code, years)
    headers = header_lines_or_reasons(spark, [f.path for f in files])
    listed = spark.createDataFrame(
        [(f.path, f.year, f.size, *headers[f.path]) for f in files], "file string, year int, size long, header boolean, unreadable string")
    if files:
        lines = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True).text([f.path for f in files])
        met = lines.groupBy(F.col("_metadata.file_path").alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.count_if(F.length(F.trim("value")) == 0).alias("blank"))
        # an entry that is a folder has its part files below it, each with a header of its own
        owner = spark.createDataFrame([(f.path,) for f in files], "file string")
        met = met.join(owner, F.col("part").startswith(F.col("file")) & F.substring("part", F.length("file") + 1, F.lit(1)).isin("", "/"))
        met = met.groupBy("file").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("blank").alias("blank"), F.count(F.lit(1)).alias("parts"))
        listed = listed.join(met, "file", "left")
    else:
        listed = listed.withColumns({c: F.lit(None).cast("long") for c in ("n", "bytes", "blank", "parts")})
    short = F.coalesce("bytes", F.lit(0)) < F.col("size")
    damaged = F.col("unreadable").isNotNull() | short
    status = F.when(damaged, DAMAGED).when(~F.col("header"), NO_HEADER).otherwise(READ)
    reason = (
        F.when(F.col("unreadable").isNotNull(), F.col("unreadable"))
        .when(short, F.concat(F.lit("read "), F.coalesce("bytes", F.lit(0)).cast("string"), F.lit(" of "), F.col("size").cast("string"), F.lit(" bytes")))
        .when(~F.col("header"), F.lit("no header line")))
    rows = F.when(F.col("header"), F.greatest(F.coalesce(F.col("n") - F.col("blank") - F.col("parts"), F.lit(0)), F.lit(0))).otherwise(0).cast("long")
    report = listed.select("file", "year", status.alias("status"), rows.alias("rows"), reason.alias("reason"))
    lacking = [(None, y, MISSING_YEAR, 0, "no file of this year") for y in expand_years(years) if y not in {f.year for f in files}]
    return report.unionByName(spark.createDataFrame(lacking, report.schema)) if lacking else report


def header_lines_or_reasons(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[bool, str | None]]:
    """Whether each file has a header line, and why it could not be asked."""
    def asked(path: str) -> tuple[bool, str | None]:
        try:
            return header_lines(spark, [path])[path] is not None, None
        except Py4JJavaError as error:
            return False, str(error.java_exception)

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(paths, pool.map(asked, paths)))


def union_csv_files(
    spark: SparkSession, folder: str, code: str, years: Iterable[int | str], damaged: str = "fail",
) -> DataFrame:
    """Union monthly CSVs as strings, by column name, with the path of each row's file.

    Only the first line of each monthly file is read to learn its layout; files that share a header
    line become one multi-file scan, so the plan grows with the number of layouts, not of files. A
    file without a header line is skipped, and a year without a file noticed, with a warning each. A file that is
    damaged or cannot be reached fails the read: its rows are not to go missing unseen. With
    ``damaged="set_aside"`` such files are left out instead; ``file_report`` names them, and costs one pass.
    """
    if damaged not in ("fail", "set_aside"):
        raise ValueError("damaged is fail or set_aside")
    years = list(years)
    files = find_csv_files(spark, folder, code, years)
    if not files:
        raise ValueError(f"no CSV file for code {code!r} in {folder}")
    for year in sorted(set(expand_years(years)) - {f.year for f in files}):
        log.warning("no file of %s for code %r in %s", year, code, folder)
    paths = [f.path for f in files]
    if damaged == "set_aside":
        # one small row per file
        bad = {r.file: r.reason for r in file_report(spark, folder, code, years).where(F.col("status") == DAMAGED).collect()}
        for path, reason in bad.items():
            log.warning("set aside %s: %s", path, reason)
        paths = [p for p in paths if p not in bad]
    layouts: dict[str | None, list[str]] = {}
    for path, line in header_lines(spark, paths).items():
        layouts.setdefault(line, []).append(path)
    for path in layouts.pop(None, []):
        log.warning("skipped %s: it has no header line", path)
    reader = spark.read.option("header", True)
    parts = [reader.csv(same).withColumn(SOURCE_FILE, F.col("_metadata.file_path")) for same in layouts.values()]
    if not parts:
        raise ValueError(f"no readable CSV file for code {code!r} in {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix."""
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    raise ValueError(f"unsupported format: {path}")


def normalize_name(name: str) -> str:
    """Lower case, with one underscore for whatever stands between letters and digits."""
    return "_".join(re.findall(r"[a-z0-9]+", name.lower()))


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*map(normalize_name, df.columns))


def select_aliased(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns ``wanted`` (output name -> names it may have, best first) under normalised headers.

    All names that cannot be found are reported together.
    """
    df = normalize_headers(df)
    place = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    found = {out: [c for c in names if c in place][:1] for out, names in wanted.items()}
    if lacking := [out for out, hit in found.items() if not hit]:
        raise ValueError(f"no column for {', '.join(lacking)}; available: {df.columns}")
    return df.select(*[F.col(hit[0]).alias(out) for out, hit in found.items()])
