from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from panel_engine.plans import selection
from panel_engine.sources import readers, writers
from panel_engine.sources.scratch import materialize, shared_dir
from panel_engine.sources.versioned import VersionedTable


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_typed_csv(spark, tmp_path, rows):
    path = write(tmp_path / "a.csv", "b,extra,Conducibilità elettrica,id\nx,1,2.5,7\ny,,,8\n")
    want = {"id": "bigint", "Conducibilità elettrica": "double"}
    assert rows(readers.read_typed_csv(spark, path, want)) == [(7, 2.5), (8, None)]
    with pytest.raises(ValueError, match="valoreMisura"):
        readers.read_typed_csv(spark, path, {**want, "valoreMisura": "double"})
    out = readers.read_typed_csv(spark, path, {**want, "valoreMisura": "double"}, ["valoreMisura"])
    assert rows(out) == [(7, 2.5, None), (8, None, None)] and out.dtypes[2][1] == "double"


def test_union_by_name_with_lineage(spark, tmp_path, rows):
    write(tmp_path / "AC-2019-01.csv", "id,v\n1,a\n2,b\n")
    write(tmp_path / "AC-2019-02.csv", "v,id\nc,3\n")
    write(tmp_path / "AC-2020-01.csv", "id\n4\n")
    write(tmp_path / "AC-2021-01.csv", "id,v\n5,e\n")
    write(tmp_path / "ZZ-2019-01.csv", "id,v\n9,z\n")
    out = readers.union_csv_files(spark, str(tmp_path), "AC", ["2020", 2019])
    assert rows(out, "id", "v") == [("1", "a"), ("2", "b"), ("3", "c"), ("4", None)]
    names = out.select("id", F.regexp_extract(readers.SOURCE_FILE, r"([^/]+)$", 1)).collect()
    assert dict(map(tuple, names)) == {"1": "AC-2019-01.csv", "2": "AC-2019-01.csv", "3": "AC-2019-02.csv", "4": "AC-2020-01.csv"}
    with pytest.raises(ValueError):
        readers.union_csv_files(spark, str(tmp_path), "NO", [2019])


def test_years():
    assert readers.expand_years([2024, "2019", 2021]) == [2019, 2020, 2021, 2022, 2023, 2024]
    assert readers.expand_years([2020]) == [2020]
    with pytest.raises(ValueError):
        readers.expand_years([])


def test_dispatch_and_aliases(spark, tmp_path):
    path = write(tmp_path / "r.csv", "Feature ,Perm-Mean, Interaction Partners\nf,0.5,\"a,b\"\n")
    assert readers.read_table(spark, path).count() == 1
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.json")
    df = spark.read.option("header", True).csv(path)
    from panel_engine.operators.consensus import PERM_ALIASES, SHAP_ALIASES

    assert readers.select_aliased(df, PERM_ALIASES).first().asDict() == {
        "feature": "f", "perm_score": "0.5", "interaction_partners": "a,b"}
    with pytest.raises(ValueError):
        readers.select_aliased(df, SHAP_ALIASES)


def test_documents_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, m string")
    doc = writers.document(df, {"step": "x", "rows": F.count(F.lit(1)), "lags": [1, 2], "none": []})
    path = writers.write_json(doc, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in (tmp_path / "doc").glob("*.json"))
    assert json.loads(text) == {"step": "x", "rows": 2, "lags": [1, 2], "none": []} and path
    writers.write_csv(df, str(tmp_path / "csv"), partition_by=["m"])
    assert {p.name for p in (tmp_path / "csv").iterdir() if p.is_dir()} == {"m=a", "m=b"}
    assert writers.distinct_ids(df).count() == 1


def test_scratch_uses_the_named_folder(spark):
    assert shared_dir(spark)
    stored = materialize(spark.range(10))
    assert stored.count() == 10 and shared_dir(spark) in stored.inputFiles()[0]


def report(path, header, lines):
    return write(path, "\n".join([header, *lines]) + "\n")


def test_consensus_from_csv(spark, tmp_path):
    perm = [report(tmp_path / f"p{i}.csv", "Feature,perm_norm,interaction_partners", lines) for i, lines in enumerate([
        ["milk,0.9,\"fat,scs\"", "fat,0.5,", "scs,bad,\"milk,fat\"", "milk,0.1,", "age,0.0,"],
        ["milk,0.7,", "fat,0.6,\"milk,scs\"", "ec,0.2,"]])]
    shap = [report(tmp_path / f"s{i}.csv", "feature,mean_abs,spearman_corr", lines) for i, lines in enumerate([
        ["milk,0.4,0.9", "fat,0.3,0.5", "scs,0.1,-0.8"], ["fat,0.9,0.2", "milk,0.8,0.1", "age,0.1,"]])]
    votes, matrix = selection.select_features_from_csv(
        spark, perm, shap, ["a", "b"], core_top_k=2, support_top_k=1, min_interactions=1)
    got = {(r.model, r.feature): r for r in matrix.collect()}
    milk = got["a", "milk"]
    assert (milk.rank_perm, milk.rank_shap, milk.model_label) == (1, 1, "core")  # the higher duplicate row counts
    assert got["a", "scs"].rank_perm == got["a", "age"].rank_perm == 3  # unparsable score is zero
    assert got["a", "age"].rank_shap == 4 and got["a", "age"].spearman_sign == "zero"  # worst rank plus one
    assert got["a", "fat"].spearman_sign == "zero" and got["a", "scs"].spearman_sign == "neg"
    assert got["a", "scs"].label_reason == "interaction_support"
    assert got["b", "ec"].model_label == "peripheral"
    table = {r.feature: (r.to_select, r.label, r.core_votes, r.supportive_votes, r.peripheral_votes) for r in votes.collect()}
    assert table["milk"] == ("yes", "core", 2, 0, 0) and table["fat"] == ("yes", "core", 2, 0, 0)
    assert table["scs"] == ("no", "peripheral", 0, 1, 1) and table["ec"] == ("no", "peripheral", 0, 0, 2)
    from panel_engine.operators.consensus import matrix_order, vote_order

    assert [r.feature for r in vote_order(votes).collect()][:2] == ["fat", "milk"]
    assert matrix_order(matrix).first().model == "a"
    with pytest.raises(ValueError):
        selection.select_features_from_csv(spark, perm, shap[:1])
    with pytest.raises(ValueError):
        selection.select_features_from_csv(spark, perm, shap, ["a", "b"], core_top_k=1, support_top_k=2)


def test_headers_in_another_order_fail_the_typed_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,10\n")
    (tmp_path / "b.csv").write_text("v,id\n30,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_typed_csv(spark, str(tmp_path), {"id": "int", "v": "int"}).collect()
    for name, month in (("a", "01"), ("b", "02")):
        (tmp_path / f"{name}-X-2020{month}.csv").write_text((tmp_path / f"{name}.csv").read_text())
        (tmp_path / f"m-X-2020-{month}.csv").write_text((tmp_path / f"{name}.csv").read_text())
    both = readers.union_csv_files(spark, str(tmp_path), "X", [2020])
    assert {(r.id, r.v) for r in both.collect()} == {("1", "10"), ("3", "30")}


def test_damaged_file_fails_the_union(spark, tmp_path):
    for month in ("01", "02"):
        lines = [("a,b",)] + [(f"{i},{i}",) for i in range(20_000)]
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{tmp_path}/out{month}")
        part = next((tmp_path / f"out{month}").glob("part-*.txt"))
        part.rename(tmp_path / f"m-X-2020-{month}.csv")
        (part.parent / f".{part.name}.crc").rename(tmp_path / f".m-X-2020-{month}.csv.crc")
    assert readers.union_csv_files(spark, str(tmp_path), "X", [2020]).count() == 40_000
    damaged = tmp_path / "m-X-2020-02.csv"
    data = bytearray(damaged.read_bytes())
    data[len(data) // 2] ^= 1
    damaged.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum"):
        readers.union_csv_files(spark, str(tmp_path), "X", [2020]).agg(F.sum("a")).collect()
    kept = readers.union_csv_files(spark, str(tmp_path), "X", [2020], damaged="set_aside")
    assert kept.count() == 20_000 and kept.select(readers.SOURCE_FILE).distinct().count() == 1
    report = {r.file.rsplit("/", 1)[1]: r for r in readers.file_report(spark, str(tmp_path), "X", [2020]).collect()}
    assert (report["m-X-2020-01.csv"].status, report["m-X-2020-01.csv"].rows) == ("read", 20_000)
    bad = report["m-X-2020-02.csv"]
    assert bad.status == "damaged" and bad.rows < 20_000 and "bytes" in bad.reason
    with pytest.raises(ValueError):
        readers.union_csv_files(spark, str(tmp_path), "X", [2020], damaged="ignore")


def test_file_report(spark, tmp_path, caplog):
    write(tmp_path / "AC-2019-01.csv", "id,v\n1,a\n2,b")  # no line break at the end
    write(tmp_path / "AC-2019-02.csv", "id,v\r\n3,c\r\n")
    write(tmp_path / "AC-2019-03.csv", "")
    write(tmp_path / "AC-2021-01.csv", "v,id\n")
    (tmp_path / "AC-2021-02.csv").mkdir()  # an entry of part files
    write(tmp_path / "AC-2021-02.csv" / "part-0.csv", "id,v\n4,d\n5,e\n")
    write(tmp_path / "AC-2021-02.csv" / "part-1.csv", "id,v\n6,f\n")
    write(tmp_path / "AC-2021-02.csv2", "id,v\n9,z\n")
    report = readers.file_report(spark, str(tmp_path), "AC", [2018, 2021])
    got = {(r.file and r.file.rsplit("/", 1)[1], r.year): (r.status, r.rows) for r in report.collect()}
    assert got == {
        ("AC-2019-01.csv", 2019): ("read", 2), ("AC-2019-02.csv", 2019): ("read", 1), ("AC-2019-03.csv", 2019): ("no_header", 0),
        ("AC-2021-01.csv", 2021): ("read", 0), ("AC-2021-02.csv", 2021): ("read", 3),
        (None, 2018): ("missing_year", 0), (None, 2020): ("missing_year", 0)}
    with caplog.at_level("WARNING"):
        assert readers.union_csv_files(spark, str(tmp_path), "AC", [2018, 2021]).count() == 6
    assert "no file of 2018" in caplog.text and "AC-2019-03.csv" in caplog.text
    none = readers.file_report(spark, str(tmp_path), "NO", [2019]).collect()
    assert [(r.file, r.year, r.status) for r in none] == [(None, 2019, "missing_year")]


def test_headers_are_read_without_a_job(spark, tmp_path):
    for month in range(1, 13):
        write(tmp_path / f"AC-2019-{month:02}.csv", "id,v\n1,a\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "")
    readers.union_csv_files(spark, str(tmp_path), "AC", [2019])
    jobs = len(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 1  # one per layout, for the names of its columns


def test_versioned_table(spark, tmp_path, rows):
    table = VersionedTable(spark, f"{tmp_path}/t", ["m", "n"])
    with pytest.raises(ValueError, match="nothing"):
        table.read()
    first = spark.createDataFrame([("a", 1, 1), ("a", None, 2), (None, 1, 3), ("b", 1, 4)], "m string, n int, v int")
    assert table.write(first) == 1
    assert rows(table.read(), "m", "n", "v") == rows(first)
    change = spark.createDataFrame([(None, 1, 30), ("c", 2, 5)], "m string, n int, v int")
    assert table.write(change, only_partitions=True) == 2
    second = [("a", 1, 1), ("a", None, 2), ("b", 1, 4), (None, 1, 30), ("c", 2, 5)]
    assert rows(table.read(), "m", "n", "v") == sorted(second, key=repr)

    # a task that fails after others have written
    def one_fails(v):
        return F.when(F.col("v") == v, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v"))

    bad = change.unionByName(first).repartition(4).withColumn("v", one_fails(4))
    for only in (True, False):
        with pytest.raises(Exception, match="lost"):
            table.write(bad, only_partitions=only)
    assert rows(table.read(), "m", "n", "v") == sorted(second, key=repr) and table.manifest.versions() == [1, 2]
    assert table.write(change, only_partitions=True) == 3  # repeated: the same table
    assert rows(table.read(), "m", "n", "v") == sorted(second, key=repr)
    assert rows(table.read(1), "m", "n", "v") == rows(first)
    with pytest.raises(Exception, match="(?i)exists"):
        table.manifest.commit({"version": 3})  # another writer was first
    with pytest.raises(ValueError, match="columns"):
        table.write(change.withColumn("w", F.lit(1)), only_partitions=True)
    table.write(first.where("false"))
    assert table.read().collect() == []
