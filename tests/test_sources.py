"""Readers, writers and staged tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from longspan.sources import files, stages


def write_years(spark, path):
    for year in (2001, 2003):
        spark.sql(
            f"select id as patient_num, date'{year}-05-01' as start_date,"
            f" concat('LOINC:', id % 2) as feature_id from range(4)"
        ).coalesce(1).write.option("header", True).csv(f"{path}/cooc_{year}.csv")


def test_missing_batches_are_skipped_and_rows_filtered(spark, tmp_path):
    write_years(spark, str(tmp_path))
    names = [f"{tmp_path}/cooc_{y}.csv" for y in range(2000, 2005)]
    df = files.read_batches(spark, names, files.EVENT_SCHEMA, F.col("feature_id") == "LOINC:1")
    got = files.with_file_year(df).groupBy("year").count().collect()
    assert {r.year: r["count"] for r in got} == {2001: 2, 2003: 2}


def test_yearly_pair_files(spark, tmp_path):
    for year in (2001, 2002):
        (tmp_path / f"pairs_{year}.csv").write_text(f"i,j,count\n1,2,{year - 1990}\n")
    names = [f"{tmp_path}/pairs_{y}.csv" for y in (2000, 2001, 2002)]
    got = sorted(map(tuple, files.read_yearly_pairs(spark, names).collect()))
    assert got == [(2001, 1, 2, 11.0), (2002, 1, 2, 12.0)]
    assert files.read_yearly_pairs(spark, names[:1]).isEmpty()


def test_no_batch_at_all_is_an_empty_table(spark, tmp_path):
    df = files.read_batches(spark, [f"{tmp_path}/none.csv"], files.EVENT_SCHEMA)
    assert df.count() == 0 and df.columns == ["patient_num", "start_date", "feature_id"]


def test_batch_names():
    assert files.batch_names("batch_{}-{}.csv", 1, 2001, 1000) == [
        "batch_1-1000.csv", "batch_1001-2000.csv", "batch_2001-3000.csv",
    ]


def test_tab_separated(spark, tmp_path):
    (tmp_path / "codes.dsv").write_text("feature_id\tgeneric_name\ttreatment_class\nR:1\tone\tC\n")
    row = files.read_csv(spark, str(tmp_path / "codes.dsv"), files.CODE_SCHEMA, sep="\t").first()
    assert tuple(row) == ("R:1", "one", "C")


def test_stage_keeps_schema_and_folder(spark):
    folder = stages.shared_folder(spark)
    df = stages.stage(spark.range(5).withColumn("x", F.lit("a")), "t", ["x"])
    assert df.columns == ["id", "x"] and df.count() == 5
    assert stages.shared_folder(spark) == folder


def session_stub(master, conf_dir, context_dir=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context_dir)
    conf = SimpleNamespace(get=lambda name, default: conf_dir or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_folder_comes_from_the_session():
    assert stages.shared_folder(session_stub("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert stages.shared_folder(session_stub("yarn", None, "/mnt/all")) == "/mnt/all"
    with pytest.raises(RuntimeError):
        stages.shared_folder(session_stub("yarn", None))


def test_csv_sink_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string")
    files.write_csv(table, str(tmp_path / "out"))
    got = files.read_csv(spark, str(tmp_path / "out"), "n int, t string")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a,b"), (2, None)]
    with pytest.raises(Exception):
        files.write_csv(table, str(tmp_path / "out"))
