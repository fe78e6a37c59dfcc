from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features, profile
from shelfcast.sources import tables


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_round_trip(make_panel, spark, tmp_path, fmt):
    panel = make_panel(4)
    path = tables.write_table(panel, str(tmp_path / f"train.{fmt}"))
    again = tables.load_train(spark, path)
    assert again.schema == tables.SCHEMAS["train"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, panel.collect()))


def test_csv_columns_are_matched_by_header(spark, tmp_path):
    path = tmp_path / "oil.csv"
    path.write_text("date,dcoilwtico\n2015-01-01,\n2015-01-02,NaN\n2015-01-03,50.5\n")
    rows = tables.load_oil(spark, str(path)).orderBy("date").collect()
    assert [r.dcoilwtico for r in rows] == [None, None, 50.5]


def test_load_all(spark, tmp_path, make_panel):
    panel = make_panel(3)
    samples = {
        "train": panel, "test": panel.drop("sales"),
        "stores": spark.createDataFrame([(1, "c", "s", "A", 1)], tables.SCHEMAS["stores"]),
        "oil": spark.createDataFrame([(date(2015, 1, 1), 1.0)], tables.SCHEMAS["oil"]),
        "holidays": spark.createDataFrame([(date(2015, 1, 1), "a", "b", True)], tables.SCHEMAS["holidays"]),
        "transactions": spark.createDataFrame([(date(2015, 1, 1), 1, 5.0)], tables.SCHEMAS["transactions"]),
    }
    for name, df in samples.items():
        tables.write_table(df, str(tmp_path / f"{name}.csv"))
    loaded = tables.load_all(spark, str(tmp_path), register=True)
    assert list(loaded) == list(tables.RAW_TABLES)
    assert {n: d.count() for n, d in loaded.items()} == {n: d.count() for n, d in samples.items()}
    assert spark.sql("select count(*) from train").first()[0] == 12


def test_panel_prunes_months(make_panel, spark, tmp_path):
    panel = make_panel(90)
    path = tables.write_panel(panel, str(tmp_path / "panel"))
    part = tables.read_panel(spark, path, "2015-02-10", "2015-02-20")
    assert part.count() == 11 * 4
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "p_month" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(date)" in scan


def test_only_wanted_columns_are_read(make_panel, spark, tmp_path):
    path = tables.write_table(make_panel(3), str(tmp_path / "p.parquet"))
    df = tables.read_columns(spark, path, ["date", "sales", "nothing"])
    assert df.columns == ["date", "sales"]
    assert "ReadSchema: struct<date:date,sales:double>" in df._jdf.queryExecution().executedPlan().toString()


def test_outputs(make_panel, spark, tmp_path):
    paths = tables.write_outputs({"features": make_panel(3), "abc": make_panel(2)}, str(tmp_path))
    assert spark.read.parquet(paths["features"]).count() == 12
    with pytest.raises(ValueError):
        tables.write_outputs({"other": make_panel(1)}, str(tmp_path))
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.txt")


def test_summary_and_filter(make_panel):
    panel = make_panel(5)
    row = profile.summarise(panel.withColumn("sales", F.when(F.col("store_nbr") == 1, F.col("sales")))).first()
    assert (row.rows, row["columns"], row.nulls_sales) == (20, 5, 10)
    assert profile.column_types(panel)["sales"] == "double"
    assert profile.page_filter(panel, "2015-01-02", "2015-01-03", [1], ["DAIRY"]).count() == 2
    assert profile.page_filter(panel, stores=["All"]).count() == 20


def test_durable_reads_the_session_folder(spark, make_panel):
    from shelfcast.plans.durable import durable, shared_folder

    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder
    kept = durable(make_panel(3))
    assert folder.split(":")[-1] in kept.inputFiles()[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_table_needs_no_shuffle(make_panel, spark, tmp_path):
    panel, path = make_panel(60, promo=lambda i: int(i % 5 == 0)), str(tmp_path / "series")
    tables.write_series(panel, path, "series_of_test", buckets=3)
    spark.sql("drop table series_of_test")
    assert not spark.catalog.tableExists("series_of_test")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        tables.open_series(spark.newSession(), path, "series_of_test")
        again = spark.table("series_of_test")
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, panel.select(*again.columns).collect()))
        wide = features.add_promo_runs(features.add_rolling(again, windows=(7,)))
        assert "Exchange" not in plan_of(wide) and "Sort " not in plan_of(wide)
        assert "Exchange" not in plan_of(wide.withColumn("mean", features.series_mean(features.series_window(wide))))
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        other = tables.write_series(panel.select("date", "store_nbr", "family", F.col("sales").alias("other")), path + "2", "other_of_test", 3)
        joined = again.join(other.hint("merge"), ["store_nbr", "family", "date"])
        assert "Exchange" not in plan_of(joined) and joined.count() == panel.count()
        rolled = features.add_rolling(panel, windows=(7,))
        assert sorted(map(tuple, features.add_rolling(again, windows=(7,)).select(*rolled.columns).collect())) == sorted(map(tuple, rolled.collect()))
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.sql("drop table if exists series_of_test")
        spark.sql("drop table if exists other_of_test")
