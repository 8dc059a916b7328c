"""Settings, tables, files, and the stored stages."""

import pytest

from meterline import settings as names
from meterline import sinks
from meterline.plans import medallion
from meterline.session import scratch_dir
from meterline.settings import Settings
from meterline.sources import files, tables


@pytest.fixture
def database(spark):
    spark.sql("CREATE DATABASE stores")
    spark.catalog.setCurrentDatabase("stores")
    yield "stores"
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE stores CASCADE")


def test_settings_defaults_environment_and_conf(spark):
    assert Settings.load(spark, env={}) == Settings()
    env = {"GOLD_TABLE": "g", "TOP_K": "7", "VS_COLUMNS": "a, b,", "UC_CATALOG": "c", "UC_SCHEMA": "s"}
    spark.conf.set(names.TENANT_LIST_KEY, " A ,,B")
    spark.conf.set(names.SOURCE_TABLE_KEY, "u")
    try:
        loaded = Settings.load(spark, env=env, price_table="p")
    finally:
        spark.conf.unset(names.TENANT_LIST_KEY)
        spark.conf.unset(names.SOURCE_TABLE_KEY)
    assert loaded == Settings("u", ("A", "B"), "p", "c", "s", "g", ("a", "b"), 7)
    assert loaded.qualified("g") == "`c`.`s`.`g`"
    with pytest.raises(TypeError):
        Settings.load(spark, env={}, nothing=1)


def test_materialize_refresh_and_guard(spark, database):
    df = spark.range(10).selectExpr("id", "id % 2 AS part")
    guard = {sinks.RESET_ALLOWED: "false"}
    sinks.materialize(df, "t", comment="it's a \\ test", properties=guard, partition_by=["part"], sort_by=["id"])
    assert spark.catalog.getTable("t").description == "it's a \\ test"
    assert sinks.table_properties(spark, "t")[sinks.RESET_ALLOWED] == "false"
    assert sinks.materialize(df.limit(3), "t", properties=guard).count() == 3
    with pytest.raises(sinks.ResetNotAllowed):
        sinks.materialize(df, "t", reset=True)
    assert spark.table("t").count() == 3
    sinks.materialize(df, "free")
    assert sinks.materialize(df.limit(1), "free", reset=True).count() == 1


def test_stored_stages_match_the_single_plan(spark, database, rows):
    from meterline.registry import inputs
    from tests.conftest import SF_DIR

    sinks.materialize(inputs.usage(spark, SF_DIR), "usage_records")
    sinks.materialize(inputs.price(spark, SF_DIR), names.PRICE_TABLE)
    settings = Settings(source_table="usage_records", tenants=inputs.TENANTS)
    stored = medallion.refresh(spark, settings)
    assert rows(stored) == rows(inputs.gold(spark, SF_DIR))
    assert rows(tables.load_billing_data(spark, Settings(schema=database))) == rows(stored)
    assert medallion.refresh(spark, settings).count() == stored.count()
    with pytest.raises(sinks.ResetNotAllowed):
        medallion.refresh(spark, settings, reset=True)


def test_period_filter_prunes_the_stored_months(spark, database):
    df = spark.range(24).selectExpr("2024 AS year", "cast(id % 12 + 1 AS int) AS month", "id AS cost")
    stored = sinks.materialize(df, "months", partition_by=["year", "month"])
    plan = stored.filter("year = 2024 AND month IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan.replace("PartitionFilters: [isNotNull(", "PartitionFilters: [isnotnull(")
    assert stored.filter("month = 3").inputFiles() and stored.filter("month = 3").count() == 2


def test_namespace_and_tables(spark, database):
    sinks.materialize(spark.range(8), "numbers")
    spark.catalog.setCurrentDatabase("default")
    tables.use_namespace(spark, catalog="spark_catalog", schema=database)
    assert tables.find_all_rows(spark, "numbers").count() > 5
    assert tables.query_df(spark, "SELECT max(id) AS top FROM numbers").first().top == 7


def test_views_batch_and_stream(spark, tmp_path):
    sinks.temp_view(spark.range(3), "three")
    assert spark.table("three").count() == 3
    spark.range(3).write.parquet(str(tmp_path / "in"))
    sinks.temp_view(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "three_stream")
    assert spark.readStream.table("three_stream").isStreaming


def test_fixture_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "y": "a"},\n {"x": 2, "y": null}]')
    (tmp_path / "b.CSV").write_text('x,y\n1,"two\nlines, ""quoted"""\n2,\n')
    json_rows = files.load_fixture(spark, str(tmp_path / "a.json"))
    assert sorted(tuple(r) for r in json_rows.select("x", "y").collect()) == [(1, "a"), (2, None)]
    csv_rows = files.load_fixture(spark, str(tmp_path / "b.CSV"))
    assert csv_rows.dtypes == [("x", "string"), ("y", "string")]
    assert sorted(tuple(r) for r in csv_rows.collect()) == [("1", 'two\nlines, "quoted"'), ("2", "")]
    with pytest.raises(ValueError):
        files.load_fixture(spark, "c.parquet")


class FakeSession:
    """Just enough of a session to ask it for its folders."""

    def __init__(self, conf=None, checkpoint=None, master="yarn"):
        self.conf = conf or {}
        self.sparkContext = self
        self.master = master
        self.getCheckpointDir = lambda: checkpoint


def test_scratch_folder_follows_the_checkpoint_setting(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    named = FakeSession({"spark.checkpoint.dir": "s3a://shared/check/"}, "hdfs:///other")
    assert scratch_dir(named, "x").startswith("s3a://shared/check/x-")
    assert scratch_dir(FakeSession(checkpoint="hdfs:///other"), "x").startswith("hdfs:///other/x-")
    assert scratch_dir(FakeSession(master="local[2]"), "x").startswith("/tmp/run-")
    with pytest.raises(RuntimeError):
        scratch_dir(FakeSession(), "x")


def _failing(df):
    from pyspark.sql import functions as F

    broken = F.when(F.col("id") == 5, F.raise_error(F.lit("broken row"))).otherwise(F.lit(1))
    return df.withColumn("x", broken.cast("int"))


@pytest.mark.parametrize("partition_by", [(), ("part",)])
def test_a_failed_refresh_keeps_the_stored_rows(spark, database, partition_by):
    df = spark.range(10).selectExpr("id", "cast(1 AS int) AS x", "id % 2 AS part")
    sinks.materialize(df, "t", "told", {sinks.RESET_ALLOWED: "false"}, partition_by)
    for _ in range(2):
        with pytest.raises(Exception, match="broken row"):
            sinks.materialize(_failing(df), "t", partition_by=partition_by)
        spark.catalog.refreshTable("t")
        assert spark.table("t").count() == 10


@pytest.mark.parametrize("partition_by", [(), ("part",)])
def test_a_refresh_without_properties_keeps_guard_and_comment(spark, database, partition_by):
    df = spark.range(10).selectExpr("id", "id % 3 AS part")
    sinks.materialize(df, "t", "told", {sinks.RESET_ALLOWED: "false"}, partition_by)
    fewer = sinks.materialize(df.filter("part < 2"), "t", partition_by=partition_by)
    assert sorted(r.part for r in fewer.select("part").distinct().collect()) == [0, 1]
    assert spark.catalog.getTable("t").description == "told"
    with pytest.raises(sinks.ResetNotAllowed):
        sinks.materialize(df, "t", reset=True, partition_by=partition_by)
    wider = sinks.materialize(df.withColumn("more", df.id), "t", partition_by=partition_by)
    assert wider.count() == 10 and "more" in wider.columns
    with pytest.raises(sinks.ResetNotAllowed):
        sinks.materialize(df, "t", reset=True, partition_by=partition_by)


def test_all_stored_names_are_in_the_schema_that_is_set(spark, database, tmp_path):
    from meterline.registry import inputs
    from meterline.streaming import fx
    from tests.conftest import SF_DIR

    spark.catalog.setCurrentDatabase("default")
    settings = Settings(f"{database}.usage_records", inputs.TENANTS, schema=database)
    sinks.materialize(inputs.usage(spark, SF_DIR), settings.source_table)
    sinks.materialize(inputs.price(spark, SF_DIR), settings.qualified(names.PRICE_TABLE))
    refreshed = medallion.refresh_reported(spark, settings)
    assert refreshed.report.count() == 8 and refreshed.report.filter("n_rows = 0").isEmpty()
    rates = tmp_path / "rates"
    rates.mkdir()
    line = '{"as_of_ts": "2024-01-01T00:00:00", "base_ccy": "USD", "quote_ccy": "KRW", "fx_rate": 1400.0}'
    (rates / "1.json").write_text(line)
    costs = fx.run_fx(spark, str(rates), str(tmp_path / "progress"), settings)
    assert costs.count() == refreshed.gold.count() == tables.load_billing_data(spark, settings).count()
    assert "as_of_date" in costs.columns
    stored = {t.name for t in spark.catalog.listTables(database)}
    assert {names.BRONZE_TABLE, names.SILVER_TABLE, names.GOLD_TABLE, names.FX_TABLE, names.FX_COST_TABLE} <= stored


def test_an_added_day_rewrites_its_month_only(spark, database, rows):
    from meterline.registry import inputs
    from tests.conftest import SF_DIR

    usage = inputs.usage(spark, SF_DIR)
    day = usage.filter("usage_date BETWEEN '1996-03-10' AND '1996-03-12'")
    settings = Settings("usage_records", inputs.TENANTS)
    sinks.materialize(inputs.price(spark, SF_DIR), names.PRICE_TABLE)
    sinks.materialize(usage.filter("usage_date NOT BETWEEN '1996-03-10' AND '1996-03-12'"), "usage_records")
    medallion.refresh(spark, settings)
    before = set(spark.table(names.GOLD_TABLE).inputFiles())
    day.select(*spark.table("usage_records").columns).write.insertInto("usage_records")
    gold = medallion.refresh_days(spark, "1996-03-10", "1996-03-12", settings)
    new = set(spark.table(names.GOLD_TABLE).inputFiles()) ^ before
    assert new and all("year=1996/month=3/" in file for file in new)
    assert rows(gold) == rows(inputs.gold(spark, SF_DIR))


def test_a_month_without_rows_is_dropped(spark, database, rows):
    from meterline.registry import inputs
    from tests.conftest import SF_DIR

    usage = inputs.usage(spark, SF_DIR)
    left = usage.filter("usage_date NOT BETWEEN '1996-03-01' AND '1996-03-31'")
    settings = Settings("usage_records", inputs.TENANTS)
    sinks.materialize(inputs.price(spark, SF_DIR), names.PRICE_TABLE)
    sinks.materialize(usage, "usage_records")
    medallion.refresh(spark, settings)
    sinks.materialize(left, "usage_records")
    found = rows(medallion.refresh_days(spark, "1996-03-10", "1996-04-02", settings))
    kept = {name: rows(spark.table(name)) for name in (names.BRONZE_TABLE, names.SILVER_TABLE)}
    assert spark.table(names.BRONZE_TABLE).filter("usage_month = '1996-03-01'").isEmpty()
    assert found == rows(medallion.refresh(spark, settings))
    assert kept == {name: rows(spark.table(name)) for name in kept}
