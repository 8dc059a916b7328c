"""Changes of rates kept as state, and batches that replace what they wrote."""

import pytest

from meterline import settings as names
from meterline.operators.fx import fx_pair_filter
from meterline.sinks import materialize
from meterline.streaming import fx as streams
from meterline.streaming import rates
from tests.test_fx import rate, write_lines

COSTS = "tenant_name string, month int, est_cost_usd double"


@pytest.fixture
def costs(spark):
    return spark.createDataFrame([(f"T{i % 3}", i, i / 4) for i in range(40)], COSTS)


def ticks_of(spark, source):
    return streams.fx_file_stream(spark, str(source), max_files=1)


def given_out(spark, path):
    return sorted((r.as_of_ts.day, r.quote_ccy, r.fx_rate) for r in spark.read.parquet(str(path)).collect())


def test_late_and_repeated_ticks_are_ignored(spark, tmp_path):
    """Batches out of order, repeats, equal rates and restarts between all of them."""
    source, target, progress = tmp_path / "in", tmp_path / "out", str(tmp_path / "progress")

    def run(name, *lines):
        write_lines(source, name, *lines)
        changes = rates.changed_rates(ticks_of(spark, source))
        rates.replace_stream(changes, progress, path=str(target)).awaitTermination()
        return given_out(spark, target)

    first = run("1.json", rate(5, 1400.0), rate(3, 1300.0), rate(5, 0.9, "EUR"))
    assert first == [(5, "EUR", 0.9), (5, "KRW", 1400.0)]
    assert run("2.json", rate(4, 1350.0), rate(2, 0.8, "EUR")) == first  # late
    assert run("3.json", rate(5, 1400.0), rate(5, 1399.0)) == first  # repeated, and a lower one of the same time
    assert run("4.json", rate(6, 1400.0)) == first  # newer with the same rate
    assert run("5.json", {**rate(9, 1), "fx_rate": None}, {**rate(9, 1), "quote_ccy": None}) == first
    after = run("6.json", rate(7, 1500.0), rate(8, 1450.0), rate(6, 0.7, "EUR"))
    assert after == sorted([*first, (8, "KRW", 1450.0), (6, "EUR", 0.7)])
    assert run("7.json", rate(5, 1.0), rate(7, 1500.0)) == after
    # Back to a rate that was there before is a change too.
    assert run("8.json", rate(10, 1400.0)) == sorted([*after, (10, "KRW", 1400.0)])


def test_newest_of_a_frequent_pair_before_the_shuffle(spark):
    schema = "as_of_ts timestamp, base_ccy string, quote_ccy string, fx_rate double"
    many = spark.range(50_000).selectExpr(
        "timestamp_micros(id) AS as_of_ts", "'USD' AS base_ccy", "if(id % 3 = 0, 'EUR', 'KRW') AS quote_ccy", "id * 1.0D AS fx_rate"
    )
    kept = many.coalesce(1).mapInArrow(rates._newest, schema).collect()
    assert len(kept) <= 12 and {r.fx_rate for r in kept} >= {49998.0, 49999.0}


def test_batch_that_failed_after_its_write_leaves_one_copy(spark, tmp_path, costs, monkeypatch):
    source, target, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    write_lines(source, "1.json", rate(1, 1400.0))
    convert = rates.cost_per_tick
    start = lambda: rates.convert_on_change(lambda: costs, fx_pair_filter(ticks_of(spark, source)), progress, path=target)
    start().awaitTermination()
    assert spark.read.parquet(target).count() == 40

    write_lines(source, "2.json", rate(2, 1500.0))
    from pyspark.sql import DataFrameWriter

    real = DataFrameWriter.parquet

    def written_but_not_committed(self, path, *args, **more):
        real(self, path, *args, **more)
        raise RuntimeError("lost after the write")

    with monkeypatch.context() as broken:
        broken.setattr(DataFrameWriter, "parquet", written_but_not_committed)
        with pytest.raises(Exception, match="lost after the write"):
            start().awaitTermination()
    assert spark.read.parquet(target).count() == 80
    for _ in range(2):
        start().awaitTermination()
        stored = spark.read.parquet(target)
        assert stored.count() == 80
        assert {r.fx_rate: r["count"] for r in stored.groupBy("fx_rate").count().collect()} == {1400.0: 40, 1500.0: 40}
    assert convert is rates.cost_per_tick


def test_one_target_is_needed(spark, tmp_path):
    stream = streams.fx_file_stream(spark, str(tmp_path))
    for target in ({}, {"table": "t", "path": "p"}):
        with pytest.raises(ValueError):
            rates.replace_stream(stream, str(tmp_path / "c"), **target)


def test_from_files_to_costs_of_each_change(spark, tmp_path, costs):
    """Copies follow the changes of the rate, not the ticks; a refreshed cost table counts from then on."""
    schema = "fx_changes"
    spark.sql(f"CREATE DATABASE {schema}")
    spark.catalog.setCurrentDatabase(schema)
    try:
        materialize(costs, names.GOLD_TABLE)
        source, progress = tmp_path / "rates", str(tmp_path / "progress")
        write_lines(source, "1.json", *[rate(d, 1400.0) for d in range(1, 9)], rate(9, 0.9, "EUR"), "no rate")
        run = lambda: rates.run_fx_changes(spark, str(source), progress)
        assert run().count() == 40 and run().count() == 40
        write_lines(source, "2.json", rate(9, 1400.0))
        assert run().count() == 40
        spark.createDataFrame([("T9", 1, 8.0)], COSTS).write.insertInto(names.GOLD_TABLE)
        write_lines(source, "3.json", rate(10, 2.0), rate(4, 7.0))
        after = run()
        assert after.count() == 40 + 41
        assert [r.est_cost_krw for r in after.filter("tenant_name = 'T9'").collect()] == [16.0]
        newest = after.agg({rates.BATCH: "max"}).first()[0]
        assert after.filter(f"{rates.BATCH} = {newest}").select("fx_rate").distinct().collect()[0][0] == 2.0
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql(f"DROP DATABASE {schema} CASCADE")
