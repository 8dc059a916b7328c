"""Conversion of costs at rates, in batch and as a stream of files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from meterline import settings as names
from meterline.operators.fx import convert_cost, cost_at_latest, cost_per_tick, fx_pair_filter
from meterline.sinks import materialize
from meterline.streaming import fx as streams

COSTS = "tenant_name string, month int, est_cost_usd double"
TICKS = "as_of_ts string, base_ccy string, quote_ccy string, fx_rate double"


@pytest.fixture
def costs(spark):
    return spark.createDataFrame([(f"T{i % 3}", i, i / 4) for i in range(40)], COSTS)


@pytest.fixture
def ticks(spark):
    return spark.createDataFrame(
        [(f"2024-01-{i + 1:02d} 00:00:00", "USD", "KRW", 1400.0 + i) for i in range(12)], TICKS
    )


@pytest.mark.parametrize("slices", [(None, 1), (1, 7), (6, 1), (5, 3)])
def test_grid_gives_every_pair_once(costs, ticks, rows, slices):
    want = convert_cost(costs.crossJoin(ticks))
    have = cost_per_tick(costs, ticks, *slices)
    assert have.columns == want.columns
    assert rows(have) == rows(want)


def test_copies_are_kept(spark, ticks):
    same = spark.createDataFrame([("T", 1, 2.0)] * 30, COSTS)
    assert cost_per_tick(same, ticks.union(ticks)).count() == 30 * 24


def test_whole_monthly_table_at_few_ticks(spark, ticks, rows):
    from meterline.registry import inputs
    from tests.conftest import SF_DIR

    gold = inputs.gold(spark, SF_DIR)
    converted = cost_per_tick(gold, ticks)
    have = converted.groupBy("as_of_ts").agg(F.count(F.lit(1)), F.sum("est_cost_usd"), F.max("est_cost_krw"))
    plain = convert_cost(gold.crossJoin(ticks))
    want = plain.groupBy("as_of_ts").agg(F.count(F.lit(1)), F.sum("est_cost_usd"), F.max("est_cost_krw"))
    assert rows(have) == rows(want)


def test_default_spreads_the_costs(spark, costs, ticks):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        many = cost_per_tick(costs.union(costs).union(costs), ticks)
        busy = many.groupBy(F.spark_partition_id()).count().collect()
        assert len(busy) > 3 and max(r["count"] for r in busy) < many.count() * 0.6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_latest_rate_for_every_cost_row(spark, costs, ticks, rows):
    late = spark.createDataFrame(
        [("2024-02-01", "USD", "KRW", 2.0), ("2024-02-01", "USD", "KRW", 3.0), ("2024-03-01", "USD", "KRW", None)], TICKS
    )
    have = cost_at_latest(costs, ticks.union(late))
    assert have.columns == [*costs.columns, *ticks.columns, "est_cost_krw"]
    assert rows(have) == rows(convert_cost(costs.crossJoin(late.filter("fx_rate = 3"))))
    plan = have._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    none = cost_at_latest(costs, ticks.limit(0)).collect()
    assert len(none) == 40 and all(r.est_cost_krw is None for r in none)


def test_pair_filter(spark):
    df = spark.createDataFrame([("t", "USD", "KRW", 1.0), ("t", "USD", "EUR", 1.0), ("t", None, "KRW", 1.0)], TICKS)
    assert fx_pair_filter(df).count() == 1
    assert fx_pair_filter(df, quote="EUR").count() == 1


def write_lines(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    text = "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines)
    (folder / name).write_text(text + "\n")


def rate(day, value, quote="KRW"):
    return {"as_of_ts": f"2024-01-{day:02d}T09:00:00", "base_ccy": "USD", "quote_ccy": quote, "fx_rate": value}


def test_bad_lines_integers_and_files_of_other_names(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source, "a.json", rate(1, 1400), "not json", rate(2, 1.5, "EUR"))
    write_lines(source, "b.txt", rate(3, 9))
    stream = streams.fx_file_stream(spark, str(source), keep_corrupt=True, max_files=1, glob="*.json")
    target = tmp_path / "out"
    streams.append_stream(stream, str(tmp_path / "progress"), path=str(target)).awaitTermination()
    found = spark.read.parquet(str(target)).collect()
    assert sorted((r.fx_rate, r._corrupt_record) for r in found if r.fx_rate) == [(1.5, None), (1400.0, None)]
    assert [r._corrupt_record for r in found if r.fx_rate is None] == ["not json"]


def test_lines_lose_nothing(spark, tmp_path):
    source = tmp_path / "in"
    further, wrong = {**rate(2, 1.5), "desk": "a"}, {**rate(3, 0), "fx_rate": "many"}
    write_lines(source, "a.json", rate(1, 1400), "not json", further, wrong, "", [1])
    stream = streams.fx_line_stream(spark, str(source))
    target = tmp_path / "out"
    streams.append_stream(stream, str(tmp_path / "progress"), path=str(target)).awaitTermination()
    found = sorted(((r.fx_rate, r._rescued) for r in spark.read.parquet(str(target)).collect()), key=repr)
    texts = ["not json", json.dumps(wrong), "[1]"]
    assert found == sorted([(1400.0, None), (1.5, json.dumps(further)), *((None, t) for t in texts)], key=repr)


def test_inferred_schema(spark, tmp_path):
    write_lines(tmp_path / "in", "a.json", {**rate(1, 1400.5), "source": "desk"})
    stream = streams.fx_file_stream(spark, str(tmp_path / "in"), schema=None)
    assert dict(stream.dtypes) == {
        "as_of_ts": "timestamp",
        "base_ccy": "string",
        "quote_ccy": "string",
        "fx_rate": "double",
        "source": "string",
    }


def test_append_needs_one_target(spark, tmp_path):
    stream = streams.fx_file_stream(spark, str(tmp_path))
    for target in ({}, {"table": "t", "path": "p"}):
        with pytest.raises(ValueError):
            streams.append_stream(stream, str(tmp_path / "c"), **target)


def test_from_files_to_stored_costs(spark, tmp_path, costs, rows):
    """Each tick appends a copy of the costs, restarts add nothing, new costs count later on."""
    schema = "fx_flow"
    spark.sql(f"CREATE DATABASE {schema}")
    spark.catalog.setCurrentDatabase(schema)
    try:
        materialize(costs, names.GOLD_TABLE)
        source, progress = tmp_path / "rates", str(tmp_path / "progress")
        write_lines(source, "1.json", rate(1, 1400.0), rate(1, 0.9, "EUR"))
        write_lines(source, "2.json", rate(2, 1500.0))
        run = lambda: streams.run_fx(spark, str(source), progress)
        stored = run()
        batch = spark.createDataFrame(
            [(datetime.datetime(2024, 1, d, 9), "USD", "KRW", r) for d, r in ((1, 1400.0), (2, 1500.0))],
            streams.FX_SCHEMA,
        )
        want = cost_per_tick(costs, batch)
        assert rows(stored.select(want.columns)) == rows(want)
        assert run().count() == 80

        spark.createDataFrame([("T9", 1, 8.0)], COSTS).write.insertInto(names.GOLD_TABLE)
        assert run().count() == 80
        write_lines(source, "3.json", rate(3, 2.0))
        after = run()
        assert after.count() == 80 + 41
        assert [r.est_cost_krw for r in after.filter("tenant_name = 'T9'").collect()] == [16.0]
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql(f"DROP DATABASE {schema} CASCADE")
