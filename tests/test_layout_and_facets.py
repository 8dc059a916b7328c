"""Rows along a curve and the row groups that a filter reads; facet counts from bitmaps against a scan."""

import collections
import glob
import random

import pyarrow.parquet as pq
import pytest

from meterline.operators import clustered as curve
from meterline.operators.facet_index import build_facet_index, count_selected, facet_counts
from meterline.operators.facets import ALL, FACETS, Selection

KIND = "tenant_name string, year int, month int, region string, usage_type string, cost double"


def gold_rows(n, seed=0, tenants=40):
    draw = random.Random(seed)
    hot = lambda: "hot" if draw.random() < 0.33 else f"t{draw.randrange(tenants):03d}"
    return [
        (
            None if draw.random() < 0.01 else hot(),
            draw.choice([2023, 2024, None]) if draw.random() < 0.05 else 2024,
            draw.randrange(1, 13),
            draw.choice(["kr", "us", "eu", "jp", "in", None]),
            draw.choice(["run", "store", "F"]),
            float(i),
        )
        for i in range(n)
    ]


def groups_read(path, column, value):
    """Row groups whose statistics cannot exclude the value, and all row groups."""
    read = every = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for i in range(meta.num_row_groups):
            group = meta.row_group(i)
            at = next(j for j in range(group.num_columns) if group.column(j).path_in_schema == column)
            stats = group.column(at).statistics
            every += 1
            read += not stats.has_min_max or stats.min <= value <= stats.max
    return read, every


def test_every_facet_skips_row_groups(spark, rows, tmp_path):
    frame = spark.createDataFrame(gold_rows(40000), KIND).repartition(4).cache()
    by_curve = curve.write_clustered(frame, f"{tmp_path}/curve", files=64)
    frame.repartitionByRange(64, "year", "month", "tenant_name").sortWithinPartitions("year", "month", "tenant_name").write.parquet(f"{tmp_path}/months")
    assert rows(by_curve) == rows(frame)
    share = {}
    for column, value in (("tenant_name", "t007"), ("region", "kr"), ("usage_type", "store")):
        read, every = groups_read(f"{tmp_path}/curve", column, value)
        plain, every_plain = groups_read(f"{tmp_path}/months", column, value)
        share[column] = read / every, plain / every_plain
    assert all(read <= 0.5 for read, _ in share.values()), share
    assert share["region"][1] == share["usage_type"][1] == 1.0  # a sort by month and tenant skips nothing for these


def test_a_hot_value_is_cut_into_ranges(spark):
    frame = spark.createDataFrame([("hot", 2024, 1, "kr", "run", float(i)) for i in range(4000)], KIND)
    sizes = curve.clustered(frame, files=8).rdd.glom().map(len).collect()
    assert max(sizes) < 1000


def test_split_values(spark):
    frame = spark.createDataFrame(gold_rows(2000), KIND)
    cuts = curve.split_values(frame, bits=3)
    assert all(len(v) <= 7 and v == sorted(set(v)) for v in cuts.values())
    assert cuts["region"] == ["in", "jp", "kr", "us"]  # the least value needs no split
    assert curve.split_values(frame.limit(0)) == {name: [] for name in curve.CURVE_COLUMNS}
    assert curve.clustered(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        curve.split_values(frame, bits=40)


def counts_by_scan(records, selection):
    chosen = {f: getattr(selection, f) for f in FACETS}
    fits = lambda f, v: v is not None and (ALL in chosen[f] or v in chosen[f])
    found = collections.defaultdict(int)
    for record in records:
        row = dict(zip(FACETS, record, strict=False))
        ok = {f: fits(f, v) for f, v in row.items()}
        for f, v in row.items():
            if v is not None:
                found[f, str(v)] += all(ok[g] for g in FACETS if g != f)
    return {(f, v): (n, n if fits(f, int(v) if f in ("year", "month") else v) else 0) for (f, v), n in found.items()}


SELECTIONS = [
    Selection(),
    Selection(tenant_name=("hot", "t001", "absent"), region=("kr", "us")),
    Selection(month=(1, 2, 3), usage_type=("run",), year=(2024,)),
    Selection(region=()),
    Selection(tenant_name=("absent",)),
    Selection(usage_type=(ALL, "F"), month=(12,)),
]


def test_facet_counts_equal_a_scan(spark):
    records = gold_rows(5000, seed=3)
    index = build_facet_index(spark.createDataFrame(records, KIND).repartition(6))
    for selection in SELECTIONS:
        want = counts_by_scan(records, selection)
        found = facet_counts(index, selection).collect()
        assert {(r.facet, r.value): (r.n_open, r.n_rows) for r in found} == want
        total = sum(n for (f, _), (_, n) in want.items() if f == "usage_type")
        assert count_selected(index, selection).first().n_rows == total


def test_facet_index_of_no_rows(spark):
    index = build_facet_index(spark.createDataFrame([], KIND))
    assert facet_counts(index).count() == 0 and count_selected(index).first().n_rows == 0
