"""Rate files whose fields grow, over restarts: nothing is lost and later readers see columns."""

import json

from meterline.streaming import fields
from tests.test_fx import rate, write_lines


def test_growing_fields_and_restarts(spark, tmp_path):
    source, path, progress = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "progress")

    def run(name, *lines):
        write_lines(source, name, *lines)
        fields.take_in(spark, str(source), path, progress).awaitTermination()
        grown = fields.grow_fields(fields.stored_rates(spark, path), path)
        rows = [r.asDict() for r in fields.stored_rates(spark, path).collect()]
        return grown, sorted(rows, key=lambda r: (r["fx_rate"] or 0, str(r["_rescued"])))

    # One line with a new field is not enough; it stays as text.
    once = {**rate(1, 1.0), "desk": "a"}
    grown, rows = run("1.json", once, rate(2, 2.0), "no rate")
    assert grown == () and [r["_rescued"] for r in rows] == ["no rate", json.dumps(once), None]

    # The field recurs: the old line is filled in, others keep what no column holds.
    two = {**rate(3, 3.0), "desk": 7, "Desk": "case"}
    three = {**rate(4, 4.0), "desk": {"id": 1}, "quoted by": None}
    grown, rows = run("2.json", two, three)
    assert grown == ("desk",)
    assert [(r["desk"], r["_rescued"]) for r in rows] == [
        (None, "no rate"), ("a", None), (None, None), ("7", json.dumps(two)), ('{"id":1}', json.dumps(three)),
    ]

    # A restart reads the listed field as a column, and a further one is listed after it.
    four, five = {**rate(5, 5.0), "desk": "b"}, {**rate(6, 6.0), "quoted by": "c"}
    grown, rows = run("3.json", four, five)
    assert grown == ("desk", "quoted by")
    assert [(r["fx_rate"], r["desk"], r["quoted by"], r["_rescued"]) for r in rows] == [
        (None, None, None, "no rate"), (1.0, "a", None, None), (2.0, None, None, None),
        (3.0, "7", None, json.dumps(two)), (4.0, '{"id":1}', None, None), (5.0, "b", None, None), (6.0, None, "c", None),
    ]
    # Nothing new: the list stays, and no row comes twice.
    grown, again = run("4.json", "")
    assert grown == ("desk", "quoted by") and again == rows


def test_only_so_many_fields_at_a_time(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "store")
    line = {**rate(1, 1.0), **{f"f{i}": i for i in range(6)}}
    write_lines(source, "1.json", line, {**line, "f3": 0}, {"f5": 1, **rate(2, 2.0)})
    fields.take_in(spark, str(source), path, str(tmp_path / "progress")).awaitTermination()
    assert fields.grow_fields(fields.stored_rates(spark, path), path, max_fields=2) == ("f5", "f0")
    rows = fields.stored_rates(spark, path)
    assert rows.count() == 3 and rows.filter("_rescued IS NULL").count() == 1
    assert len(fields.grow_fields(rows, path, min_lines=1)) == 6
    assert fields.stored_rates(spark, path).filter("_rescued IS NULL").count() == 3
