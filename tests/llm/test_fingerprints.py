"""Sketches against sets of shingles, merging, and successors in an order."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterline.llm import fingerprints as fp
from tests.compare import connect, differences
from tests.conftest import SF_DIR
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    if not words:
        return set()
    runs = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return {hashlib.md5(run.encode()).hexdigest()[:16] for run in runs}


def bottom(hashes, size=fp.SIZE):
    return sorted(hashes)[:size]


def words(n, seed):
    rand = random.Random(seed)
    return [f"w{rand.randrange(10**6)}" for _ in range(n)]


def test_sketches_of_the_fixture(spark, docs):
    for row in docs.select("text", fp.sketch(F.col("text")).alias("s")).collect():
        assert row.s == bottom(shingles(row.text))
    back = docs.select(fp.sketch(F.col("text")).alias("s")).select("s", fp.sketch_of(fp.fingerprint(F.col("s"))).alias("back"))
    assert back.filter("s <> back").count() == 0


def test_likeness(spark):
    common = words(2000, 1)
    texts = {
        "same": (common, common),
        "half": (common + words(1000, 2), common + words(1000, 3)),
        "inside": (common[:500], common),
        "none": (words(800, 4), words(800, 5)),
        "short": (common[:60], common[:60] + words(30, 6)),
        "tiny": (["a", "b"], ["a", "c"]),
        "empty": ([], []),
        "one empty": ([], common),
        "far smaller": (["a"], common),
    }
    rows = [(name, " ".join(a), " ".join(b)) for name, (a, b) in texts.items()]
    a, b = F.col("s.a"), F.col("s.b")
    df = spark.createDataFrame(rows, "name string, a string, b string")
    s = F.struct(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b")).alias("s")
    found = df.select("name", s).select(
        "name", fp.resemblance(a, b).alias("r"), fp.containment(a, b).alias("c"), fp.distinct_shingles(a).alias("n")
    )
    for row in found.collect():
        left, right = (shingles(" ".join(t)) for t in texts[row.name])
        union = len(left | right)
        assert row.r == pytest.approx(len(left & right) / union if union else 1, abs=0.15)
        if row.name == "far smaller":
            assert row.c is None or row.c == 0
        else:
            assert row.c == pytest.approx(len(left & right) / len(left) if left else 1, abs=0.15)
        assert row.n == pytest.approx(len(left), rel=0.3)
        if union <= fp.SIZE:  # exact while no sketch is full
            assert row.r == (len(left & right) / union if union else 1) and row.n == len(left)


def test_merging_parts_equals_the_whole(spark):
    parts = [(key, " ".join(words(300, seed))) for seed in range(40) for key in ["a" if seed % 3 else None]]
    parts += [("b", ""), ("b", None), ("c", "only one")] + [("a", parts[1][1])] * 50
    df = spark.createDataFrame(parts, "sketch string, part string").repartition(7)
    sketched = df.select(F.col("sketch").alias("hash"), fp.sketch(F.col("part")).alias("salt"))
    have = {r[0]: r[1] for r in fp.merged_sketches(sketched, ["hash"], "salt").collect()}
    want = {}
    for key, text in parts:
        want.setdefault(key, set()).update(shingles(text))
    assert have == {key: bottom(hashes) for key, hashes in want.items()}
    plan = fp.merged_sketches(sketched, ["hash"], "salt")._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def successors(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    placed = fp.with_next(df)
    order = Window.partitionBy("bucket").orderBy("guest", "key")
    found = placed.withColumn("next", F.lead("text").over(order)).filter("not guest")
    return sorted(((r.row.doc_id, r.text, r.next) for r in found.collect()), key=repr)


def test_successors(spark):
    rows = [(i, f"text {i}") for i in random.Random(0).sample(range(-5000, 5000), 700)]
    order = sorted(rows, reverse=True)
    want = [(*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert successors(spark, rows) == sorted(want, key=repr)


def test_successors_with_ties_and_nulls(spark):
    """Equal ids are ordered by text somehow; each row has one successor, and each row follows one."""
    rows = [(i, f"t{i}") for i in range(20)] + [(7, "again")] * 300 + [(7, f"x{i}") for i in range(30)]
    rows += [(None, f"n{i}") for i in range(50)] + [(None, None)]
    found = successors(spark, rows)
    assert sorted(f[1] for f in found) == sorted(r[1] or "" for r in rows) == sorted(f[2] for f in found)
    after = {f[1]: f[2] for f in found if f[0] is not None and f[0] != 7}
    assert all(after[f"t{i}"] == f"t{i - 1}" for i in range(9, 20))
    assert after["t0"].startswith("n") or after["t0"] == ""
    assert sum(f[2] == "t19" for f in found) == 1


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(None, None)], [(1, "a"), (2, "b")]])
def test_few_rows(spark, rows):
    found = successors(spark, rows, 1)
    texts = [r[1] or "" for r in sorted(rows, key=lambda r: -(r[0] or 0))]
    assert [f[1:] for f in sorted(found, key=lambda f: -(f[0] or 0))] == list(zip(texts, texts[1:] + texts[:1], strict=True))


def test_clashing_names(spark, docs):
    clash = docs.withColumns({name: F.lit(1) for name in ("key", "bucket", "guest", "bounds", "place")})
    assert fp.with_next(clash).filter("not guest").select("row.*").columns == clash.columns
    assert fp.with_next(docs).filter("not guest").count() == len(ROWS)


def test_matches_sql_without_python(spark):
    found = fp.op11_fingerprints(spark, SF_DIR)
    assert differences(found, connect(SF_DIR), fp.OP11_SQL) == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
