"""Operators that look at all rows together: mixing, joins and dedup, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterline.llm import components, jaccard, mixing, sentences, spans, suffixes, vectors
from tests.compare import connect, differences
from tests.conftest import SF_DIR
from tests.llm.conftest import PASSAGE, ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def size_of(text):
    return len(WORD.findall(text or ""))


# ---------------------------------------------------------------- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * share for s in free}
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    return target


@pytest.mark.parametrize("block", [7, 1024])
def test_mixing(spark, docs, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = rows[:120] + [(i, text, source) for i, text, source, _ in ROWS if i != 9]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit(1))
    mix = mixing.Mix(frame.repartition(4))
    key = ("source_no", "bucket", "number", "doc_id", "size", "source", "target")
    taken = mix.pieces().groupBy(*key).agg(F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("taken"))
    found = taken.collect()
    assert collections.Counter((r.doc_id, r.size) for r in found) == collections.Counter((i, size_of(t)) for i, t, _ in rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += size_of(text)
    target = brute_targets(sizes)
    by_source = collections.Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        by_source[r.source] += r.taken
    assert all(0 <= target[s] - by_source[s] < 1.001 for s in sizes)
    again = mixing.Mix(frame.repartition(2)).pieces().groupBy("doc_id", "size").agg(F.sum(F.col("last") - F.col("first")))
    first = mix.pieces().groupBy("doc_id", "size").agg(F.sum(F.col("last") - F.col("first")))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, first.collect()), key=repr)

    slots = sorted(mix.slots.collect())
    assert len({s.turn for s in slots}) == len(slots)
    seen, n = collections.Counter(), collections.Counter(s.source_no for s in slots)
    for i, slot in enumerate(slots, 1):  # ranks in turn, and every source near its share at any time
        assert slot.rank == seen[slot.source_no]
        seen[slot.source_no] += 1
        assert all(abs(seen[s] - i * n[s] / len(slots)) < 8 for s in n)
    copies = mix.documents()
    assert copies.columns == frame.columns
    assert abs(copies.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] / sum(by_source.values()) - 1) < 0.4


def test_mixing_matches_sql(spark):
    assert differences(mixing.op1_mixing(spark, SF_DIR), connect(SF_DIR), mixing.OP1_SQL) == []


def test_mixing_of_nothing(no_docs, docs):
    assert mixing.Mix(no_docs).pieces().count() == 0 and mixing.Mix(no_docs).documents().count() == 0
    wordless = docs.filter("text IS NULL OR trim(text) = ''")
    assert [r["last"] - r["first"] if r["last"] is not None else 0 for r in mixing.Mix(wordless).pieces().collect()] == [0] * wordless.count()
    assert mixing.Mix(wordless).documents().count() == 0


# ---------------------------------------------------------------- components and n-grams


def brute_components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = brute_components(361, edges)
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert {r.node: r.component for r in found} == {i: want[i] for i in touched}
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_rows(seed):
    """Groups of texts with a few words changed, of many sizes, and rows of the messy table."""
    rng, rows = random.Random(seed), []
    for group in range(25):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(500)}"
            rows.append((1000 + len(rows), " ".join(copy)))
    return rows + [(i, text) for i, text, *_ in ROWS if i is not None and i != 9]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
@pytest.mark.parametrize("rows_in_block", [256, 3])
def test_ngram_join(spark, n, percent, rows_in_block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_in_block)
    monkeypatch.setattr(jaccard, "BLOCK_COLUMNS", 64)
    rows = near_rows(n)
    sets = [shingles(text, n) for _, text in rows]
    edges = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if a and b and 100 * len(a & b) >= percent * len(a | b)
    ]
    root = brute_components(len(rows), edges)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    want = collections.Counter((rows[i][0], len(sets[i]), least[r]) for i, r in enumerate(root))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)).repartition(4)
    assert collections.Counter(map(tuple, jaccard.near_duplicates(frame, n, percent).collect())) == want
    if rows_in_block == 256:
        kept = jaccard.keep_one(frame, n, percent)
        assert kept.columns == frame.columns
        groups = {r for i, r in enumerate(root) if sets[i]}
        assert sum(size_of(r.text) > 0 for r in kept.collect()) == len(groups)


def test_linked_pairs_share_a_column_and_products_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(200):
        for name, most in (("BLOCK_COLUMNS", 40), ("BLOCK_PRODUCTS", 400), ("PANEL_SHARE", 12)):
            monkeypatch.setattr(jaccard, name, int(rng.integers(1, most)))
        m, percent = int(rng.integers(1, 60)), int(rng.choice([60, 80, 90]))
        sets = [np.unique(rng.integers(0, m + 1, rng.integers(1, m + 5))).astype(np.uint64) for _ in range(20)]
        sets[:8] = [s[: max(1, len(s) - int(rng.integers(0, 2)))] for s in sets[-8:]]
        together = lambda a, b: len(np.intersect1d(a, b)) * 100 >= percent * len(np.union1d(a, b))
        want = np.array([[a is b or together(a, b) for b in sets] for a in sets])
        assert (jaccard.linked(sets, percent) == want).all()

        level = rng.integers(0, 3, jaccard.COUNTERS).astype(np.uint8)
        given = [jaccard.first_columns(s, level, percent).tolist() for s in sets]
        count = collections.Counter(g for columns in given for g in columns)
        looked_at = []
        for s, columns in zip(sets, given, strict=True):
            least = -(-len(s) * percent // 100)
            lacks = jaccard.lacking(least, percent)
            skip = min(least, 2 * lacks + 1) - lacks - 1  # as left_out, which the join tests use
            looked_at.append(set(sorted(columns, key=lambda g: (-count[g], -g))[skip:]))
        assert all(looked_at[i] & looked_at[j] for i, j in zip(*np.nonzero(want), strict=True))


def test_strangers_that_share_columns_fall_into_no_cluster(spark, monkeypatch):
    words = [f"w{i}" for i in range(4000)]
    rng, rows = random.Random(11), []
    for i in range(60):  # each shares three eighths with the next, every third comes again with one word changed
        own = [rng.choice(words) for _ in range(80)]
        own[:30] = rows[-1][1].split()[-30:] if rows else own[:30]
        rows.append((2 * i, " ".join(own)))
    near = [(i + 1, " ".join([*text.split()[:40], "changed", *text.split()[41:]])) for i, text in rows[::3]]
    frame = spark.createDataFrame(rows + near, "doc_id long, text string").repartition(3)
    seen, clusters, marked = [], jaccard._clusters, []
    marks = jaccard._marks

    def kept(*given):
        seen.append(clusters(*given))
        return seen[-1]

    def counted(wanted):
        marked.append(marks(wanted))
        return marked[-1]

    monkeypatch.setattr(jaccard, "_clusters", kept)
    monkeypatch.setattr(jaccard, "_marks", counted)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, 3, 90).collect()}
    assert found == {i: i - i % 2 for i, _ in rows + near}
    sizes = [r["count"] for r in seen[0].groupBy("component").count().collect()]
    assert sizes == [2] * len(near)  # chance columns made larger ones before sketches were compared
    assert 0 < np.bitwise_count(marked[0]).sum() <= 2 * len(near)  # texts outside clusters stay where they are


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_classes_and_sketches_keep_every_linked_pair(percent):
    rng = np.random.default_rng(percent)
    sizes = np.arange(1, 3000)
    classes = jaccard.size_classes(sizes, percent)
    most = sizes * 100 // percent  # the largest set linked with each
    assert (jaccard.size_classes(most, percent) - classes <= 1).all() and (np.diff(classes) >= 0).all()
    pool, pairs = rng.integers(0, 1 << 63, 40000, np.uint64), []
    for size in [*range(1, 40), 500, 3000, 15000]:
        one = rng.choice(pool, size, replace=False)
        pairs += [(one, np.concatenate((one[k:], rng.choice(pool, m)))) for k in (0, size // 20) for m in (0, size // 9, size)]
    pairs = [(np.unique(a), np.unique(b)) for a, b in pairs]
    columns = [pa.array([jaccard.sketch(p[i], percent) for p in pairs], pa.binary()) for i in (0, 1)]
    found = jaccard.unlike(*columns)
    assert (found <= [len(np.setxor1d(*p)) for p in pairs]).all()
    assert (jaccard.unlike(columns[0].slice(7), columns[1].slice(7)) == found[7:]).all()


@pytest.mark.parametrize("listed", [0, 2, 128])
def test_clusters_of_crowded_columns(spark, listed, monkeypatch):
    monkeypatch.setattr(jaccard, "LISTED", listed)
    rng, rows = random.Random(listed), []
    for _ in range(12):
        text = [f"x{rng.randrange(30)}" for _ in range(rng.randrange(4, 60))]
        for _ in range(5):
            rows.append((len(rows), " ".join(text)))
            text[rng.randrange(len(text))] = f"x{rng.randrange(30)}"
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    grams = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (text.split() for _, text in rows)]
    edges = [(i, j) for j, b in enumerate(grams) for i, a in enumerate(grams[:j]) if 100 * len(a & b) >= 80 * len(a | b)]
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, 2, 80).collect()}
    assert [found[i] for i in range(len(rows))] == brute_components(len(rows), edges)


def test_column_counts_are_those_of_all_sets(docs):
    key = F.lit(0).cast("long")
    rows = docs.select("doc_id", "text", key.alias("row_1"), key.alias("row_2")).repartition(5)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(jaccard._sets(2), f"{jaccard.SETS.format(id=kind)}, {jaccard.COUNTS}")
    counts = jaccard.column_counts(found.filter("slice IS NOT NULL").select("slice", "counts"))
    sets = {s.tobytes(): s for s in jaccard.gram_sets(pa.array([r.text for r in docs.collect()], pa.string()), 2)}
    once = np.zeros(jaccard.COUNTERS, np.int64)
    for grams in sets.values():
        np.add.at(once, jaccard.counters(grams), 1)
    assert ((counts >= once) & (counts <= len(ROWS) * once)).all() and once.any()


def test_ngram_join_of_odd_rows(docs, no_docs):
    found = jaccard.near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    assert all(r.component_id == r.doc_id for r in found if r.n_shingles == 0)
    assert {r.component_id for r in found if r.doc_id in (1, 3)} == {1}
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0
    assert jaccard.keep_one(docs).filter("doc_id IS NULL").count() == 2


# ---------------------------------------------------------------- repeated bytes and sentences


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(300):
        x = bytes(rng.choices(rng.choice([b"ab", b"abc", b"a", bytes(range(256))]), k=rng.randrange(70)))
        assert suffixes.suffix_array(np.frombuffer(x, np.uint8)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute_bytes(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    found = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(mark[i] and (i == 0 or not mark[i - 1]) for i in range(len(r)))
        kept = bytes(c for c, m in zip(r, mark, strict=True) if not m)
        found.append((len(r), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found)


@pytest.mark.parametrize("shard", [1 << 23, 60], ids=["whole shards", "shards in parts"])
def test_repeated_bytes(spark, shard, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    rng = random.Random(6)
    made = ["".join(rng.choices("ab", k=rng.randrange(50))) for _ in range(50)] + [None, "", "é" * 30, "x" * 40, "x" * 40]
    frame = spark.createDataFrame([(i % 40, t) for i, t in enumerate(made)], "doc_id long, text string")
    found = suffixes.dedup_bytes(frame, 8, 4).select("cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")
    assert sorted(map(tuple, found.collect())) == brute_bytes(made, 8)


def test_repeated_bytes_of_rows(spark, docs, no_docs):
    found = suffixes.dedup_bytes(docs)
    assert found.columns == [*docs.columns, "cut_1"] and {r.cut for r in found.select("cut").collect()} == {4}
    found = found.select("cut_1.*").drop("kept")
    assert sorted(map(tuple, found.collect())) == brute_bytes([text for _, text, *_ in ROWS], 200)
    assert suffixes.dedup_bytes(no_docs).count() == 0
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    have = sorted(tuple(r)[1:] for r in suffixes.op3_suffix_dedup(spark, SF_DIR).collect())
    assert have == brute_bytes([r.text for r in table.collect()], 200)


CUT = re.compile(r"(?<=[.!?\n])(?=[^.!?\n])|(?<= )(?=[A-ZÀ-ÖØ-Þ])")


def brute_sentences(rows, min_words):
    """Texts without repeated runs, for rows of different (id, text) in their order."""
    seen, kept = set(), []
    for text in rows:
        text = text or ""
        cuts = [0, *(m.start() for m in CUT.finditer(text) if m.start()), len(text)]
        words = [m.span() for m in WORD.finditer(text)]
        parts = [[w for w in words if a <= w[0] < b] for a, b in zip(cuts, cuts[1:], strict=False)]
        parts = [p for p in parts if p]
        runs = set()
        for i in range(len(parts)):
            for step in (1, -1):
                total, j = 0, i
                while 0 <= j < len(parts):
                    total += len(parts[j])
                    if total >= min_words:
                        runs.add((min(i, j), max(i, j)))
                        break
                    j += step
        gone = set()
        for i, j in sorted(runs):
            a, b = parts[i][0][0], parts[j][-1][1]
            if text[a:b] in seen:
                gone.update(range(a, b))
            seen.add(text[a:b])
        kept.append("".join(c for k, c in enumerate(text) if k not in gone))
    return kept


def test_sentences(spark, no_docs):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in table[:150]]
    rows += [(900, PASSAGE), (901, "It came in the middle of " + PASSAGE + " and went on."), (902, None), (903, "")]
    rows += [(None, "Last. " + PASSAGE)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("key", F.lit(1))
    found = {r.doc_id: r.cut.kept for r in sentences.dedup_sentences(frame).collect()}
    assert found == dict(zip([i for i, _ in rows], brute_sentences([t for _, t in rows], 25), strict=True))
    assert found[900] == PASSAGE and found[901].split() == "It came in the middle of and went on.".split()
    assert found[None].strip() == "Last."
    assert sentences.dedup_sentences(no_docs).count() == 0


def test_equal_rows_keep_one_text(docs):
    found = sentences.dedup_sentences(docs).select("doc_id", "cut_1.kept").collect()
    assert len(found) == len(ROWS)
    assert [r.kept for r in found if r.doc_id == 1] == [PASSAGE]
    assert all(not r.kept.strip() for r in found if r.doc_id == 3)


@pytest.mark.parametrize("both_keys", [True, False])
def test_many_equal_rows_hold_each_span_once(spark, monkeypatch, both_keys):
    """The list of spans that meets a row is as long as one text's, however many rows are equal."""
    text, n = "abcdefghij" * 20, 300
    frame = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    keyed = frame.select(*spans.row_key(F.col("doc_id"), F.col("text"))[: 1 + both_keys])
    starts = F.explode(F.sequence(F.lit(0), F.lit(150), F.lit(50))).alias("start")
    found = keyed.repartition(7).select("*", starts).withColumn("end", F.col("start") + 20)
    plain = spans.without_spans(frame, found, "doc_id", "text").select("cut.*").distinct().collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in plain] == [(200, 80, 4)]
    assert plain[0].kept == "".join(text[i + 20 : i + 50] for i in range(0, 200, 50))
    real = spans._cut

    def counting(whole_copies):
        cut = real(whole_copies)

        def run(texts, held, copies):
            if max(len(x or ()) for x in held.to_pylist()) > 8:
                raise ValueError("spans held more than once")
            return cut(texts, held, copies)

        return run

    monkeypatch.setattr(spans, "_cut", counting)
    assert spans.without_spans(frame, found, "doc_id", "text", whole_copies=500).count() == n
    assert spans.without_spans(frame, found, "doc_id", "text").agg(F.sum("cut.n_spans")).first()[0] == 4 * n


def test_equal_rows_of_null_ids(spark):
    rows = [(None, PASSAGE)] * 40 + [(1, "Before. " + PASSAGE)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cut = sentences.dedup_sentences(frame).collect()
    assert sorted(r.cut.n_removed for r in cut) == [0] + [len(PASSAGE)] * 40
    cut = suffixes.dedup_bytes(frame, 50, 10).collect()
    assert {(r.doc_id, r.cut.n_removed) for r in cut} == {(None, len(PASSAGE)), (1, len(PASSAGE))}


# ---------------------------------------------------------------- vectors


@pytest.mark.parametrize("task_rows", [4096, 24])
def test_near_vectors(spark, task_rows, monkeypatch):
    monkeypatch.setattr(vectors, "TASK_ROWS", task_rows)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    made = [(centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25])).tolist() for i in range(240)]
    rows = [(i, v, int(i % 12 % 3)) for i, v in enumerate(made)]
    rows += [(500 + i, made[0], 0) for i in range(30)] + [(600, made[0], None), (601, None, 0), (602, [0.0] * 16, 0)]
    rows += [(603, [float("nan")] * 16, 0), (604, [], 0), (605, [None] * 16, 0), (606, [1.0] * 3, 0), (607, [2.0] * 3, 0)]
    usable = [(i, v, lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    edges, links = [], collections.Counter()
    for i, (a, x, p) in enumerate(usable):
        for j, (b, y, q) in enumerate(usable[:i]):
            same = p == q and len(x) == len(y)
            if same and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                edges.append((i, j))
                links.update([a, b])
    root = brute_components(len(usable), edges)
    component = {usable[i][0]: usable[r][0] for i, r in enumerate(root)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("side", F.lit(1))
    found = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    assert len(found) == len(rows)
    assert sum(r.n_links for r in found.values()) >= 0.9 * sum(links.values())
    for i, r in found.items():
        assert r.n_links <= links[i] and r.kept == (r.vec_id == r.component_id)
        assert r.component_id >= component.get(i, i)
    assert all(found[i].n_links == 0 and found[i].kept for i in range(600, 606))
    assert found[606].n_links == found[607].n_links == 1
    assert vectors.near_vectors(frame.limit(0)).count() == 0
    assert vectors.recall() > 0.99


@pytest.mark.parametrize("element", ["float", "double"])
def test_near_vectors_of_any_scale(spark, element):
    """Every finite vector other than zero keeps its links, whatever its scale."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 16))
    scales = {"float": (1.0, 1e-30, 1e-22, 1e25, 3e37), "double": (1.0, 1e-300, 1e-170, 1e200, 1e306)}[element]
    rows = [(10 * i + k, (scale * v).tolist(), "a") for i, v in enumerate(base) for k, scale in enumerate(scales)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    frame = frame.withColumn("embedding", F.col("embedding").cast(f"array<{element}>"))
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect()}
    assert found == {i: (len(scales) - 1, i - i % 10) for i, _, _ in rows}


@pytest.mark.parametrize(("kind", "scales"), [(np.float32, (1e-30, 1e25, 3e37)), (np.float64, (1e-300, 1e200, 1e306))])
def test_projections_do_not_depend_on_scale(kind, scales):
    base = np.random.default_rng(3).standard_normal((6, 16)).astype(kind)
    bucket, value = vectors._projected(base)
    for scale in scales:
        same, near = vectors._projected((base * scale).astype(kind))
        assert (same == bucket).all() and np.allclose(near, value, atol=1e-5)
