"""Spelling variants against deletion of every letter, on random words, the fixture and the test tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import variants
from tests.conftest import SF_DIR
from tests.llm.conftest import ROWS

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    found = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(words):
    """Pairs one edit apart: equal after a letter is taken from one, or from the same place of both."""
    pairs, holes = set(), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                pairs.add(frozenset((w, shorter)))
            holes[i, shorter].add(w)
    for same in holes.values():
        pairs |= {frozenset((a, b)) for a in same for b in same if a < b}
    return pairs


def grouped(counts):
    links = collections.defaultdict(set)
    for a, b in near(counts):
        links[a].add(b)
        links[b].add(a)
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    found = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, n, len(links[w]), form[w], counts.get(form[w]), root))
    return found


def shown(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def random_words(n, letters, seed=3):
    rand = random.Random(seed)
    words = {}
    while len(words) < n:
        word = "".join(rand.choices(letters, k=rand.randint(7, 10)))
        words[word] = rand.choice([2, 3, 5, 40, 60, 700, 9000])
        for _ in range(3):
            at, other = rand.randrange(len(word)), rand.choice(letters)
            changed = rand.choice([word[:at] + word[at + 1 :], word[:at] + other + word[at:], word[:at] + other + word[at + 1 :]])
            if len(changed) >= 7:
                words.setdefault(changed, rand.choice([2, 20, 200]))
    return words


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aeéÿzÀ÷"])
@pytest.mark.parametrize("block", [1 << 15, 40])
def test_random_words(spark, monkeypatch, letters, block):
    """With few letters most words are near to many others and are alike in their letters."""
    monkeypatch.setattr(variants, "BLOCK_WORDS", block)
    monkeypatch.setattr(variants, "LEAF", 4)
    counts = random_words(400, letters)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert shown(variants.variant_groups(words)) == grouped(counts)


def test_small_sample_and_lengths_without_a_tree(spark, monkeypatch):
    monkeypatch.setattr(variants, "SAMPLE", 30)
    monkeypatch.setattr(variants, "BLOCK_WORDS", 50)
    counts = random_words(300, "abcde") | {"x" * 400: 2, "x" * 399 + "y": 30, "x" * 399: 500}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert shown(variants.variant_groups(words)) == grouped(counts)


def test_tree_visits_few_leaves():
    rand = np.random.default_rng(1)
    words = rand.integers(0, 26, (4000, 9)).astype(np.uint8)
    points = variants.letter_counts(words)
    tree, leaves = variants.Tree.fit(points, 16)
    assert max(map(len, leaves)) <= 16 and sum(map(len, leaves)) == len(points)
    place = tree.place(points)
    assert all((place[rows] == leaf).all() for leaf, rows in enumerate(leaves))
    visits = sum(len(rows) for _, rows in tree.near(points, False))
    assert visits < 0.1 * len(points) * tree.n_leaves


def test_chains_of_forms(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "zzzzzzz": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    have = shown(variants.variant_groups(words))
    assert have == grouped(counts)
    assert {r[5] for r in have} == {"abcdefghijk", "zzzzzzz"}


def test_counting(spark, docs, no_docs):
    assert variants.counted_words(no_docs).count() == 0
    assert shown(variants.variant_groups(variants.counted_words(no_docs))) == set()
    want = counted((row[0], row[1]) for row in ROWS)
    assert {tuple(r) for r in variants.counted_words(docs).collect()} == set(want.items())
    assert shown(variants.variant_groups(variants.counted_words(docs))) == grouped(want)
    text = "Ünïcode ÀÈìòùÿß×÷ no-break spaces ABCDEFGH abcdefgh ABCDEFGÀ " * 3
    one = spark.createDataFrame([(n, text) for n in range(50)], "doc_id int, text string")
    assert {tuple(r) for r in variants.counted_words(one).collect()} == set(counted((n, text) for n in range(50)).items())


def test_whole_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert shown(variants.op13_variants(spark, SF_DIR)) == grouped(counted(rows))


def test_each_pair_once(spark):
    counts = random_words(200, "abc")
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [frozenset((r.word, r.other)) for r in variants.near_words(words).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == near(counts)
    assert variants.near_words(words.filter(F.lit(False))).count() == 0
