"""The pipeline against a version in plain Python, and the entry points with and without this package."""

import collections
import subprocess
import sys

import corpus_pipeline
from meterline.llm import mixing, pieces, secrets
from meterline.llm.quality import COUNTS
from tests.conftest import ROOT, SF_DIR
from tests.llm.test_corpus import brute_components, brute_targets, shingles, size_of
from tests.llm.test_rows import quality_of


def plain_copies(rows):
    """How often the mix takes the first word of each row (doc_id, source, text)."""
    import hashlib

    sizes = collections.Counter()
    for _, source, text in rows:
        sizes[source] += size_of(text)
    target = brute_targets(sizes)

    def place(row):
        seed = f"{mixing.SEED}:{'' if row[0] is None else row[0]}"
        return int(hashlib.md5(seed.encode()).hexdigest()[:8], 16), row[0], size_of(row[2])

    at, copies = collections.Counter(), []
    for row in sorted(rows, key=place):
        source = row[1]
        begin = at[source]
        at[source] += size_of(row[2])
        passes, rest = divmod(int(min(target[source], 2 * sizes[source])), max(1, sizes[source]))
        copies += [row] * (passes + (begin < rest) if size_of(row[2]) else 0)
    return copies


def test_pipeline_against_plain_python(spark):
    import sentencepiece

    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    good = sorted((r for r in rows if quality_of(r[2])[1]), key=lambda r: r[0])
    sets = [shingles(text, 5) for *_, text in good]
    edges = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 5 * len(a & b) >= 4 * len(a | b)]
    root = brute_components(len(good), edges)
    one = [row for i, row in enumerate(good) if root[i] == i]
    assert len(one) < len(good) < len(rows)
    clean = [(i, source, secrets.redacted(text, secrets.all_spans(text))) for i, source, text in one]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    want = collections.Counter((i, source, tuple(model.encode(text))) for i, source, text in plain_copies(clean))
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert collections.Counter((r.doc_id, r.source, tuple(r.ids)) for r in found) == want
    assert all(r.n_pieces == len(r.ids) for r in found)


def test_stages_of_nothing_and_of_odd_rows(spark, docs, no_docs):
    for frame in (docs, no_docs):
        rows = frame.select("doc_id", "text", "source", "size", "row", "verdict")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = rows.columns
            rows = stage(spark, rows, SF_DIR)
            assert rows.columns == columns
        rows = corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR)
        assert (rows.count() == 0) == (frame is no_docs)


def test_registered():
    import __spark_entry__ as entry

    queries = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in queries) == 1
    assert "pipeline" in queries and set(entry.oracle_sql()) <= set(queries)
    assert len(COUNTS) == 6


def test_entry_without_this_package():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('meterline.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))\n"
    )
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=False)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) >= 76
