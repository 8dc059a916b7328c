"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame functions only.

A text's shingles are its runs of five words; a text of fewer words is one shingle. A shingle is
hashed to 64 bits, written as sixteen hexadecimal digits, which sort as the numbers do. The sketch
holds the ``k`` smallest different hashes in order. Two sketches are merged by keeping the ``k``
smallest of both, so the parts of a text, of a document or of a corpus may be sketched apart.
Among the ``k`` smallest hashes of two sets together, the share that both hold estimates their
resemblance, and the share of one set's that the other holds its containment; the place of the
k-th hash tells how many different shingles there are. A sketch that is not full is the whole
set, and then all these are exact.

Defined results: a null or empty text, and one of blanks alone, has the empty sketch, which
resembles itself wholly and any other not at all, and is contained in every one; texts are
sketched whole; equal texts have equal sketches; repeated rows give repeated results.
``merged_sketches`` passes over null sketches and keeps null keys as a group of their own; its
result has only the keys and the sketch, so other columns do not matter.

``with_next`` gives every row its successor in an order of the whole table by one shuffle of
the texts. Bounds of buckets come from the order keys alone; a row on a bound also goes to the
bucket before it, as the successor of that bucket's last row. Rows equal in id are ordered by
their text, rows equal in both by their number in the scan, so that no group fills one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.common import table

WORDS = 5
SIZE = 128
DIGITS = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one bucket of ``with_next`` should have.
BUCKET_BYTES = 32 << 20
#: Groups that one key is dealt into before its sketches are merged.
SALTS = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, size: int = SIZE, words: int = WORDS) -> Column:
    """The ``size`` smallest hashes of a text's shingles, in order."""

    def shingles(found: Column) -> Column:
        last = F.greatest(F.size(found) - words, F.lit(0))
        # Places beyond the end of a short text are null and passed over.
        hashed = lambda i: F.md5(F.concat_ws(" ", *[F.get(found, i + k) for k in range(words)]))
        smallest = F.slice(F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(0), last), hashed))), 1, size)
        digits = F.transform(smallest, lambda one: F.substring(one, 1, DIGITS))
        return F.when(F.size(found) > 0, digits).otherwise(F.array().cast("array<string>"))

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), shingles)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of |A and B| / |A or B|, from 0 to 1."""
    both = lambda union: F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(_let(merged(a, b, size), both))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of |A and B| / |A|, from 0 to 1; null if none of A's hashes is among the smallest of both."""
    share = lambda own: F.try_divide(F.size(F.array_intersect(own, b)), F.size(own))
    return F.when(F.size(a) == 0, 1.0).otherwise(_let(F.array_intersect(a, merged(a, b, size)), share))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimate of the number of different shingles; exact while the sketch is not full."""
    # The first thirteen digits are 52 bits, which a double holds.
    place = F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") + 1
    estimate = (size - 1) / (place / float(1 << 52))
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(estimate)


def fingerprint(a: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(a, "")


def sketch_of(fingerprint: Column) -> Column:
    """The sketch that a string stands for."""
    return F.regexp_extract_all(fingerprint, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def merged_sketches(df: DataFrame, keys: list[str], sketch: str, size: int = SIZE) -> DataFrame:
    """One sketch for each value of the keys, from any number of sketches.

    Hashes are ranked in groups that a key is dealt into, which drops all but ``size`` in each
    task before the shuffle, and then over the key; so no list of sketches is gathered.
    """
    by = [F.col(f"`{key}`").alias(f"key_{i}") for i, key in enumerate(keys)]
    names = [f"key_{i}" for i in range(len(keys))]
    hashes = df.select(*by, F.explode(F.col(f"`{sketch}`")).alias("hash"))
    hashes = hashes.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int"))
    for group in ([*names, "salt"], names):
        rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("hash"))
        hashes = hashes.withColumn("place", rank).filter(F.col("place") <= size).drop("place").distinct()
    sketches = hashes.groupBy(*names).agg(F.array_sort(F.collect_list("hash")).alias("sketch"))
    # Keys all of whose sketches are empty have no hash.
    every = df.filter(F.col(f"`{sketch}`").isNotNull()).select(*by).distinct()
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    none = F.array().cast("array<string>")
    joined = every.alias("l").join(sketches.alias("r"), same, "left")
    named = [F.col(f"l.key_{i}").alias(key) for i, key in enumerate(keys)]
    return joined.select(*named, F.coalesce("r.sketch", none).alias(sketch))


# ---------------------------------------------------------------- successors in an order


def _search(bounds: Column, key: Column, steps: int) -> Column:
    """How many bounds are not above the key, by binary search."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at.lo + at.hi) / 2).cast("int")
        below = F.coalesce(F.get(bounds, middle) <= key, F.lit(False))
        return F.when(at.lo >= at.hi, at).otherwise(
            F.struct(F.when(below, middle + 1).otherwise(at.lo).alias("lo"), F.when(below, at.hi).otherwise(middle).alias("hi"))
        )

    begin = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, halve, lambda at: at.lo)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each row as ``row``, its text and the next row's by falling id, nulls last; the first follows the last.

    ``doc_id`` is an integer. A single row follows itself. The table is scanned three times:
    for its size, for the order of its keys, and for the texts, which are shuffled once.
    """
    spark = docs.sparkSession
    ids, texts = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # A null id comes after all others; ~x is -x - 1, so falling ids are rising keys.
    key = F.struct(
        ids.isNull().alias("none"),
        F.coalesce(F.bitwise_not(ids.cast("long")), F.lit(0)).alias("id"),
        F.xxhash64(texts).alias("text_1"),
        F.xxhash64(F.lit(1), texts).alias("text_2"),
        F.monotonically_increasing_id().alias("number"),
    )
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(texts)), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // bucket_bytes))
    keys = docs.select(key.alias("key")).repartitionByRange(n, "key")
    firsts = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"))
    bounds = firsts.agg(F.array_sort(F.collect_list("first")).alias("bounds")).scalar()  # n keys
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, texts.alias("text"), key.alias("key"))
    bounded = keyed.withColumn("bounds", bounds)
    bucket = _search(F.col("bounds"), F.col("key"), n.bit_length() + 1) - 1
    placed = bounded.withColumn("bucket", bucket)
    on_bound = F.get("bounds", F.col("bucket")) == F.col("key")
    guest = lambda at, is_guest: F.struct(at.alias("bucket"), F.lit(is_guest).alias("guest"))
    own = guest(F.col("bucket"), False)
    copies = F.when(on_bound, F.array(own, guest(F.pmod(F.col("bucket") - 1, F.size("bounds")), True))).otherwise(F.array(own))
    dealt = placed.withColumn("place", F.explode(copies)).select("row", "text", "key", "place.bucket", "place.guest")
    return dealt.repartition("bucket")


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = with_next(docs).withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", "key")
    following = placed.withColumns({"next_text": F.lead("text").over(order), "next": F.lead("sketch").over(order)})
    following = following.filter("not guest")
    n_chars = F.length("text")
    taken = F.floor(n_chars / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), n_chars - taken)
    edited = F.concat(kept, F.substring("next_text", F.lit(1), taken))
    found = following.select(
        "row.doc_id", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next"
    ).withColumn("edited_sketch", sketch(F.col("edited")))
    own, changed = F.col("sketch"), F.col("edited_sketch")
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(changed).alias("edited_fingerprint"),
        resemblance(own, changed).alias("near_edited"),
        resemblance(own, F.col("next")).alias("near_next"),
        containment(own, changed).alias("kept_share"),
        distinct_shingles(own).alias("n_shingles"),
    )


_HASHED = f"substr(md5(array_to_string(list_slice(w, i + 1, i + {WORDS}), ' ')), 1, {DIGITS})"
_SKETCH = f"""CASE WHEN len(w) = 0 THEN [] ELSE list_slice(list_sort(list_distinct(
    list_transform(range(greatest(len(w) - {WORDS}, 0) + 1), lambda i: {_HASHED}))), 1, {SIZE}) END"""
OP11_SQL = f"""
WITH numbered AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
           row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS place, count(*) OVER () AS n_docs
    FROM documents
), edited AS (
    SELECT a.doc_id, a.text, a.n, a.place, a.n_docs,
           substr(a.text, 1, a.n - a.n // 3) || substr(b.text, 1, a.n // 3) AS edited
    FROM numbered a JOIN numbered b ON b.place = a.place % a.n_docs + 1
), words AS (
    SELECT place, 'own' AS kind, regexp_extract_all(text, '{WORD}') AS w FROM edited
    UNION ALL SELECT place, 'edited', regexp_extract_all(edited, '{WORD}') FROM edited
), sketches AS (
    SELECT place, kind, {_SKETCH} AS s FROM words
), three AS (
    SELECT e.*, a.s AS a, b.s AS b, c.s AS c
    FROM edited e JOIN sketches a ON a.place = e.place AND a.kind = 'own'
    JOIN sketches b ON b.place = e.place AND b.kind = 'edited'
    JOIN sketches c ON c.place = e.place % e.n_docs + 1 AND c.kind = 'own'
), unions AS (
    SELECT *, list_slice(list_sort(list_distinct(list_concat(a, b))), 1, {SIZE}) AS ab,
           list_slice(list_sort(list_distinct(list_concat(a, c))), 1, {SIZE}) AS ac
    FROM three
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint,
       array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(a, b), ab))::DOUBLE / len(ab) END AS near_edited,
       CASE WHEN len(ac) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(a, c), ac))::DOUBLE / len(ac) END AS near_next,
       CASE WHEN len(a) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect(a, ab)) > 0
            THEN len(list_intersect(list_intersect(a, ab), b))::DOUBLE / len(list_intersect(a, ab)) END AS kept_share,
       CASE WHEN len(a) < {SIZE} THEN len(a)::DOUBLE
            ELSE {SIZE - 1} / ((('0x' || substr(a[-1], 1, 13))::BIGINT::DOUBLE + 1) / {1 << 52}::DOUBLE) END AS n_shingles
FROM unions
"""
