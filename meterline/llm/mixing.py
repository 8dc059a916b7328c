"""Mixing sources to target weights, with DataFrame functions only.

The words of a source are laid end to end in a shuffled order of its documents and cut into
blocks of equally many words. Every source gets as many slots as its target needs. The slots
are the points 0 .. N-1 of the van der Corput sequence: the sources divide the points by
cumulative weight, and the bits of a point, reversed, say when its turn comes, so that at any
time each source has had its share. A slot's rank among its source's slots, which names the
block that it takes, follows from the point by counting dyadic intervals; no sort or window
over a source's slots is needed. Prefix sums of words go by buckets of the shuffled order, so
no task holds a whole source.

Defined results: a null source is a source of its own, the last; null and empty texts have no
words, and are never taken; repeated rows are separate documents; equal shuffle keys are
ordered by document id and size, so that reruns agree; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterline.llm.common import n_words, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
#: The shuffled order of a source is cut into so many buckets (a power of two) for prefix sums.
BUCKETS = 1024
#: Slots that one task row spreads into.
SLOT_CHUNK = 1 << 16
SEED = "mix"


def _place(doc_id: Column) -> Column:
    """32 random bits for a document id; its place in the shuffled order."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _sized(row: str, names: tuple[str, str, str]) -> list[Column]:
    """Columns that place a document: ``row`` is "" or the name of the struct that holds it."""
    doc_id, source, text = (F.col(f"{row}`{name}`") for name in names)
    place = _place(doc_id)
    return [
        doc_id.alias("doc_id"),
        source.cast("string").alias("source"),
        n_words(text).alias("size"),
        place.alias("place"),
        F.floor(place * BUCKETS / 2**32).alias("bucket"),
    ]


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """A row per source: ``source_no``, ``target``, and its slots as an interval of points.

    ``sizes`` has a row per source. The sources capped at ``most`` times their size are those
    that come first by cap / weight; the others share what is left by weight. The table of
    sources is small, so windows over the whole of it are one short task.
    """
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") % len(weights)) + 1).cast("int"))
    named = sizes.select(
        "source",
        "source_size",
        (F.row_number().over(by_name) - 1).cast("long").alias("source_no"),
        F.sum("source_size").over(total).alias("words"),
    ).withColumn("weight", weight)
    cap = F.col("source_size") * most
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source_no"))
    upward = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    shared = (
        named.withColumn("ratio", cap / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum(cap).over(upward), F.lit(0)))
        .withColumn("level", (F.lit(share) * F.col("words") - F.col("capped")) / F.sum("weight").over(onward))
        .withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level")))
        .withColumn("first", F.min("fits").over(total))
        .withColumn(
            "target",
            F.when(
                F.struct("ratio", "source_no") >= F.struct("first.ratio", "first.source_no"),
                F.col("weight") * F.col("first.level"),
            ).otherwise(cap.cast("double")),
        )
    )
    whole = F.floor(F.least(F.col("target"), cap.cast("double"))).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    slots = F.expr(f"passes * n_blocks + ceil(rest / {BLOCK_WORDS})").cast("long")
    up_to = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        shared.withColumn("n_blocks", F.ceil(F.col("source_size") / BLOCK_WORDS))
        .withColumn("passes", F.floor(whole / size))
        .withColumn("rest", whole % size)
        .withColumn("n_slots", slots)
        .withColumn("last", F.sum("n_slots").over(up_to))
        .withColumn("points", F.sum("n_slots").over(total))
        .select(
            "source", "source_no", "source_size", "target", "n_blocks", "passes", "rest", "points",
            (F.col("last") - F.col("n_slots")).alias("begin"), F.col("last").alias("end"),
        )
    )


def schedule(sources: DataFrame) -> DataFrame:
    """A row per slot: its ``turn``, source, ``rank`` in the source, block, and words taken of it."""
    bits = F.length(F.bin(F.greatest(F.col("points") - 1, F.lit(1))))
    chunks = sources.filter("end > begin").select(
        "source_no", "source_size", "n_blocks", "passes", "rest", "begin", "end", bits.alias("bits"),
        F.expr(f"explode(sequence(begin div {SLOT_CHUNK}, (end - 1) div {SLOT_CHUNK}))").alias("chunk"),
    )
    # A number of partitions is given: by their bytes Spark would put all chunks into one task.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = chunks.repartition(tasks, "source_no", "chunk").withColumn(
        "point",
        F.expr(
            f"explode(sequence(greatest(begin, chunk * {SLOT_CHUNK}), "
            f"least(end, (chunk + 1) * {SLOT_CHUNK}) - 1))"
        ),
    )
    # Points of this source with an earlier turn. Earlier turns are those that agree with this
    # one down to a bit that is 1 here and 0 there: for bit j of the point they are the points
    # r, r + 2^(j+1), r + 2 * 2^(j+1), ... with r the bits of the point below j.
    below = (
        "greatest(0L, least(shiftright({x} - (point & (shiftleft(1L, j) - 1)) + shiftleft(1L, j + 1) - 1, j + 1),"
        " shiftleft(1L, bits - 1 - j)))"
    )
    rank = (
        "aggregate(sequence(0, bits - 1), 0L, (n, j) -> n + if(shiftright(point, j) & 1 = 1, "
        + below.format(x="end")
        + " - "
        + below.format(x="begin")
        + ", 0L))"
    )
    ranked = points.withColumn("rank", F.expr(rank)).withColumn("block", F.expr("rank % n_blocks"))
    whole = F.least(F.lit(BLOCK_WORDS), F.col("source_size") - F.col("block") * BLOCK_WORDS)
    left = F.greatest(F.lit(0), F.col("rest") - F.col("block") * BLOCK_WORDS)
    words = F.when(F.expr("rank div n_blocks") < F.col("passes"), whole).otherwise(F.least(whole, left))
    turn = F.conv(F.reverse(F.lpad(F.bin("point"), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    return ranked.select(turn.alias("turn"), "source_no", "rank", "block", words.cast("long").alias("words"))


class Mix:
    """The mix of a table of documents: its sources, its schedule, and its documents in place."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text"):
        """Reads the documents once for their sizes, which are stored without the texts."""
        self.docs, self.names = docs, (doc_id, source, text)
        self.sized = stored(docs.select(*_sized("", self.names)), "mix-sizes")
        parts = self.sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        self.parts = stored(parts, "mix-buckets")
        sizes = self.parts.groupBy("source").agg(F.sum("words").alias("source_size"))
        self.sources = stored(targets(sizes), "mix-sources")
        self.slots = schedule(self.sources)

    def placed(self, rows: DataFrame | None = None) -> DataFrame:
        """Documents with ``at``, the place of their first word among the words of their source.

        ``rows`` are the sized documents, possibly with more columns.
        """
        numbers = self.sources.select("source", "source_no", "source_size", "target")
        earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        same = lambda left: left["source"].eqNullSafe(numbers["source"])
        starts = (
            self.parts.join(numbers, same(self.parts))
            .select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
        )
        rows = self.sized if rows is None else rows
        rows = rows.join(numbers, same(rows)).drop(numbers["source"])
        order = Window.partitionBy("source_no", "bucket").orderBy("place", "doc_id", "size")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return (
            rows.join(starts, ["source_no", "bucket"])
            .withColumn("number", F.row_number().over(order))
            .withColumn("at", F.col("start") + before)
            .drop("start", "place")
        )

    def pieces(self) -> DataFrame:
        """Each slot's parts of documents: words ``first`` to before ``last`` of the document.

        A document no part of which is taken has one row with a null turn.
        """
        last = F.col("at") + F.col("size") - 1
        blocks = F.when(F.col("size") > 0, F.expr(f"sequence(at div {BLOCK_WORDS}, (at + size - 1) div {BLOCK_WORDS})"))
        parts = self.placed().withColumn("block", F.explode_outer(blocks))
        # Slots grow with the words; Spark's guess of their size would broadcast them.
        joined = parts.join(self.slots.hint("merge"), ["source_no", "block"], "left")
        begin = F.col("block") * BLOCK_WORDS
        first = F.greatest(F.lit(0), begin - F.col("at"))
        end = F.when(F.col("turn").isNotNull(), F.least(last + 1, begin + F.col("words")) - F.col("at"))
        return joined.withColumn("first", first).withColumn("last", F.greatest(first, end))

    def documents(self) -> DataFrame:
        """Whole documents, each as often as the schedule takes its first word, columns unchanged."""
        row = F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("row")
        carried = self.docs.select(row).select("row", *_sized("row.", self.names))
        here = self.placed(carried).withColumn("block", F.expr(f"at div {BLOCK_WORDS}")).filter("size > 0")
        slots = self.slots.select("source_no", "block", "words").hint("merge")
        taken = here.join(slots, ["source_no", "block"])
        first_word = F.col("at") - F.col("block") * BLOCK_WORDS
        names = [F.col(f"row.`{c}`").alias(c) for c in self.docs.columns]
        return taken.filter(F.col("words") > first_word).select(*names)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    mix = Mix(table(spark, sf_dir, "documents"))
    taken = F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0))
    key = ("source_no", "bucket", "number", "doc_id", "size", "source_size", "target")
    by_row = mix.pieces().groupBy(*key)
    return by_row.agg(taken.alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
    FROM documents
), placed AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word
    FROM sized
), named AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no, sum(source_size) OVER () AS words
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), weighted AS (
    SELECT *, [3, 1, 2][source_no % 3 + 1] AS weight, {MOST} * source_size / weight AS ratio FROM named
), levels AS (
    SELECT *, ({SHARE}::DOUBLE * words - coalesce(sum({MOST} * source_size) OVER (ORDER BY ratio, source_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY ratio, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighted
), targets AS (
    SELECT source, source_size,
           CASE WHEN levels.ratio > f.ratio OR (levels.ratio = f.ratio AND levels.source_no >= f.source_no)
           THEN weight * f.level ELSE ({MOST} * source_size)::DOUBLE END AS target
    FROM levels CROSS JOIN (SELECT ratio, source_no, level FROM levels WHERE level <= ratio ORDER BY ALL LIMIT 1) f
), whole AS (
    SELECT *, floor(least(target, ({MOST} * source_size)::DOUBLE))::BIGINT AS goal FROM targets
)
SELECT doc_id, size, source_size, target,
       (goal // greatest(source_size, 1) * size
        + greatest(0, least(first_word + size, goal % greatest(source_size, 1)) - first_word))::BIGINT AS taken
FROM placed JOIN whole ON placed.source IS NOT DISTINCT FROM whole.source
"""
