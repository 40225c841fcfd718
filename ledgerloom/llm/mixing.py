"""Mixing sources to target weights by systematic sampling [native].

Every source gets a target number of words: its weight's share of all words, but at
most so many times its own size; what is above goes to the other sources by weight.
A document's expected copies are its source's target over the source's size.
Systematic sampling takes the prefix sums of expected copies within the source, adds
one random offset, and emits the document once for each whole number crossed. Documents
stand in order of size, so the words taken from a source differ from its target by
less than its longest document.

The prefix sums are distributed: rows are dealt by ranges of (source, size), each
partition is sorted, and a row's place is its place in the partition plus the
counts of the source's partitions before it. No source lies in one task. Only the table
of sources (one short row for each) is ordered by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Expected copies and offsets are whole numbers of this unit, so that prefix sums are exact.
UNIT = 10**12
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs without blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _offset(source: Column, seed: int) -> Column:
    """The random offset of a source below one copy, in UNITs: 32 bits of a digest of seed and source."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("decimal(10,0)") * F.lit(UNIT).cast("decimal(13,0)") / F.lit(1 << 32).cast("decimal(10,0)")).cast("decimal(13,0)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` of all words. A source
    whose part is above ``most`` times its size stops there; the excess goes to the others by weight until none is above.
    With parts in order of size over weight, those that stop are the first ones, so one pass over the sources settles it.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    order = (F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight")).withColumns({
        "left": total * F.lit(float(share)) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)),
        "heavy": F.sum("weight").over(after),
    })
    full = (F.col("source_size") * most).cast("double")
    # the first source that doesn't stop sets the words for each unit of weight
    rows = rows.withColumn("rate", F.col("left") / F.col("heavy")).withColumn("stops", full < F.col("rate") * F.col("weight"))
    rate = F.first(F.when(~F.col("stops"), F.struct("left", "heavy")), ignorenulls=True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("rest", rate)
    return rows.select("source", "source_size", F.when(F.col("stops") | F.col("rest").isNull(), full).otherwise(F.col("rest.left") * F.col("weight") / F.col("rest.heavy")).alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 13,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken, and the columns ``carry``.

    A null text has no words; a null source is a source of its own, last in order. Documents without words may get copies, which
    take no words. A source without words has target 0 and no copies. Ties in size go by a digest of the id, then by the id; repeated
    rows are documents of their own, of whom either may be the one taken. An empty table gives an empty table. Other columns are
    passed over. Neither partitions nor files change a result. For ``carry`` (columns of other names than the results'), a text's bytes move once.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *carry)
    slim = materialize(slim, "sizes")
    order = ("source", "size", "__h", "doc_id")
    keyed = slim.withColumn("__h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    # partition number and place within it; fixed once written
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).drop("__h")
    placed = materialize(placed, "placed").withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy("source", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"), F.sum("size").alias("__words"))
    parts = materialize(parts, "parts")
    earlier = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("__source"), F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    goals = targets(parts.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, share, most)
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0))
    goals = goals.select(F.col("source").alias("__name"), "source_size", "target", step.cast("decimal(16,0)").alias("__step"), _offset(F.col("source"), seed).alias("__offset"))
    starts = starts.join(goals, F.col("__source").eqNullSafe(F.col("__name")))
    place = (F.col("__at") + F.col("__shift")).cast("decimal(18,0)")
    crossed = lambda n: F.call_function("div", n * F.col("__step") + F.col("__offset"), F.lit(UNIT).cast("decimal(13,0)"))
    copies = crossed(place + 1) - crossed(place)
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("copies", copies.cast("int")).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies, with its number ``copy`` from 1."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 of their sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM s
), c AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h
  FROM o
), e AS (SELECT *, CAST(3 * source_size AS DOUBLE) < l / h * weight AS stops FROM c),
f AS (SELECT l AS fl, h AS fh FROM e WHERE NOT stops ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE) ELSE fl * weight / fh END AS target,
    CAST(floor(CAST(('0x' || substr(md5('13:' || coalesce(source, '')), 1, 8)) AS BIGINT)::HUGEINT * 1000000000000 // 4294967296) AS HUGEINT) AS shift
  FROM e LEFT JOIN f ON true
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1e12) AS HUGEINT) ELSE 0 END AS step FROM t
), n AS (
  SELECT doc_id, size, source_size, target, step, shift,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) AS HUGEINT) AS place
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(((place * step + shift) // 1000000000000 - ((place - 1) * step + shift) // 1000000000000) * size AS BIGINT) AS taken FROM n
"""

QUERIES = {"op13_mixing": op13_mixing}
ORACLES = {"op13_mixing": SQL}
