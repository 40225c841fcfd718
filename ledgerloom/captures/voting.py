"""Several readings of one image: amounts by majority, and rows that the first reading lost.

Readings are rows (image, reading, row_no, name, type, amount); reading 0 is the base, the others are
re-readings at other scales. A row of the base is paired with the closest free row of each re-reading that has the
same type and a similar name, in the base's order. That is a greedy assignment in a total order, so it is
solved for all images at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import _MARKED, _PLAIN
from ..operators.joins import greedy_match
from ..storage import materialize

#: Letters of a name that are compared at most, and at least.
MOST, LEAST = 6, 4
#: Digits that a currency sign is misread as.
SIGN_DIGITS = "58"


def name_letters(name: Column) -> Column:
    """The first eight letters of a name, lower-cased, without marks."""
    plain = F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), _MARKED, _PLAIN), "[^A-Za-z]", "")
    return F.substring(F.lower(plain), 1, 8)


def alike(a: Column, b: Column) -> Column:
    """Whether two names' letters agree on all that both have (six at most, four at least), or are both empty."""
    n = F.least(F.length(a), F.length(b), F.lit(MOST))
    return ((a == "") & (b == "")) | ((n >= LEAST) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))


def _written(amount: Column) -> Column:
    """An amount as its digits, without zeros behind the point."""
    s = amount.cast("decimal(20,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")


def without_sign(amount: Column, others: Column) -> Column:
    """An amount that is another one with a 5 or 8 before it (a misread currency sign) is that other one."""
    text = _written(amount)

    def fits(u: Column) -> Column:
        other = _written(u)
        extra = F.length(text) - F.length(other)
        return (u != 0) & (u != amount) & (extra == 1) & F.substring(text, 1, 1).isin(*SIGN_DIGITS) & text.endswith(other)

    return F.coalesce(F.get(F.filter(others, fits), F.lit(0)), amount)


def vote(amounts: Column) -> Column:
    """(amount, doubtful) from the readings of one row, the base first.

    The amount that two readings at least share wins; a tie leaves the base's. What was changed, is tied or has
    no majority among three or more is doubtful. A single reading is left as it is. Zeros and nulls have no vote.
    """
    cast = F.filter(amounts, lambda m: m.isNotNull() & (m != 0))
    read = F.transform(cast, lambda m: without_sign(m, cast))
    # by votes, then by whose reading comes first
    tally = F.transform(F.array_distinct(read), lambda m: F.struct((-F.size(F.filter(read, lambda x: x == m))).alias("less"), F.array_position(read, m).alias("place"), m.alias("amount")))
    order = F.sort_array(tally)
    base, n = F.get(amounts, F.lit(0)), F.size(amounts)
    top, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    votes = -F.coalesce(top["less"], F.lit(0))
    tied = second["less"] == top["less"]
    win = (votes >= 2) & ~F.coalesce(tied, F.lit(False)) & ~top["amount"].eqNullSafe(base)
    unsure = F.coalesce(tied, F.lit(False)) | win | ((votes < 2) & (n >= 3))
    return F.struct(F.when((n >= 2) & win, top["amount"]).otherwise(base).alias("amount"), ((n >= 2) & unsure).alias("doubtful"))


def _side(rows: DataFrame, x: str) -> DataFrame:
    letters = name_letters(F.col("name"))
    return rows.select("image", *(F.col(c).alias(f"{x}_{c}") for c in ("reading", "row_no", "amount")), F.col("type"), letters.alias(f"{x}_name"), F.substring(letters, 1, LEAST).alias("start"))


def pair_readings(readings: DataFrame) -> DataFrame:
    """(image, reading, base_row, row_no, amount): the rows of re-readings that are rows of the base."""
    base, other = _side(readings.filter("reading = 0"), "a"), _side(readings.filter("reading > 0"), "b")
    pairs = base.join(other, ["image", "type", "start"]).filter(alike(F.col("a_name"), F.col("b_name")))
    # an end is a row of one image, for one re-reading
    end = lambda x: F.concat_ws("|", F.lit(x), "image", "b_reading", f"{x}_row_no")
    edges = pairs.select("image", "b_reading", "a_row_no", "b_row_no", "b_amount", end("a").alias("a_end"), end("b").alias("b_end"))
    order = [F.col("image"), F.col("b_reading"), F.col("a_row_no"), F.abs(F.col("a_row_no") - F.col("b_row_no")), F.col("b_row_no")]
    taken = greedy_match(edges, ["a_end", "b_end"], order, within=["image"])
    return taken.select("image", F.col("b_reading").alias("reading"), F.col("a_row_no").alias("base_row"), F.col("b_row_no").alias("row_no"), F.col("b_amount").alias("amount"))


def lost_rows(readings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows that readings 1 and 2 both have, with equal amounts, and the base has not: image, after, row_no, name, type, amount.

    ``after`` is the base row that they follow (-1: none). A row beside which the base has one of the same type and amount is that one, misread.
    """
    paired = pairs.select("image", "reading", "row_no", "base_row")
    free = readings.filter("reading in (1, 2)").join(paired, ["image", "reading", "row_no"], "left")
    unpaired = free.filter("base_row is null and amount <> 0")
    side = lambda k, x: _side(unpaired.filter(f"reading = {k}"), x).withColumn("amount", F.col(f"{x}_amount"))
    both = side(1, "a").join(side(2, "b"), ["image", "type", "start", "amount"]).filter(alike(F.col("a_name"), F.col("b_name")))
    end = lambda x: F.concat_ws("|", F.lit(x), "image", f"{x}_row_no")
    edges = both.select("image", "a_row_no", "b_row_no", end("a").alias("a_end"), end("b").alias("b_end"))
    same = greedy_match(edges, ["a_end", "b_end"], [F.col(c) for c in ("image", "a_row_no", "b_row_no")], within=["image"]).select("image", F.col("a_row_no").alias("row_no"))
    # the last row before it in its own reading that the base has
    before = F.last("base_row", ignorenulls=True).over(Window.partitionBy("image").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1))
    spots = free.filter("reading = 1").withColumn("after", F.coalesce(before, F.lit(-1))).join(same, ["image", "row_no"])
    base = readings.filter("reading = 0").select(F.col("image").alias("__i"), F.col("row_no").alias("__r"), F.col("type").alias("__t"), F.col("amount").alias("__a"))
    beside = (F.col("image") == F.col("__i")) & F.col("__r").isin(F.col("after"), F.col("after") + 1) & (F.col("type") == F.col("__t")) & (F.col("amount") == F.col("__a"))
    return spots.join(base, beside, "left_anti").select("image", "after", "row_no", "name", "type", "amount")


def vote_readings(readings: DataFrame) -> DataFrame:
    """image, place, name, type, amount, doubtful, added: the base with voted amounts, and the rows it lost after the rows they follow.

    Rows of a reading are numbered from 0 without gaps. ``place`` counts from 1 within the image. Images without a base give nothing but
    what readings 1 and 2 agree on. Null names count as empty; null amounts have no vote; an empty table gives none.
    """
    own = materialize(readings.select("image", "reading", "row_no", "name", "type", F.col("amount").cast("double").alias("amount")), "readings")
    pairs = materialize(pair_readings(own), "paired")
    votes = pairs.groupBy("image", F.col("base_row").alias("row_no")).agg(F.sort_array(F.collect_list(F.struct("reading", "amount"))).alias("read"))
    base = own.filter("reading = 0").join(votes, ["image", "row_no"], "left")
    amounts = F.concat(F.array("amount"), F.coalesce(F.col("read.amount"), F.array().cast("array<double>")))
    voted = base.withColumn("v", vote(amounts)).select("image", F.col("row_no").alias("after"), F.lit(-1).alias("row_no"), "name", "type", "v.amount", "v.doubtful", F.lit(False).alias("added"))
    lost = lost_rows(own, pairs).withColumns({"doubtful": F.lit(True), "added": F.lit(True)})
    every = reduce(DataFrame.unionByName, [voted, lost.select(*voted.columns)])
    place = F.row_number().over(Window.partitionBy("image").orderBy("after", "added", "row_no"))
    return every.select("image", place.alias("place"), "name", "type", "amount", "doubtful", "added")
