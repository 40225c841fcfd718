"""Duplicates between sources, and ids that survive a reload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import norm
from ..functions.numbers import round2
from .joins import band_join, greedy_match


def keep_first(moves: DataFrame, order: str = "load_seq") -> DataFrame:
    """Of rows with equal origin, reference and type the first that was loaded; rows without reference all stay."""
    w = Window.partitionBy("origin", "ref", "type").orderBy(order)
    has = F.coalesce("ref", F.lit("")) != ""
    first = moves.filter(has).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return first.unionByName(moves.filter(~has))


def absorb_unreferenced(moves: DataFrame, window_ms: int = 60_000, order: str = "load_seq") -> DataFrame:
    """Drop rows without reference that repeat a referenced row of another source: same side, type,
    user and amount within a minute. Each referenced row absorbs one. Needs id, ms, source and ``order``."""
    has = F.coalesce("ref", F.lit("")) != ""
    keyed = moves.withColumns({"user": norm(F.col("party")), "cents": F.round(F.col("amount") * 100).cast("long")})
    side = lambda d, x: d.select("side", "type", "user", "cents", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "ms", "source", order)))
    pairs = band_join(side(keyed.filter(~has), "a"), side(keyed.filter(has), "b"), ["side", "type", "user", "cents"], "a_ms", "b_ms", window_ms, window_ms).filter("a_source <> b_source")
    taken = greedy_match(pairs, ["a_id", "b_id"], [F.col(c) for c in (f"a_{order}", "a_id", f"b_{order}", "b_id")], at="a_ms")
    return moves.join(taken.select(F.col("a_id").alias("id")), "id", "left_anti")


def stable_ids(moves: DataFrame, order: str = "seq") -> DataFrame:
    """Ids from origin, reference and type (or time, amount and party), with #2, #3 for repeats in order."""
    has = F.coalesce("ref", F.lit("")) != ""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = F.when(has, F.concat_ws("|", empty("origin"), "ref", "type")).otherwise(F.concat_ws("|", empty("origin"), F.col("ms").cast("string"), "type", F.format_string("%.2f", round2(F.col("amount"))), empty("party")))
    w = Window.partitionBy("__base").orderBy(order)
    n = F.row_number().over(w)
    return moves.withColumn("__base", base).withColumn("__n", n).withColumn("id", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat(F.col("__base"), F.lit("#"), F.col("__n").cast("string")))).drop("__base", "__n")
