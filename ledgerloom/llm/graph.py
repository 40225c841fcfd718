"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges that a task of a round takes.
EDGES = 50_000


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they are stars: every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, bad = each.agg(F.sum("up"), F.count_if(F.col("up") + F.col("down") > F.when(F.col("up") > 0, 1).otherwise(F.col("down")))).first()
    return n or 0, not bad


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp) for every vertex of an edge: the smallest vertex it reaches.

    Alternates the two star operations: neighbours larger than a vertex, then its
    smaller ones and itself, are tied to the smallest of its neighbourhood, until
    only stars are left. Rounds are written to the shared folder, by as many tasks as their edges
    ask for. Loops and repeated edges do no harm; nulls are passed over. Edges that are
    stars already take no round.
    """
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    own = materialize(own, "edges")
    n, stars = _state(own)
    while not stars:
        tasks = -(-n // EDGES)
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().coalesce(tasks)
        own = materialize(small, "edges")
        n, stars = _state(own)
    return own.select(F.col("u").alias("v"), F.col("v").alias("comp")).unionByName(own.select("v", F.col("v").alias("comp")).distinct())
