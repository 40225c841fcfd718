"""Images that overlap because a list was scrolled are put together, so that each row counts once.

Rows are (batch, document, image_no, row_no) and what tells them apart: day, clock, name, type, amount,
reference. Images of one document (its pages) are in order, and each is tied to the one before it; loose images
(``document`` is null) may follow one another in any order.

An overlap is found by the hashes of an image's first and last k rows: equal hashes of equal k meet in an
equi-join, so images that share nothing never meet. Loose images are chained greedily, the largest
overlap first; all overlaps that come first at both of their ends are taken at once, and where these close a
circle, its last one gives way. That equals taking them one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_key
from ..storage import materialize

IMAGE = ("batch", "document", "image_no")


def row_key() -> Column:
    """What makes two rows the same movement: the reference; else day, clock, type and amount; without a clock the name instead."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return (
        F.when(text("ref") != "", F.concat_ws("|", F.lit("ref"), "ref"))
        .when(text("clock") != "", F.concat_ws("|", text("day"), "clock", text("type"), text("amount")))
        .otherwise(F.concat_ws("|", text("day"), text("type"), text("amount"), name_key(F.col("name"))))
    )


def images(rows: DataFrame) -> DataFrame:
    """One row per image: its row keys in order. Images hold a screen of rows, so the arrays are short."""
    keyed = rows.groupBy(*IMAGE).agg(F.sort_array(F.collect_list(F.struct("row_no", row_key().alias("key")))).alias("r"))
    return keyed.select(*IMAGE, F.col("r.key").alias("keys"), F.size("r").alias("n"))


def overlap(a: Column, b: Column) -> Column:
    """The largest k for which the last k of ``a`` are the first k of ``b``; 0 if there is none."""
    k = F.sequence(F.lit(1), F.least(F.size(a), F.size(b)))
    fits = F.filter(k, lambda i: F.slice(a, F.size(a) - i + 1, i) == F.slice(b, F.lit(1), i))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0)


def page_cuts(pages: DataFrame) -> DataFrame:
    """(batch, document, image_no, head, tail): rows that a page repeats of the page before it, at its head (scrolled down) or its tail (up)."""
    before = F.lag("keys").over(Window.partitionBy("batch", "document").orderBy("image_no"))
    down = overlap(F.col("prev"), F.col("keys"))
    got = pages.withColumn("prev", before).withColumn("head", F.when(F.col("prev").isNull(), 0).otherwise(down))
    up = F.when((F.col("head") > 0) | F.col("prev").isNull(), 0).otherwise(overlap(F.col("keys"), F.col("prev")))
    return got.select(*IMAGE, "head", up.alias("tail"))


def image_overlaps(loose: DataFrame) -> DataFrame:
    """(batch, a, b, k): the largest k for which image a ends as image b of its batch begins."""
    k = loose.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    mark = lambda part: F.sha2(F.array_join(part, "\n"), 256)
    ends = k.select("batch", "k", F.col("image_no").alias("a"), mark(F.slice("keys", F.col("n") - F.col("k") + 1, F.col("k"))).alias("mark"))
    heads = k.select("batch", "k", F.col("image_no").alias("b"), mark(F.slice("keys", F.lit(1), F.col("k"))).alias("mark"))
    return ends.join(heads, ["batch", "k", "mark"]).filter("a <> b").groupBy("batch", "a", "b").agg(F.max("k").alias("k"))


def follow(links: DataFrame) -> DataFrame:
    """(batch, node, head, depth, worst, circle) for links (batch, a, b, rank), each node once as a and once as b at most.

    ``node`` is b; ``head`` is where its chain begins, ``depth`` links before it. On a circle ``circle`` is true and
    ``worst`` its greatest rank. Every round doubles the steps taken, so it ends after the logarithm of the longest chain.
    """
    now = materialize(links.select("batch", F.col("b").alias("node"), F.col("a").alias("head"), F.lit(1).alias("depth"), F.col("rank").alias("worst"), F.lit(True).alias("circle")), "follow")
    # a circle can't be longer than the links of its batch
    most, step = now.groupBy("batch").count().agg(F.max("count")).first()[0] or 0, 1
    while step <= 2 * most and not now.filter("circle").isEmpty():
        on = now.select(F.col("batch").alias("__b"), F.col("node").alias("__n"), F.col("head").alias("__h"), F.col("depth").alias("__d"), F.col("worst").alias("__w"))
        joined = now.join(on, (F.col("batch") == F.col("__b")) & (F.col("head") == F.col("__n")), "left")
        now = joined.select(
            "batch", "node", F.coalesce("__h", "head").alias("head"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"),
            F.greatest("worst", "__w").alias("worst"), F.col("__h").isNotNull().alias("circle"),
        )
        now, step = materialize(now, "follow"), 2 * step
    return now


def chain(edges: DataFrame) -> DataFrame:
    """The overlaps (batch, a, b, k) that stand: each image ends one and begins one at most, largest k first,
    ties to the smaller a, then b; none that would close a circle."""
    left = materialize(edges.select("batch", "a", "b", "k", F.struct((-F.col("k")).alias("k"), "a", "b").alias("rank")), "overlaps")
    taken = left.limit(0)
    while not left.isEmpty():
        first = lambda end: left.groupBy("batch", end).agg(F.min("rank").alias(f"first_{end}"))  # noqa: E731, B023
        won = left.join(first("a"), ["batch", "a"]).join(first("b"), ["batch", "b"]).filter("rank = first_a and rank = first_b").select(*left.columns)
        both = materialize(taken.unionByName(won), "links")
        chains = follow(both)
        bad = chains.filter("circle").select("batch", F.col("worst").alias("rank")).distinct()
        taken = materialize(both.join(bad, ["batch", "rank"], "left_anti").select(*left.columns), "links")
        # a circle that lost its last link is a chain from that link's b on
        chains = materialize(follow(taken), "chains")
        gone = left.join(both.select("batch", "rank"), ["batch", "rank"], "left_anti")
        for end in ("a", "b"):
            gone = gone.join(taken.select("batch", end), ["batch", end], "left_anti")
        own = chains.select("batch", F.col("node").alias("a"), F.col("head").alias("b"))  # from a chain's end to its head
        left = materialize(gone.join(own, ["batch", "a", "b"], "left_anti").select(*left.columns), "overlaps")
    return taken


def stitch(rows: DataFrame) -> DataFrame:
    """The rows that stay, with ``chain`` (the image that begins it) and ``place`` (images before it in the chain).

    A row that an image repeats of another is dropped from the later of the two; rows repeated within one image stay.
    Batches are apart; nulls in what tells rows apart count as empty. An empty table gives none. Other columns stay.
    """
    every = materialize(images(rows), "images")
    pages = page_cuts(every.filter(F.col("document").isNotNull())).select(*IMAGE, "head", "tail", F.lit(None).cast("long").alias("chain"), F.lit(None).cast("long").alias("place"))
    loose = every.filter(F.col("document").isNull())
    links = chain(image_overlaps(loose))
    ends = follow(links).select("batch", F.col("node").alias("image_no"), F.col("head").cast("long").alias("chain"), F.col("depth").cast("long").alias("place"))
    heads = links.select("batch", F.col("b").alias("image_no"), F.col("k").alias("head"))
    cuts = loose.select(*IMAGE).join(heads, ["batch", "image_no"], "left").join(ends, ["batch", "image_no"], "left")
    cuts = cuts.select(*IMAGE, F.coalesce("head", F.lit(0)).alias("head"), F.lit(0).alias("tail"), F.coalesce("chain", F.col("image_no").cast("long")).alias("chain"), F.coalesce("place", F.lit(0)).cast("long").alias("place"))
    cuts = cuts.unionByName(pages.withColumns({"chain": F.lit(0).cast("long"), "place": F.col("image_no").cast("long")}))
    cuts = cuts.withColumnsRenamed({"batch": "__b", "document": "__d", "image_no": "__i", "head": "__head", "tail": "__tail"})
    of = Window.partitionBy(*IMAGE)
    placed = rows.withColumns({"__r": F.row_number().over(of.orderBy("row_no")), "__n": F.count("*").over(of)})
    same = F.col("batch").eqNullSafe(F.col("__b")) & F.col("document").eqNullSafe(F.col("__d")) & (F.col("image_no") == F.col("__i"))
    kept = placed.join(cuts, same).filter((F.col("__r") > F.col("__head")) & (F.col("__r") <= F.col("__n") - F.col("__tail")))
    return kept.select(*rows.columns, "chain", "place")


def removed(rows: DataFrame, stitched: DataFrame) -> DataFrame:
    """(batch, n_rows, n_kept, n_removed): how many rows of each batch were repeats."""
    kept = stitched.groupBy("batch").agg(F.count("*").alias("n_kept"))
    full = rows.groupBy("batch").agg(F.count("*").alias("n_rows")).join(kept, "batch", "left")
    return full.select("batch", "n_rows", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), (F.col("n_rows") - F.coalesce("n_kept", F.lit(0))).alias("n_removed"))
