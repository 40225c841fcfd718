"""Hard-negative mining by distributed radix selection.

For every anchor and window of scores, the best k rows are found without sorting
scores. Rows stand in blocks; each round, every block scores the open anchors by one matrix
product and counts, for each window, the rows by the next digit of their rank (the distance from
the window's top, then the id). The summed counts tell the bucket in which the k-th row
lies; the next round looks into that bucket alone. As soon as the rows up to the bucket are few, they alone
are gathered and ranked. A block sends its first buckets up to its own k-th row, never scores.

The same selection finds the positives (rows of the anchor's label, any score) and
the negatives (rows of other labels, scores within bounds set by each positive).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize, table
from .topk import _matrix, _products

#: Rows of a block, anchors scored at a time, bits of a digit, and gathered rows for each wanted one at most.
BLOCK, ANCHORS, DIGIT, SPARE = 8192, 256, 12, 4
#: Scores are held within this, so that distances fit in a long.
_MOST = 1 << 61
_SIGN = np.uint64(1 << 63)

_PACK = "block int, ids binary, labels binary, vecs binary"
_WINDOW = "struct<wid:long,lo:long,hi:long,tied:boolean,top:long,base:long,bits:int,need:long>"


def _pack(dim: int):
    """One row for each block: ids, labels, and vectors as a matrix of the narrowest exact floats."""

    def run(batches):
        held, at = [], None

        def packed():
            ids, labels, vecs = (np.concatenate(x) for x in zip(*held, strict=True))
            if np.abs(vecs).max(initial=0) < 1 << 24:
                vecs = vecs.astype("<f4")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, vecs))], names=["block", "ids", "labels", "vecs"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b <= a:
                    continue
                if held and block[a] != at:
                    yield packed()
                    held = []
                at = block[a]
                held.append((batch.column(1).slice(a, b - a).to_numpy().astype("<i8"), batch.column(2).slice(a, b - a).to_numpy().astype("<i8"), _matrix(batch.column(3).slice(a, b - a), dim)))
        if held:
            yield packed()

    return run


def _unpack(ids: bytes, labels: bytes, vecs: bytes, dim: int):
    ids = np.frombuffer(ids, "<i8")
    flat = np.frombuffer(vecs, "<f4" if len(vecs) == 4 * dim * len(ids) else "<f8")
    return ids, np.frombuffer(labels, "<i8"), flat.reshape(len(ids), dim).astype(np.float64)


def _ranks(ids: np.ndarray, least: int) -> np.ndarray:
    """Ids as unsigned numbers from 0 in their order."""
    return (ids.view(np.uint64) ^ _SIGN) - (np.int64(least).view(np.uint64) ^ _SIGN)


def _inside(w: dict, dist: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the window's current bucket, and their places in it."""
    if w["tied"]:
        rows = np.flatnonzero(dist == w["top"])
        place = rank[rows] - np.int64(w["base"]).view(np.uint64)
        ok = rank[rows] >= np.int64(w["base"]).view(np.uint64)
    else:
        place = dist - w["base"]
        rows = np.flatnonzero(place >= 0)
        place, ok = place[rows].astype(np.uint64), slice(None)
    rows, place = rows[ok], place[ok]
    if w["bits"] < 64:
        ok = place >> np.uint64(w["bits"]) == 0
        rows, place = rows[ok], place[ok]
    return rows, place


def _counts(w: dict, ids: np.ndarray, dist: np.ndarray, rank: np.ndarray):
    """(digit, rows) of the window's first buckets, up to this block's own last wanted row."""
    _, place = _inside(w, dist, rank)
    n = np.bincount((place >> np.uint64(max(0, w["bits"] - DIGIT))).astype(np.int64), minlength=1)
    last = np.searchsorted(np.cumsum(n), w["need"])
    digit = np.flatnonzero(n[: last + 1])
    return digit, n[digit]


def _gather(w: dict, ids: np.ndarray, dist: np.ndarray, rank: np.ndarray):
    """(id, distance) of the rows up to the end of the window's bucket."""
    rows, _ = _inside(w, dist, rank)
    if w["tied"]:
        base = np.int64(w["base"]).view(np.uint64)
        before = (dist < w["top"]) | (dist == w["top"]) & (rank < base)
    else:
        before = dist < w["base"]
    rows = np.concatenate([np.flatnonzero(before & (dist >= 0)), rows])
    return ids[rows], dist[rows]


def _over_blocks(each, same: bool, least: int, dim: int, names: tuple[str, str]):
    """Run ``each`` for all windows of all anchors that meet a block: (anchor, wid, x, y)."""

    def run(batches):
        ids = labels = vecs = rank = at = None
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b <= a:
                    continue
                if kind[a] == 0:
                    ids, labels, vecs = _unpack(*(batch.column(i)[a].as_py() for i in (2, 3, 4)), dim)
                    rank, at = _ranks(ids, least), block[a]
                    continue
                if block[a] != at:
                    continue
                for c in range(a, b, ANCHORS):
                    part = batch.slice(c, min(ANCHORS, b - c))
                    own, label = part.column(5).to_numpy(), part.column(6).to_numpy()
                    scores = np.clip(_products(_matrix(part.column(7), dim), vecs), -_MOST, _MOST)
                    out = []
                    for i, windows in enumerate(part.column(8).to_pylist()):
                        rows = np.flatnonzero(((labels == label[i]) == same) & (ids != own[i]))
                        score, name, place = scores[i, rows], ids[rows], rank[rows]
                        for w in windows:
                            fine = (score >= w["lo"]) & (score <= w["hi"])
                            x, y = each(w, name[fine], w["hi"] - score[fine], place[fine])
                            out.append((np.full(len(x), own[i]), np.full(len(x), w["wid"]), x, y))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in zip(*out, strict=True)], names=["anchor", "wid", *names])

    return run


def _meet(packs: DataFrame, anchors: DataFrame, windows: DataFrame, blocks: int) -> DataFrame:
    """Blocks and the anchors with open windows, each anchor before every block."""
    spark = packs.sparkSession
    own = windows.groupBy("anchor").agg(F.collect_list(F.struct("wid", "lo", "hi", "tied", "top", "base", "bits", "need")).alias("windows"))
    asked = anchors.join(own, F.col("id") == F.col("anchor")).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "vecs")), "id", "label", "vec", "windows",
    )
    held = packs.select("block", F.lit(0).alias("kind"), "ids", "labels", "vecs", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<double>").alias("vec"), F.lit(None).cast(f"array<{_WINDOW}>").alias("windows"))
    n = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return held.unionByName(asked).repartition(n, "block").sortWithinPartitions("block", "kind")


def select_best(packs: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, span: dict) -> DataFrame:
    """(anchor, wid, rank, id, score): the k rows of highest score (ties: smallest id) of each window.

    ``windows`` has (anchor, wid, lo, hi), hi >= lo. Digit by digit; a window is done when at most SPARE * k
    rows lie up to its bucket, when it has fewer than k rows, or when the key has no digits left.
    """
    blocks, dim, least, id_bits = span["blocks"], span["dim"], span["least"], span["id_bits"]
    none = F.lit(0).cast("long")
    open_ = windows.select("anchor", "wid", "lo", "hi", F.lit(False).alias("tied"), none.alias("top"), none.alias("base"), F.length(F.bin(F.col("hi") - F.col("lo"))).cast("int").alias("bits"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("done"))
    open_, ready = materialize(open_, "windows"), []
    while not open_.isEmpty():
        counted = in_arrow(_meet(packs, anchors, open_.drop("done"), blocks), _over_blocks(_counts, same, least, dim, ("digit", "n")), "anchor long, wid long, digit long, n long")
        counted = counted.groupBy("anchor", "wid", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("anchor", "wid").orderBy("digit"))
        # the bucket of the k-th row; where there are fewer rows there is none
        found = counted.select(F.col("anchor").alias("__a"), F.col("wid").alias("__w"), "digit", "n", upto.alias("upto"))
        # the bucket of the k-th row; where there are fewer rows there is none
        at = (F.col("anchor") == F.col("__a")) & (F.col("wid") == F.col("__w")) & (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))
        joined = open_.drop("done").join(found, at, "left")
        shift = F.greatest(F.col("bits") - DIGIT, F.lit(0))
        few = F.col("upto") + (k - F.col("need")) <= SPARE * k
        hit, ends = F.col("digit").isNotNull(), (shift == 0)
        base = F.col("base").bitwiseOR(F.call_function("shiftleft", F.col("digit"), shift.cast("int")))
        tie = hit & ends & ~F.col("tied") & ~few
        step = joined.select(
            "anchor", "wid", "lo", "hi",
            (F.col("tied") | tie).alias("tied"),
            F.when(tie, base).otherwise(F.col("top")).alias("top"),
            F.when(tie, F.lit(0)).when(hit, base).otherwise(F.col("base")).cast("long").alias("base"),
            F.when(tie, F.lit(id_bits)).when(hit, shift).otherwise(F.col("bits")).cast("int").alias("bits"),
            F.when(hit, F.col("need") - (F.col("upto") - F.col("n"))).otherwise(F.col("need")).cast("long").alias("need"),
            (~hit | few | (ends & F.col("tied"))).alias("done"),
        )
        step = materialize(step, "windows")
        ready.append(step.filter("done"))
        open_ = step.filter("NOT done")
    out = "anchor long, wid long, rank int, id long, score long"
    if not ready:
        return packs.sparkSession.createDataFrame([], out)
    done = ready[0]
    for more in ready[1:]:
        done = done.unionByName(more)
    rows = in_arrow(_meet(packs, anchors, done.drop("done"), blocks), _over_blocks(_gather, same, least, dim, ("id", "dist")), "anchor long, wid long, id long, dist long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "wid").orderBy("dist", "id")).cast("int")).filter(F.col("rank") <= k)
    tops = done.select(F.col("anchor").alias("__a"), F.col("wid").alias("__w"), "hi")
    return ranked.join(tops, (F.col("anchor") == F.col("__a")) & (F.col("wid") == F.col("__w"))).select("anchor", "wid", "rank", "id", (F.col("hi") - F.col("dist")).alias("score"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best other rows of its label; for each, the ``negatives`` best rows of other
    labels whose score lies between ``low`` and ``high`` hundredths of the positive's. Scores are inner products of floor(scale * x),
    exact whole numbers (held within 2^61); ties go to the smaller id, fewer rows give all. A positive of
    negative score has no window. Rows with a null id or label, a null vector, or null or non-finite components take no
    part; of rows that share an id, the one of the smallest (label, vector) counts. Shorter vectors are filled with zeros. An empty
    table gives none; other columns are passed over.
    """
    spark, x = vectors.sparkSession, F.col(embedding)
    mark = F.col("label") if label is None else label
    fine = x.isNotNull() & F.col(vec_id).isNotNull() & mark.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.filter(fine).select(
        F.col(vec_id).cast("long").alias("id"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.struct(mark.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("vec")).alias("row"),
    )
    rows = materialize(rows.groupBy("id").agg(F.max("anchor").alias("anchor"), F.min("row").alias("row")).select("id", "anchor", "row.label", "row.vec"), "vectors")
    squares = F.aggregate("vec", F.lit(0.0), lambda s, c: s + c * c)
    n, dim, least, most, widest = rows.agg(F.count("*"), F.max(F.size("vec")), F.min("id"), F.max("id"), F.max(squares)).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], empty)
    blocks, dim = -(-n // block), max(1, dim)
    span = {"blocks": blocks, "dim": dim, "least": least, "id_bits": max(1, (most - least).bit_length())}
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "label", "vec")
    parts = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packs = materialize(in_arrow(dealt.repartition(parts, "block").sortWithinPartitions("block", "id"), _pack(dim), _PACK), "blocks")
    anchors = materialize(rows.filter("anchor").select("id", "label", "vec"), "anchors")
    # no score is larger than the largest square of a length
    bound = int(min(widest * (1 + 1e-9) + 1, float(_MOST)))
    near = anchors.select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("wid"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    near = materialize(select_best(packs, anchors, near, positives, True, span), "positives")
    p = F.col("score")
    part = lambda c, extra: F.lit(c) * F.call_function("div", p, F.lit(100)) + F.call_function("div", F.lit(c) * (p % 100) + F.lit(extra), F.lit(100))
    windows = near.filter("score >= 0").select("anchor", F.col("id").alias("wid"), part(low, 99).cast("long").alias("lo"), part(high, 0).cast("long").alias("hi")).filter("hi >= lo")
    far = select_best(packs, anchors, windows, negatives, False, span)
    scores = near.select(F.col("anchor").alias("__a"), F.col("id").alias("__p"), F.col("score").alias("positive_score"))
    return far.join(scores, (F.col("anchor") == F.col("__a")) & (F.col("wid") == F.col("__p"))).select(
        F.col("anchor").alias("anchor_id"), F.col("wid").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, v.vec_id AS id, q.label = v.label AS same,
    CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

QUERIES = {"op11_negatives": op11_negatives}
ORACLES = {"op11_negatives": SQL}
