"""A quality classifier that learns from preference pairs (Bradley-Terry).

A document's score is linear in its features. The chance that a good document
is preferred to a bad one is the logistic function of the difference of their
scores; the weights minimise the logistic loss over such pairs. The score
above which a document counts as good is a quantile of the labelled scores: the
share of label 0 lies below it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_class, in_arrow, sliced, table
from .hashing import prefixes, spans

#: Labelled rows of each class that the classifier is fitted on, at most.
CLASS_ROWS = 10_000
#: Bytes of text whose features are computed together.
SLICE = 1 << 18
_SYMBOLS = [b for b in range(32, 127) if not chr(b).isalpha()]


def _per(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n).astype(np.float64)


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each owner."""
    order = np.lexsort((h, owner))
    o, h = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return _per(o[new], n)


def features(texts: list[str | None]) -> np.ndarray:
    """Shares of characters, words and lines that tell prose from junk: one row of numbers for each text.

    Null counts as empty. All texts are laid end to end, with a line end after each, and
    counted at once; bytes, words (between blanks) and lines carry the number of their text.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(raw)
    sizes = np.fromiter(map(len, raw), np.int64, n)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if n else np.zeros(0, np.uint8)
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256).astype(np.float64)
    counts[:, 10] -= 1  # the line ends put between the texts
    size = np.maximum(1, sizes)
    prefix = prefixes(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    of, length = owner[start], (end - start).astype(np.float64)
    words = _per(of, n)
    some = np.maximum(1, words)
    is_upper, is_lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    last = data[end - 1]
    odd = (last < 128) & ~(is_upper | is_lower)[end - 1] & (last != ord(".")) & (last != ord(","))
    up, low = (np.concatenate([[0], np.cumsum(x)]) for x in (is_upper, is_lower))
    loud = (up[end] > up[start]) & (low[end] == low[start]) & (length > 1)
    stop = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    lines = np.maximum(1, _per(owner[stop], n))
    mean = _per(of, n, length) / some
    spread = np.sqrt(np.maximum(0, _per(of, n, (length - mean[of]) ** 2) / some))
    upper, lower = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1)
    more = [
        upper / size, lower / size, counts[:, 128:].sum(1) / size, counts[:, :32].sum(1) / size,
        upper / np.maximum(1, upper + lower), _per(of[odd], n) / some, _per(of[loud], n) / some,
        _distinct(of, spans(prefix, start, end), n) / some, _distinct(owner[stop], spans(prefix, begin, stop), n) / lines,
        mean, spread, np.log1p(words), np.log1p(sizes / lines), (words == 0).astype(np.float64),
    ]
    return np.concatenate([np.sqrt(counts[:, _SYMBOLS] / size[:, None]), np.stack(more, 1)], axis=1)


def _slices(batch, at: int):
    """Pieces of a batch of about SLICE bytes of text each, as they are and as features."""
    lengths = pa.compute.binary_length(batch.column(at)).to_pylist()
    for a, b in sliced([range(x or 0) for x in lengths], SLICE):
        part = batch.slice(a, b - a)
        yield part, features(part.column(at).to_pylist())


class BradleyTerry:
    """Linear scores learned from preferences of label 1 over label 0."""

    def __init__(self, seed: int = 7, pairs: int = 40_000, steps: int = 400, rate: float = 0.3, ridge: float = 1e-4):
        self.seed, self.pairs, self.steps, self.rate, self.ridge = seed, pairs, steps, rate, ridge
        self.mean = self.scale = self.weights = None
        self.threshold, self.slope = 0.0, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> BradleyTerry:
        """weights: how many labelled rows each row of class 0 and of class 1 stands for."""
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return self  # nothing to prefer: every score is 0.5
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1.0
        z = self._standard(x)
        rng = np.random.default_rng(self.seed)
        d = z[rng.choice(good, self.pairs)] - z[rng.choice(bad, self.pairs)]
        w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            speed = 0.9 * speed + (d * p[:, None]).mean(0) - self.ridge * w
            w = w + self.rate * speed
        self.weights = w
        s, v = z @ w, np.where(y == 1, weights[1], weights[0])
        order = np.argsort(s, kind="stable")
        below = np.cumsum(v[order])
        k = int(np.searchsorted(below, v[y == 0].sum() * (1 - 1e-12)))
        self.threshold = float((s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)
        self.slope = 4.0 / max(1e-9, float(np.abs(s - self.threshold).mean()))
        return self

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        t = np.clip((self._standard(x) @ self.weights - self.threshold) * self.slope, -500, 500)
        return 1 / (1 + np.exp(-t))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", class_rows: int = CLASS_ROWS) -> BradleyTerry:
    """Fit on at most ``class_rows`` labelled ids of each class, those of the smallest
    hashes. Rows whose label is neither 0 nor 1 or whose id is null are passed over; of an id
    with several labels one counts, of an id with several texts the one with the smallest features. With
    no row of a class (so with an empty table too) every score is 0.5. The share of each class is
    counted over all labels. Other columns are passed over."""
    own = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).filter("__y in (0, 1) and __id is not null").groupBy("__id").agg(F.min("__y").alias("__y"))
    shares = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}
    by_hash = lambda y: own.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(class_rows)
    chosen = by_hash(0).unionByName(by_hash(1))

    def of(batches):
        for batch in batches:
            for part, x in _slices(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["__id", "__y", "x"])

    # 2 x class_rows ids at most are sent to all tasks, and as many rows come back
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__t")).join(F.broadcast(chosen), "__id").select("__id", "__y", "__t")
    kind = dict(rows.dtypes)["__id"]
    held = in_arrow(rows, of, f"__id {kind}, __y int, x array<double>").groupBy("__id", "__y").agg(F.min("x").alias("x")).collect()
    if not held:
        return BradleyTerry()
    held.sort(key=lambda r: r["__id"])
    y = np.array([r["__y"] for r in held])
    n = np.bincount(y, minlength=2)
    return BradleyTerry().fit(np.array([r["x"] for r in held]), y, tuple(shares.get(c, 0) / max(1, n[c]) for c in (0, 1)))


def score_quality(docs: DataFrame, model: BradleyTerry, text: str = "text", out: str = "score", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``out`` (0 to 1) for every whole text; null counts as empty.

    Only the text is an input, so equal texts score alike, repeated rows and ties too; all other
    columns (or those in ``columns``) stay, whatever their names, and one named ``out`` is replaced. An empty table gives no rows.
    Tasks hold a slice of SLICE bytes of text (or one longer text) at a time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if columns is None else columns) if c.lower() != out.lower()]
    n = len(names)
    once = text in names and dict(docs.dtypes)[text] == "string"  # the text goes to Python once
    own = docs.select(*(F.col(f"`{c}`") for c in names), *([] if once else [F.col(text).cast("string").alias(out)]))
    at = names.index(text) if once else n

    def score(batches):
        for batch in batches:
            for part, x in _slices(batch, at):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(sent.value.score(x))], names=[*names, out])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:n])
    return in_arrow(own, score, f"{fields}`{out}` double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_class("doc_id", 3) != 1)
    scored = score_quality(docs, fit_quality(docs, labels), columns=("doc_id",))
    return scored.select("doc_id", (crc_class("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
