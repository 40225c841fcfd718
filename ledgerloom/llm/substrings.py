"""Removal of repeated byte strings by bucket-pointer refinement.

A string of ``length`` bytes is a repeat if it also starts earlier. Positions are
sorted into buckets that are refined until they stand for strings of that
length, in the order of what is known about later and earlier offsets:

1. Every string has an anchor, its q-gram with the smallest hash (the last of
   equals). Anchors are the initial buckets: q-grams, about one in forty positions.
   An anchor that is alone in its bucket ends all strings that it stands for.
2. An anchor's pointer into the bucket of its context, all bytes of the strings it
   stands for, refines its bucket. All but the first of equal contexts are repeats
   as they are, and need no further sorting.
3. The firsts of different contexts in one q-gram bucket are refined by later offsets:
   an anchor's strings are cut into slots by their distance from the anchor. A slot's bucket
   is the core that all strings in the slot share, its context all their bytes. Again
   a core that is alone ends the slot, and equal contexts are repeats.
4. What is still open is refined once more, by the bucket of each single string.

Buckets are 64-bit hashes of the bytes, so refinement is sorting by bucket
numbers. Tasks send the first of each bucket only, with its followers packed
along, so a bucket gets at most one row from each slice of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, in_arrow, materialize, sliced, table
from .hashing import mix, prefixes, spans

#: Bytes of the initial buckets' q-grams.
Q = 24
#: Strings in a slot of the second refinement.
SLOT = 16
#: ``count`` holds the number of strings and, above 16 bits, the anchor's distance from the first.
_ROWS = "g long, c long, id long, at long, count int, followers binary, body binary"
_MARKS = "id long, at long, count int, open boolean, body binary"
_FOLLOWER = np.dtype([("id", "<i8"), ("at", "<i8"), ("count", "<i4")])


def _sliding_last_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the smallest of ``width`` values, the last of equals."""
    value, at, span = h, np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        right, left = value[step:], value[: len(value) - step]
        take = right <= left
        at = np.where(take, at[step:], at[: len(at) - step])
        value = np.where(take, right, left)
        span += step
    return at


class Slice:
    """Some documents' bytes in one array, with their prefix hashes."""

    def __init__(self, texts: list):
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.prefix = prefixes(self.data)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Documents of positions (empty ones never own a position)."""
        return np.searchsorted(self.first + self.sizes, at, side="right")

    def anchors(self, length: int):
        """q-gram bucket, context bucket, first start and number of starts of each anchor, by document."""
        n = len(self.data)
        if n < length:
            return [np.zeros(0, np.int64)] * 5
        grams = np.arange(n - Q + 1)
        h = spans(self.prefix, grams, grams + Q)
        best = _sliding_last_min(h, length - Q + 1)[: n - length + 1]
        inside = np.zeros(n + 1, np.int64)
        long = self.sizes >= length
        np.add.at(inside, self.first[long], 1)
        np.add.at(inside, (self.first + self.sizes - length + 1)[long], -1)
        start = np.flatnonzero(np.cumsum(inside[: n - length + 1]) > 0)
        if not len(start):
            return [np.zeros(0, np.int64)] * 5
        a = best[start]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)])
        low = start[new]
        count = np.diff(np.append(np.flatnonzero(new), len(start)))
        anchor = a[new]
        c = mix(spans(self.prefix, low, low + count - 1 + length) + (anchor - low).astype(np.uint64), 9)
        return h[anchor], c, low, count | (anchor - low) << 16, self.owner(low)


def _leaders(g, c, ids, at, count, bodies=None):
    """A batch of the first of each (g, c) by (id, at), the others packed as its followers; bodies: start and data of each row's bytes."""
    order = np.lexsort((at, ids, c, g))
    g, c, ids, at, count = g[order], c[order], ids[order], at[order], count[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    lead = np.flatnonzero(new)
    head = lead[np.cumsum(new) - 1]
    same = ~new & (ids == ids[head]) & (at == at[head])  # a repeated row
    follow = ~new & ~same
    packed = np.zeros(int(follow.sum()), _FOLLOWER)
    packed["id"], packed["at"], packed["count"] = ids[follow], at[follow], count[follow]
    blob, size = packed.tobytes(), _FOLLOWER.itemsize
    ends = np.cumsum(follow)[np.append(lead[1:], len(g)) - 1] * size if len(g) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    followers = [blob[a:b] if b > a else None for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    body = [None] * len(lead)
    if bodies is not None:
        low, high, data = bodies
        low, high, raw = low[order][lead].tolist(), high[order][lead].tolist(), data.tobytes()
        body = [raw[a:b] for a, b in zip(low, high, strict=True)]
    view = lambda x: pa.array(x[lead].view(np.int64))
    return pa.RecordBatch.from_arrays([view(g), view(c), pa.array(ids[lead]), pa.array(at[lead]), pa.array(count[lead].astype(np.int32)), pa.array(followers, pa.binary()), pa.array(body, pa.binary())], names=["g", "c", "id", "at", "count", "followers", "body"])


def _slices(batch, size: int = SLICE):
    lengths = pa.compute.binary_length(batch.column(1)).to_pylist()
    for a, b in sliced([range(n or 0) for n in lengths], size):
        yield batch.slice(a, b - a)


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                s = Slice(part.column(1).to_pylist())
                g, c, low, count, owner = s.anchors(length)
                if len(low):
                    yield _leaders(g, c, part.column(0).to_numpy()[owner], low - s.first[owner], count)

    return run


def _pressed(batches):
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in _slices(batch, 4 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([press.compress((t or "").encode("utf-8", "replace")) for t in part.column(1).to_pylist()], pa.binary())], names=["id", "z"])


def _texts(column) -> list[bytes]:
    return [zstandard.ZstdDecompressor().decompress(z) for z in column.to_pylist()]


def _slot_rows(length: int):
    """The slots of a document's open anchors, with their bytes."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                s = Slice(_texts(part.column(1)))
                n = pa.compute.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                flat = part.column(2).flatten()
                low, count = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)
                reach, count = count >> 16, count & 0xFFFF
                owner = np.repeat(np.arange(len(n)), n)
                # the distances from the anchor run from reach down; slots are cut by distance
                ok = low + count - 1 + length <= s.sizes[owner]
                low, count, reach, owner = low[ok], count[ok], reach[ok], owner[ok]
                top, bottom = reach // SLOT, (reach - count + 1) // SLOT
                times = top - bottom + 1
                k = np.repeat(np.arange(len(low)), times)
                slot = top[k] - (np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times))
                far, close = np.minimum(reach[k], slot * SLOT + SLOT - 1), np.maximum((reach - count + 1)[k], slot * SLOT)
                who = owner[k]
                anchor = low[k] + reach[k] + s.first[who]
                first, last = anchor - far, anchor - close
                core = spans(s.prefix, anchor - slot * SLOT, anchor - slot * SLOT - SLOT + 1 + length)
                g = mix(core + slot.astype(np.uint64), 10)
                c = mix(spans(s.prefix, first, last + length) + far.astype(np.uint64), 11)
                if len(g):
                    yield _leaders(g, c, part.column(0).to_numpy()[who], first - s.first[who], last - first + 1, (first, last + length, s.data))

    return run


def _string_rows(length: int):
    """The single strings of open slots, each a bucket of its own."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                s = Slice(part.column("body").to_pylist())
                count = part.column("count").to_numpy().astype(np.int64)
                who = np.repeat(np.arange(len(count)), count)
                j = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                if len(who):
                    h = spans(s.prefix, j + s.first[who], j + s.first[who] + length)
                    yield _leaders(h, h, part.column("id").to_numpy()[who], part.column("at").to_numpy()[who] + j, np.ones(len(who), np.int64))

    return run


def _refine(batches):
    """Rows sorted by g, c, id, at: what is a repeat, and what has to be refined further.

    Keeps one row in hand, however large a bucket is: the first of a q-gram's
    first context, which is open only if another context follows.
    """
    group = context = None
    first = (0, 0)
    waiting = None  # (id, at, count, body) of the bucket's first row while it is alone
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g, c, ids, at, count = (batch.column(i).to_numpy() for i in range(5))
        new_g = np.concatenate([[group is None or g[0] != group], g[1:] != g[:-1]])
        new_c = new_g | np.concatenate([[context is None or c[0] != context], c[1:] != c[:-1]])
        out, bodies, body = [], [], batch.column(6)
        head = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
        hid, hat = np.where(head >= 0, ids[head], first[0]), np.where(head >= 0, at[head], first[1])
        # firsts of second and further contexts are open, and so is the first of the first
        further = np.flatnonzero(new_c & ~new_g)
        start = np.maximum.accumulate(np.where(new_g, np.arange(n), -1))
        lead = np.unique(start[further])
        if len(lead) and lead[0] < 0:
            if waiting is not None:
                out.append(tuple(np.array([x]) for x in waiting[:3]) + (np.ones(1, bool),))
                bodies.append(waiting[3])
            waiting, lead = None, lead[1:]
        opened = np.concatenate([further, lead])
        out.append((ids[opened], at[opened], count[opened], np.ones(len(opened), bool)))
        bodies += body.take(pa.array(opened)).to_pylist()
        last = start[-1]
        if last >= 0:
            waiting = None if len(lead) and lead[-1] == last else (ids[last], at[last], count[last], body[int(last)].as_py())
        repeat = ~new_c & ((ids != hid) | (at != hat))
        out.append((ids[repeat], at[repeat], count[repeat], np.zeros(int(repeat.sum()), bool)))
        group, context, first = g[-1], c[-1], (hid[-1], hat[-1])
        blobs = b"".join(x for x in batch.column(5).to_pylist() if x)
        if blobs:
            f = np.frombuffer(blobs, _FOLLOWER)
            out.append((f["id"], f["at"], f["count"], np.zeros(len(f), bool)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        kinds = (np.int64, np.int64, np.int32, bool)
        bodies += [None] * (len(cols[0]) - len(bodies))
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(k)) for x, k in zip(cols, kinds, strict=True)), pa.array(bodies, pa.binary())], names=["id", "at", "count", "open", "body"])


def covered(size: int, marks: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` bytes lie in a repeat; marks: rows of first start and number of starts."""
    edge = np.zeros(size + 1, np.int64)
    if len(marks):
        np.add.at(edge, np.minimum(marks[:, 0], size), 1)
        np.add.at(edge, np.minimum(marks[:, 0] + (marks[:, 1] & 0xFFFF) - 1 + length, size), -1)
    return np.cumsum(edge[:size]) > 0


def _cut(length: int, characters: bool):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                kept, sizes, removed, runs, where = [], [], [], [], []
                n = pa.compute.list_value_length(part.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.column(2).flatten()
                all_marks = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)], 1)
                ends = np.cumsum(n)
                for i, raw in enumerate(_texts(part.column(1))):
                    marks = all_marks[ends[i] - n[i] : ends[i]]
                    gone = covered(len(raw), marks, length)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    sizes.append(len(raw))
                    removed.append(int(gone.sum()))
                    runs.append(len(edge) // 2)
                    where.append([{"from": int(a), "to": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(edge) else raw)
                kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k.decode("utf-8", "ignore") for k in kept] if characters else kept, pa.string() if characters else pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(where, kind)], names=["id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    return run


def with_keys(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id", unique: bool = False) -> tuple[DataFrame, int]:
    """``docs`` with the column ``key``: the id, and for each row without one (with ``unique`` also each
    row of an id that several rows have) a number of its own below all ids, in the order of the texts' hashes;
    and the first number above those.

    Such rows are numbered from -2^63 on; an id that lies among these numbers raises an error.
    """
    least, id_ = -(1 << 63), F.col(doc_id).cast("long")
    named, nameless = docs.filter(id_.isNotNull()), docs.filter(id_.isNull())
    if unique:
        repeated = named.groupBy(id_.alias("__again")).count().filter("count > 1").select("__again")
        if not repeated.isEmpty():
            again = named.join(repeated, id_ == F.col("__again"), "left_semi")
            named, nameless = named.join(repeated, id_ == F.col("__again"), "left_anti"), nameless.unionByName(again)
    if nameless.isEmpty():
        return docs.withColumn(key, id_), least
    # equal texts are spread over tasks by the random number, which of them is first makes no difference
    sort = (F.xxhash64(F.col(text).cast("string")), F.rand(7))
    nameless = materialize(nameless.orderBy(*sort).withColumn(key, F.monotonically_increasing_id()), "rows-without-id")
    part, total, before = F.shiftright(key, 33), 0, []
    for k, n in sorted(tuple(r) for r in nameless.groupBy(part).count().collect()):
        before += [F.lit(k), F.lit(least + total)]
        total += n
    if (low := named.agg(F.min(id_)).first()[0]) is not None and low < least + total:
        raise ValueError(f"ids must not lie below {least + total}, where rows without an id are numbered")
    own = F.create_map(*before)[part] + F.col(key).bitwiseAND(F.lit((1 << 33) - 1))
    return named.withColumn(key, id_).unionByName(nameless.withColumn(key, own)), least + total


def remove_repeats(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", characters: bool = False, keyed: bool = False) -> DataFrame:
    """doc_id, kept (bytes; with ``characters`` text, without what a cut leaves of a character), n_bytes, n_removed, n_spans, spans (byte ranges): each text as
    UTF-8 without the bytes covered by a string of ``length`` bytes that also starts
    earlier (smaller doc_id, or the same and an earlier start). Strings don't cross documents and
    are judged on the input; overlaps count.

    Null and empty texts stay empty. Every row is a document of its own: rows without an id, and rows whose id others have too, come before all others,
    in the order of their texts' hashes, and keep their ids. ``keyed``: ids are known to be unique, so none are looked for that repeat. Other
    columns are passed over, an empty table gives no rows. ``length`` lies between 2 * Q and 30,000.
    """
    if not 2 * Q <= length <= 30_000:
        raise ValueError(f"length must lie between {2 * Q} and 30000")
    own, first = with_keys(docs.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).cast("string").alias("__t")), "id", "__t", "__doc", unique=not keyed)
    numbered = own.filter(F.col("id") < first).select("id", "__doc") if first > -(1 << 63) else None
    own = own.select("id", "__t")
    sort = lambda rows: in_arrow(rows.repartition("g").sortWithinPartitions("g", "c", "id", "at"), _refine, _MARKS)
    marks = materialize(sort(in_arrow(own, _anchor_rows(length), _ROWS)), "anchors")
    opened = marks.filter("open").groupBy("id").agg(F.collect_list(F.struct("at", "count")).alias("open"))
    pressed = in_arrow(own, _pressed, "id long, z binary")
    slots = sort(in_arrow(pressed.join(opened, "id").select("id", "z", "open"), _slot_rows(length), _ROWS))
    strings = sort(in_arrow(slots.filter("open").select("id", "at", "count", "body"), _string_rows(length), _ROWS))
    closed = lambda m: m.filter("not open").select("id", "at", "count")
    repeats = closed(marks).unionByName(closed(slots)).unionByName(closed(strings))
    by_doc = repeats.groupBy("id").agg(F.collect_list(F.struct("at", "count")).alias("marks"))
    full = pressed.join(by_doc, "id", "left")
    cut = in_arrow(full.select("id", "z", "marks"), _cut(length, characters), f"id long, kept {'string' if characters else 'binary'}, n_bytes long, n_removed long, n_spans long, spans array<struct<from:long,to:long>>")
    out = cut if numbered is None else cut.join(numbered, "id", "left")
    name = F.when(F.col("id") >= first, F.col("id"))
    return out.select((name if numbered is None else F.coalesce(name, "__doc")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans", "spans")


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 100 bytes from all documents."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, i, substring(x, 2 * i + 1, 200) AS s FROM b, unnest(range(0, CAST(len(x) // 2 - 99 AS BIGINT))) AS r(i) WHERE len(x) >= 200),
f AS (SELECT hash(s) AS h, s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
d AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE (w.doc_id, w.i) <> f.first),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM d),
k AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
z AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS e FROM k GROUP BY ALL),
q AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM z),
t AS (SELECT b.doc_id, string_agg(substring(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || max(CASE WHEN last = 1 THEN substring(x, 2 * e + 1) ELSE '' END) AS kept, count(*) AS n, sum(e - a) AS r FROM q JOIN b USING (doc_id) GROUP BY b.doc_id)
SELECT b.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.r, 0) AS BIGINT) AS n_removed, coalesce(t.n, 0) AS n_spans, sha256(unhex(coalesce(t.kept, b.x))) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op5_substrings": op5_substrings}
ORACLES = {"op5_substrings": SQL}
