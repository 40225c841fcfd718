"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

Sizes fall into bands so narrow that a partner lies in the same band or the one
below. For a band B, at most H elements tell two similar sets apart, so its
universe of shingles is hashed into H + 1 segments and some more. A set of the band
probes with a cheap choice of segments whose allowances add up to H + 1: by the
pigeonhole principle, a similar set differs in fewer elements than allowed
in one of them. An allowance of 1 asks for an equal segment; the
first segment of each band may have an allowance of 2, equal up to one element, for which the
segment's one-deletion neighbourhood is indexed too. The cost of a segment is
the chance that strangers share it, so empty and small segments are left out.

Sets that share a signature are candidates. Copies of a set are one vertex. In a
group that shares a signature, each member is checked against the group's pivot
(one check per member, with the pivot it shares most with). In groups that this leaves
in several components, sets of different components are compared by sketches: bit j of a
sketch is the parity of the elements that fall on j, so two sketches differ in
no more bits than their sets differ in elements, and pairs whose sketches differ in more bits than
similar sets may are out for certain. What passes ties components together to families,
whose components are checked against each other tile by tile. So large groups of near
copies cost about one check per member, strangers that share a signature cost a few words
of bits each, and no link between different components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, in_arrow, materialize, maybe_among, sliced, table
from .graph import components
from .hashing import mix, shingles

_SETS = "id long, same long, n long, set_hash long, sketch binary"
_SIGNED = "key long, set_hash long, n long"
#: Elements in a tile of a family.
TILE = 1_000_000
#: 64-bit words of a sketch, by the differences that similar sets of its size may have; rows of a tile of sketches.
WORDS, ROWS = ((128, 8), (512, 32), (2048, 128), (1 << 62, 512)), 2048


def bands(percent: int, most: int = 1 << 32) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band."""
    first, last, at = [], [], 1
    while at < most:
        first.append(at)
        last.append(max(at, at * 100 // percent))
        at = last[-1] + 1
    return np.array(first, np.int64), np.array(last, np.int64)


def plan(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands, differences H allowed in each, and its number of segments."""
    first, last = bands(percent)
    differ = (100 - percent) * 2 * last // (100 + percent)
    return first, differ, np.where(differ == 0, 1, differ + 1 + np.maximum(1, (differ + 1) // 10))


def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[np.append(starts[1:], len(values))] - total[starts]


def signatures(owner: np.ndarray, values: np.ndarray, count: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of all rows that ``count`` sets (sorted owners and elements) put into the index."""
    first, differ, segments = plan(percent)
    n = np.bincount(owner, minlength=count)
    own_band = np.searchsorted(first, n, side="right") - 1
    out_owner, out_key = [], []
    for up in (0, 1):
        band = own_band + up
        m, h = segments[band], differ[band]
        live = n > 0
        seg = (mix(values, 1) % m[owner].astype(np.uint64)).astype(np.int64)
        base = np.cumsum(np.where(live, m, 0)) - np.where(live, m, 0)
        total = int(np.where(live, m, 0).sum())
        cell = base[owner] + seg
        size = np.bincount(cell, minlength=total)
        order = np.argsort(cell, kind="stable")
        weights = mix(values, 2)[order]
        ends = np.cumsum(size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights, dtype=np.uint64)])
        content = sums[ends] - sums[ends - size]
        who = np.repeat(np.arange(count)[live], m[live])
        number = np.arange(total) - base[who]
        place = mix(band[who].astype(np.uint64) * np.uint64(1_000_003) + number.astype(np.uint64), 3)
        exact = mix(place ^ (content * np.uint64(0x9E3779B97F4A7C15)), 4)
        double = (number == 0) & (h[who] > 0)
        allow = np.zeros(total, np.int64)
        if not up:  # sets of the band itself probe; allowances by cost
            cost = np.concatenate([-2.0 * size, np.where(double, -2.0 * (size - 1) + np.log2(size + 1.0), np.inf)])
            cost[:total][size == 0] = 60.0
            cost[total:][size == 0] = 61.0
            units = np.concatenate([np.arange(total), np.arange(total)])
            fit = np.isfinite(cost)
            units, cost = units[fit], cost[fit]
            order = np.lexsort((cost, who[units]))
            units = units[order]
            start = np.flatnonzero(np.concatenate([[True], np.diff(who[units]) != 0])) if len(units) else np.zeros(0, np.int64)
            rank = np.arange(len(units)) - np.repeat(start, np.diff(np.append(start, len(units))))
            np.add.at(allow, units[rank <= h[who[units]]], 1)
        kind = np.where(allow > 0, 0, 2)
        out_owner.append(who)
        out_key.append((exact & np.uint64(0xFFFFFFFFFFFFFFFC)) | kind.astype(np.uint64))
        # one-deletion neighbourhoods of the double segments
        order = np.argsort(cell, kind="stable")
        inside = order[double[cell[order]]]
        c = cell[inside]
        less = mix(place[c] ^ ((content[c] - mix(values[inside], 2)) * np.uint64(0x9E3779B97F4A7C15)), 4)
        out_owner.append(who[c])
        out_key.append((less & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.where(allow[c] > 1, 1, 3).astype(np.uint64))
    return np.concatenate(out_owner), np.concatenate(out_key)


def _of_slice(texts, words: int):
    """Owners, elements, sizes and set hashes of a slice of texts."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    owner, values = shingles(raw, words)
    n = np.bincount(owner, minlength=len(raw)).astype(np.int64)
    starts = np.cumsum(n) - n
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values, 5), dtype=np.uint64)])
    whole = mix((sums[starts + n] - sums[starts]) + n.astype(np.uint64), 6).view(np.int64)
    return owner, values, n, whole


def allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements that two similar sets of ``n`` elements together may differ in."""
    return (100 - percent) * n // (100 + percent)


def sketches(owner: np.ndarray, values: np.ndarray, n: np.ndarray, percent: int) -> list[bytes]:
    """Each set's parities: as many bits as its size asks for, a power of two."""
    words = np.select([allowed(2 * n, percent) <= most for most, _ in WORDS], [w for _, w in WORDS]).astype(np.int64)
    first = np.cumsum(words) - words
    place = 64 * first[owner] + (mix(values, 7) % (64 * words[owner]).astype(np.uint64)).astype(np.int64)
    bits = (np.bincount(place, minlength=64 * int(words.sum())) & 1).astype(np.uint8)
    raw = np.packbits(bits, bitorder="little").tobytes()
    return [raw[8 * a : 8 * (a + w)] for a, w in zip(first.tolist(), words.tolist(), strict=True)]


def _folded(blobs: list[bytes], words: int) -> np.ndarray:
    """Sketches of ``words`` words and more as rows of ``words`` words: a longer one's parts are put one over another."""
    out = np.empty((len(blobs), words), np.uint64)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        parts = np.frombuffer(b"".join(blobs[i] for i in at), np.uint64).reshape(len(at), -1, words)
        out[at] = np.bitwise_xor.reduce(parts, axis=1)
    return out


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _may_link(percent: int):
    """Rows (a, b, n_a, n_b, sketch_a, sketch_b): the pairs that their sketches don't rule out."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            most = allowed(batch.column(2).to_numpy() + batch.column(3).to_numpy(), percent)
            least = np.array([min(len(p), len(q)) // 8 for p, q in zip(x, y, strict=True)], np.int64)
            ok = np.zeros(len(x), bool)
            for w in np.unique(least).tolist():
                at = np.flatnonzero(least == w)
                ok[at] = _differ(_folded([x[i] for i in at], w), _folded([y[i] for i in at], w)) <= most[at]
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return run


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (a, b), sorted, and the least vertex that each is tied to."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def _between(percent: int):
    """Rows sorted by pair of tiles: (set_hash, n, comp, root) for each set that sketches don't rule out as a partner of
    another component's; the root is the least component that these pairs tie to its own, so ties are stars.

    Rows (pair, side, set_hash, n, comp, sketch): side 0 is compared with side 1, or with itself where the whole pair is one tile (side 2).
    """

    def solve(t):
        pair, side = t.column(0).to_numpy(), t.column(1).to_numpy()
        sets, n, comp = (t.column(i).to_numpy() for i in (2, 3, 4))
        blobs = t.column(5).to_pylist()
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        end = np.append(start[1:], len(pair))
        words = np.minimum.reduceat(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8, start)
        # a row is compared with those after it (one tile), or with those of the other side
        group = np.repeat(np.arange(len(start)), end - start)
        second = np.add.reduceat((side == 0).astype(np.int64), start) + start
        row = np.arange(len(pair))
        low = np.where(side == 2, row + 1, np.where(side == 0, second[group], end[group]))
        count = end[group] - low
        own, edges = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for w in np.unique(words).tolist():
            mine = np.flatnonzero(words[group] == w)
            m = _folded([blobs[i] for i in mine], w)
            at = np.full(len(pair), -1)
            at[mine] = np.arange(len(mine))
            step = max(1, (1 << 20) // w)
            total = np.cumsum(count[mine])
            for k in range(0, int(total[-1]), step):
                number = np.arange(k, min(k + step, int(total[-1])))
                of = np.searchsorted(total, number, side="right")
                i = mine[of]
                j = low[i] + number - (total[of] - count[i])
                fit = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
                i, j = i[fit], j[fit]
                near = _differ(m[at[i]], m[at[j]]) <= allowed(n[i] + n[j], percent)
                i, j = i[near], j[near]
                own.append(np.unique(np.concatenate([i, j])))
                edges.append(np.unique(np.stack([comp[i], comp[j]], 1), axis=0))
        own, edges = np.unique(np.concatenate(own)), np.concatenate(edges)
        names, least = _least(edges[:, 0], edges[:, 1])
        root = least[np.searchsorted(names, comp[own])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (sets[own], n[own], comp[own], root)], names=["set_hash", "n", "comp", "root"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.concat_batches([held, batch]) if held is not None and held.num_rows else batch
            pair = t.column(0).to_numpy()
            cut = int(np.searchsorted(pair, pair[-1]))  # the last pair may go on
            held = t.slice(cut)
            if cut:
                yield solve(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _slices(batch, column: int):
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for a, b in sliced([range(x or 0) for x in lengths], SLICE):
        yield batch.slice(a, b - a)


def _sets(words: int, percent: int):
    def run(batches):
        for batch in batches:
            for part in _slices(batch, 1):
                owner, values, n, whole = _of_slice(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(whole), pa.array(sketches(owner, values, n, percent), pa.binary())], names=["id", "same", "n", "set_hash", "sketch"])

    return run


def _signed(words: int, percent: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in _slices(batch, 0):
                owner, values, n, whole = _of_slice(part.column(0).to_pylist(), words)
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero(n):  # a set's copies in the same task add nothing
                    if (k := int(whole[i])) not in seen:
                        seen.add(k)
                        fresh[i] = True
                if len(seen) > 500_000:
                    seen.clear()
                keep = fresh[owner]
                who, key = signatures(owner[keep], values[keep], len(n), percent)
                for a in range(0, len(who), 100_000):
                    w = who[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000].view(np.int64)), pa.array(whole[w]), pa.array(n[w])], names=["key", "set_hash", "n"])

    return run


def _groups(percent: int):
    """Of rows sorted by key, the groups with a probing row and two sets: key, set_hash, n, pivot."""

    def run(batches):
        held = None  # the last row: its key, set and size; the group's pivot; whether the pivot is out
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            sets, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(key):
                continue
            group, kind = key >> np.uint64(2), key & np.uint64(3)
            new = np.concatenate([[held is None or group[0] != held[0]], group[1:] != group[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            probed = np.where(at >= 0, kind[at] < 2, held is not None and held[4])
            pivot = np.where(at >= 0, sets[at], held[1] if held else 0)
            pivot_n = np.where(at >= 0, n[at], held[2] if held else 0)
            other = probed & ~new & (sets != pivot)
            # pivots whose group has another row (it may come with the next batch)
            lead_at, first = np.unique(at[other], return_index=True)
            rows = np.flatnonzero(other)
            lead = rows[first]
            if len(lead_at) and lead_at[0] < 0 and held[3]:
                lead = lead[1:]
            out_group = np.concatenate([group[rows], group[lead]])
            out = [out_group.view(np.int64), np.concatenate([sets[rows], pivot[lead]]), np.concatenate([n[rows], pivot_n[lead]]), np.concatenate([pivot[rows], pivot[lead]]), np.concatenate([pivot_n[rows], pivot_n[lead]])]
            last_out = bool(other[at == at[-1]].any()) or (at[-1] < 0 and held[3])
            held = (group[-1], pivot[-1], pivot_n[-1], last_out, bool(probed[-1]))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "set_hash", "n", "pivot", "pivot_n"])

    return run


def _arrays(words: int):
    def run(batches):
        for batch in batches:
            for part in _slices(batch, 0):
                owner, values, n, whole = _of_slice(part.column(0).to_pylist(), words)
                ends = np.cumsum(n)
                blobs = [values[e - k : e].astype("<u8").tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(blobs, pa.binary())], names=["set_hash", "elements"])

    return run


def _verify(percent: int):
    def run(batches):
        held = None
        for batch in batches:
            out = []
            for a, b, blob in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                x = np.frombuffer(blob, "<u8")
                if b is None:  # the pivot's own row comes first
                    held = (a, x)
                elif held is not None and held[0] == a:
                    y = held[1]
                    small, big = (x, y) if len(x) <= len(y) else (y, x)
                    if len(small) * 100 >= percent * len(big):
                        at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                        common = int((big[at] == small).sum())
                        if 100 * common >= percent * (len(x) + len(y) - common):
                            out.append((a, b))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return run


def _tiles(percent: int):
    """Rows sorted by tile pair and side: (a, b) for each component that links tie to others, b the least of them; these are stars."""

    def stars(ties):
        edges = np.unique(np.concatenate(ties), axis=0)
        names, least = _least(edges[:, 0], edges[:, 1])
        fit = names != least
        return np.stack([names[fit], least[fit]], 1)

    def run(batches):
        pair, left, index, ties = None, [], None, []
        for batch in batches:
            out = []
            tile_pair, side, comp, blobs = (batch.column(i).to_pylist() for i in range(4))
            for p, s, c, blob in zip(tile_pair, side, comp, blobs, strict=True):
                x = np.frombuffer(blob, "<u8")
                if p != pair:
                    if ties:
                        out.append(stars(ties))
                    pair, left, index, ties = p, [], None, []
                if s == 0:
                    left.append((c, x))
                    continue
                if not left:
                    continue
                if index is None:
                    sizes = np.array([len(e[1]) for e in left])
                    all_ = np.concatenate([e[1] for e in left])
                    order = np.argsort(all_, kind="stable")
                    words, starts = np.unique(all_[order], return_index=True)
                    index = (words, np.append(starts, len(all_)), np.repeat(np.arange(len(left)), sizes)[order], sizes, np.array([e[0] for e in left]))
                words, starts, owner, sizes, comps = index
                at = np.minimum(np.searchsorted(words, x), len(words) - 1)
                at = at[words[at] == x]
                n = starts[at + 1] - starts[at]
                rows = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                common = np.bincount(owner[rows], minlength=len(left))
                hit = np.flatnonzero((100 * common >= percent * (sizes + len(x) - common)) & (comps != c))
                if len(hit):
                    far = np.unique(comps[hit])
                    ties.append(np.stack([np.full(len(far), c), far], 1))
                    if len(ties) > 4096:
                        ties = [stars(ties)]
            if out:
                found = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
        if ties:
            found = stars(ties)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def _across(members: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """(a, b): the components of a family (set_hash, n, comp, family) that any links tie together, found tile against tile.

    A family's sets are dealt to tiles of about TILE elements; a component that fills
    tiles of its own has them to itself, and no two of those are compared. Sets are sent once
    for each pair of tiles, so what is sent grows with the square of the family's tiles, not of its sets.
    """
    sized = members.groupBy("family", "comp").agg(F.sum("n").alias("w"))
    large = F.col("w") > TILE // 2
    small = sized.groupBy("family").agg(F.sum(F.when(~large, F.col("w")).otherwise(0)).alias("rest"), F.count("*").alias("comps")).filter("comps > 1")
    own = members.join(sized, ["family", "comp"]).join(small, "family")
    slot = lambda of, weight: F.pmod(F.xxhash64(of, F.lit(3)), F.greatest(F.lit(1), F.ceil(weight / TILE)))
    own = own.withColumn("tile", F.when(large, F.xxhash64("comp", slot("set_hash", F.col("w")))).otherwise(F.xxhash64(F.lit("rest"), slot("comp", F.col("rest")))))
    own = own.select("family", "tile", "set_hash", "comp", F.when(large, F.col("comp")).alias("only")).withColumn("place", F.xxhash64("family", "tile"))
    tiles = own.groupBy("family", "place").agg(F.first("only").alias("only"))
    other = tiles.select("family", F.col("place").alias("place2"), F.col("only").alias("only2"))
    pairs = tiles.join(other, "family").filter("place <= place2 and not coalesce(only = only2, false)").select("place", "place2", F.xxhash64("place", "place2").alias("pair"))
    full = own.select("place", "set_hash", "comp").join(elements, "set_hash")
    lefts = full.join(pairs.select("place", "pair"), "place").select("pair", F.lit(0).alias("side"), "comp", "elements")
    rights = full.join(pairs.select(F.col("place2").alias("place"), "pair"), "place").select("pair", F.lit(1).alias("side"), "comp", "elements")
    return in_arrow(lefts.unionByName(rights).repartition("pair").sortWithinPartitions("pair", "side"), _tiles(percent), "a long, b long")


def similar_components(docs: DataFrame, words: int = 4, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links between documents
    whose sets of distinct shingles have a Jaccard similarity of at least ``percent`` / 100.

    Words lie between blanks (\\x20, \\x09-\\x0D), A-Z are lower-cased; a text of fewer words is one
    shingle; null, empty and blank texts have none and are linked with nothing. Elements are 64-bit hashes.
    One result per row: repeated rows and ties link as copies do. A null doc_id takes part, and gives way to
    any other as component_id. Other columns are passed over, an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("__t"))
    # rows without an id are told by their text: one row of each text holds its set
    own = own.withColumn("same", F.when(F.col("id").isNull(), F.xxhash64("__t")))
    sets = materialize(in_arrow(own, _sets(words, percent), _SETS), "shingle-sets")
    signed = in_arrow(own.select("__t"), _signed(words, percent), _SIGNED)
    dealt = signed.repartition(F.shiftright("key", 2)).sortWithinPartitions("key", "set_hash")
    groups = materialize(in_arrow(dealt, _groups(percent), "key long, set_hash long, n long, pivot long, pivot_n long"), "shared-segments")
    # what stands for a set: its sketch and one row that holds it
    needed = groups.select("set_hash").distinct()
    holders = materialize(sets.groupBy("set_hash").agg(F.min("id").alias("id"), F.min("same").alias("same"), F.min("sketch").alias("sketch")).join(needed, "set_hash", "left_semi"), "holders")

    def elements(wanted: DataFrame) -> DataFrame:
        """The elements of the sets in ``wanted`` (set_hash), from one row that holds each."""
        of = holders.select("set_hash", "id", "same").join(wanted.distinct(), "set_hash", "left_semi")
        # inner joins: a semi-join would be moved below the one that leaves most rows out
        near = maybe_among(own, of, "id", "same")
        named = near.join(of.select("id").distinct(), "id").select("__t")
        lone = of.filter(F.col("id").isNull()).select("same").distinct()
        nameless = near.filter(F.col("id").isNull()).select("same", "__t").distinct().join(lone, "same").select("__t")
        bodies = in_arrow(named.unionByName(nameless), _arrays(words), "set_hash long, elements binary")
        return materialize(bodies.dropDuplicates(["set_hash"]), "elements")

    def links(pairs: DataFrame) -> DataFrame:
        bodies = elements(pairs.select(F.col("a").alias("set_hash")).unionByName(pairs.select(F.col("b").alias("set_hash"))))
        # a pivot's pairs are dealt to as many tasks as their number asks for
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / ROWS).alias("salts"))
        salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
        none = F.lit(None).cast("long")
        heads = salted.select("a", "salt").distinct().join(bodies.withColumnRenamed("set_hash", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), none.alias("b"), "elements")
        tails = salted.join(bodies.withColumnRenamed("set_hash", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "elements")
        return in_arrow(heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind"), _verify(percent), "a long, b long")

    # each member with the pivot that it shares most segments with
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    shared = groups.filter((F.col("set_hash") != F.col("pivot")) & near(F.col("n"), F.col("pivot_n"))).groupBy("set_hash", "pivot", "n", "pivot_n").agg(F.count("*").alias("c"))
    best = shared.groupBy("set_hash").agg(F.max(F.struct("c", "pivot", "n", "pivot_n")).alias("x"))
    stars = best.select(F.col("x.pivot").alias("a"), F.col("set_hash").alias("b"), F.col("x.pivot_n").alias("n_a"), F.col("x.n").alias("n_b"))
    sketch = lambda side: holders.select(F.col("set_hash").alias(side), F.col("sketch").alias(f"sketch_{side}"))
    drawn = stars.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    pairs = materialize(in_arrow(drawn, _may_link(percent), "a long, b long"), "pairs")
    found = materialize(links(pairs), "links")
    # groups that lie in several components still, in tiles; what their sketches tie together makes families
    comps = components(found).withColumnRenamed("v", "set_hash")
    member = groups.select("key", "set_hash", "n").distinct().join(comps, "set_hash", "left").withColumn("comp", F.coalesce("comp", "set_hash"))
    open_ = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / ROWS).alias("tiles")).filter("lo < hi").select("key", "tiles")
    rows = member.join(open_, "key").join(holders.select("set_hash", "sketch"), "set_hash").withColumn("slot", F.pmod(F.xxhash64("set_hash"), F.col("tiles")))
    # a tile meets all tiles of its group: as the left side those from it on, as the right side those before it
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    spread = rows.withColumn("with", other).select(
        F.xxhash64("key", F.least("slot", "with"), F.greatest("slot", "with")).alias("pair"),
        F.when(F.col("slot") == F.col("with"), 2).when(F.col("slot") < F.col("with"), 0).otherwise(1).alias("side"), "set_hash", "n", "comp", "sketch",
    )
    dealt = spread.repartition("pair").sortWithinPartitions("pair", "side")
    tied = materialize(in_arrow(dealt, _between(percent), "set_hash long, n long, comp long, root long"), "tied")
    family = components(tied.select(F.col("comp").alias("a"), F.col("root").alias("b")).filter("a <> b")).select(F.col("comp").alias("family"), F.col("v").alias("comp"))
    members = materialize(tied.select("set_hash", "n", "comp").distinct().join(family, "comp"), "families")
    across = materialize(_across(members, elements(members.select("set_hash")), percent), "links")
    # only what ties components together is new: a graph of components
    roots = components(across).withColumnsRenamed({"v": "__comp", "comp": "__root"})
    of = members.select("set_hash", "comp")
    known = comps.select("set_hash", "comp").unionByName(of.join(comps, "set_hash", "left_anti"))
    comps = known.join(roots, F.col("comp") == F.col("__comp"), "left").select("set_hash", F.coalesce("__root", "comp").alias("comp"))
    placed = sets.join(comps, "set_hash", "left").withColumn("comp", F.coalesce("comp", "set_hash"))
    least = placed.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    full = placed.withColumn("comp", F.when(F.col("n") > 0, F.col("comp"))).join(least, "comp", "left")
    return full.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are 85 % alike."""
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM n UNION SELECT d.b, r.m FROM r JOIN d ON d.a = r.v AND r.m < d.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY ALL
"""

QUERIES = {"op4_jaccard": op4_jaccard}
ORACLES = {"op4_jaccard": SQL}
