"""Line dedup through a sharded minimal perfect hash.

The distinct line hashes are dealt to shards. Each shard gets a minimal perfect
hash (levels of bit arrays: a key takes its bit where no other key of the level
wants it, the others go on to the next level; a key's slot is the rank of its
bit) that indexes an array of 16-bit fingerprints and one of document counts.
Documents send the hashes of their lines to the shards in packed rows, one per
batch and shard, and get back the positions of the lines to drop: arrays are
probed, lines are not joined. Only members are probed, so answers are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, in_arrow, materialize, sliced, table

#: Distinct lines in a shard, and line occurrences that probe one copy of it.
SHARD_LINES, PROBES = 200_000, 2_000_000
_LEVELS = 64
_HEAD = "shard long, salt long, kind int, doc_ids binary, text_hashes binary, positions binary, hashes binary"


def line_key(line: bytes) -> bytes:
    """Blanks at both ends go, A-Z are lower-cased (UTF-8 keeps other letters as they are)."""
    return line.strip(BLANKS).lower()


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flags = np.unpackbits(bits, count=int(self.starts[-1]))
        self.flags = flags.astype(bool)
        self.ranks = np.cumsum(flags, dtype=np.int64) - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, flags = [], []
        for level in range(_LEVELS):
            if not len(keys):
                break
            size = max(64, int(len(keys) * 1.5))
            at = (_mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("the keys are not distinct")
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate(flags)) if flags else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of member keys; others get some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.flags[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, _LEVELS) >> np.uint64(48)).astype("<u2")


def build_shard(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """The packed arrays of one shard: level sizes, bits, fingerprints, counts."""
    mph = PerfectHash.of(keys)
    slots = mph.slots(keys)
    prints, n = np.zeros(len(keys), "<u2"), np.zeros(len(keys), "<u4")
    prints[slots], n[slots] = _fingerprint(keys), np.minimum(counts, 0xFFFFFFFF)
    return mph.sizes.astype("<i8").tobytes(), mph.bits.tobytes(), prints.tobytes(), n.tobytes()


class Shard:
    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes):
        self.mph = PerfectHash(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, np.uint8))
        self.prints, self.counts = np.frombuffer(prints, "<u2"), np.frombuffer(counts, "<u4")

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Documents of each key; 0 for keys that the fingerprint shows to be foreign."""
        slots = self.mph.slots(keys)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == _fingerprint(keys[ok])
        return np.where(ok, self.counts[np.where(ok, slots, 0)] if len(self.counts) else 0, 0)


def _hashes(min_chars: int):
    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = batch.column(2)
            for a, b in sliced([range(n or 0) for n in pa.compute.binary_length(texts).to_pylist()], 2 << 20):
                part, flat, starts = batch.slice(a, b - a), [], [0]
                for text in part.column(2).to_pylist():
                    for line in (text or "").encode("utf-8", "replace").lower().split(b"\n"):
                        line = line.strip(BLANKS)
                        flat.append(digest(line) if line and (min_chars <= 1 or len(line.decode("utf-8", "replace")) >= min_chars) else None)
                    starts.append(len(flat))
                known = np.array([x is not None for x in flat], bool)
                values = pa.array(np.array([x or 0 for x in flat], np.uint64).view(np.int64), pa.int64(), mask=~known)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)], names=["__id", "__th", "hashes"])

    return run


def _probes(shards: int, salts: dict[int, int]):
    """Packed probe rows: one per batch and shard. ``salts``: copies of the shards that have more than one."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            h = lists.flatten()
            known = h.is_valid().to_numpy(zero_copy_only=False)
            h = h.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            h, row, pos = h[known], row[known], pos[known].astype("<i4")
            ids, ths = (batch.column(i).to_numpy(zero_copy_only=False)[row].astype("<i8") for i in (0, 1))
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            rows = []
            for part in np.split(order, cuts) if len(order) else []:
                s = int(shard[part[0]])
                copies = salts.get(s, 1)
                for k in range(0, len(part), 50_000):
                    p = part[k : k + 50_000]
                    salt = int(_mix(h[p[:1]] ^ ids[p[:1]].astype(np.uint64), 7)[0] % np.uint64(copies))
                    rows.append((s, salt, 1, ids[p].tobytes(), ths[p].tobytes(), pos[p].tobytes(), h[p].astype("<u8").tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["shard", "salt", "kind", "doc_ids", "text_hashes", "positions", "hashes"])

    return run


def _answer(min_docs: int):
    def run(batches):
        shard = None
        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            for r in batch.to_pylist():
                if r["kind"] == 0:  # a shard's arrays come before its probes
                    shard = Shard(r["doc_ids"], r["text_hashes"], r["positions"], r["hashes"])
                    continue
                h = np.frombuffer(r["hashes"], "<u8")
                drop = shard.count(h) >= min_docs
                if drop.any():
                    ids, ths, pos = (np.frombuffer(r[c], t)[drop] for c, t in (("doc_ids", "<i8"), ("text_hashes", "<i8"), ("positions", "<i4")))
                    order = np.lexsort((pos, ths, ids))
                    ids, ths, pos = ids[order], ths[order], pos[order]
                    cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(ths) != 0)) + 1
                    starts = [0, *cuts.tolist(), len(ids)]
                    out += [(int(ids[a]), int(ths[a]), pos[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], names=["__id", "__th", "drop"])

    return run


def drop_common_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, out: str = "kept") -> DataFrame:
    """Add ``n_lines``, ``n_dropped`` and ``out``: the text without its common lines.

    A line's key is the line without blanks (\\x20, \\x09-\\x0D) at both ends and with
    A-Z lower-cased. Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` rows lose all their lines. A null or empty text has one empty line.
    Every row counts as a document, repeated rows too, and gets its own result;
    null ids are allowed. All columns stay, except that those named like an output
    are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(doc_id).alias("__id") if dict(docs.dtypes)[doc_id] != "bigint" else F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("__id"), F.xxhash64(body).alias("__th"), body.alias("__t"))
    lines = materialize(in_arrow(keyed, _hashes(min_chars), "__id long, __th long, hashes array<long>"), "line-hashes")
    counts = lines.select(F.explode(F.array_distinct("hashes")).alias("h")).filter("h is not null").groupBy("h").agg(F.count("*").alias("n"))
    total = lines.agg(F.sum(F.size("hashes"))).first()[0] or 0
    shards = max(16, -(-total // SHARD_LINES))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, prints, n = build_shard(pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "probes": [int(pdf["n"].sum())], "sizes": [sizes], "bits": [bits], "prints": [prints], "counts": [n]})

    # unsigned remainder of the signed long
    two64 = (1 << 64) % shards
    shard = F.pmod(F.pmod(F.col("h"), F.lit(shards)) + F.when(F.col("h") < 0, F.lit(two64)).otherwise(F.lit(0)), F.lit(shards))
    index = counts.withColumn("shard", shard.cast("long")).groupBy("shard").applyInPandas(build, "shard long, probes long, sizes binary, bits binary, prints binary, counts binary")
    index = materialize(index, "line-index")
    # one number for each shard of up to SHARD_LINES lines, and only for the hot ones
    salts = {r[0]: -(-r[1] // PROBES) for r in index.filter(F.col("probes") > PROBES).select("shard", "probes").collect()}
    copies = F.greatest(F.lit(1), F.ceil(F.col("probes") / PROBES)).cast("long")
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("sizes").alias("doc_ids"), F.col("bits").alias("text_hashes"), F.col("prints").alias("positions"), F.col("counts").alias("hashes"))
    probes = in_arrow(lines, _probes(shards, salts), _HEAD)
    dealt = arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    drops = in_arrow(dealt, _answer(min_docs), "__id long, __th long, drop array<int>")
    drops = drops.groupBy("__id", "__th").agg(F.array_distinct(F.flatten(F.collect_list("drop"))).alias("__drop"))
    names = [f"`{c}`" for c in docs.columns if c.lower() not in {"n_lines", "n_dropped", out.lower()}]
    full = docs.withColumns({"__id": F.xxhash64(doc_id) if dict(docs.dtypes)[doc_id] != "bigint" else F.coalesce(F.col(doc_id), F.lit(-(1 << 63))), "__th": F.xxhash64(body)})
    full = full.join(drops, ["__id", "__th"], "left").withColumn("__lines", F.split(body, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), body).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("__lines", i + 1)), "\n"))
    return full.select(*names, F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size(F.col("__drop")), F.lit(0)).cast("long").alias("n_dropped"), kept.alias(out))


def op7_lines(spark, sf_dir: str) -> DataFrame:
    """Drop the lines that at least ten documents share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_common_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, i, lines[i] AS line FROM split, unnest(range(1, len(lines) + 1)) AS r(i)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id
"""

QUERIES = {"op7_lines": op7_lines}
ORACLES = {"op7_lines": SQL}
