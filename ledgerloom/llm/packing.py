"""Best-fit packing by hierarchical residual rounds.

Every partition packs its own items, longest first, each into the fullest bin
that still takes it. Full bins are done. The underfull bins
become the items of the next round, in an eighth of the partitions, and so on
up a tree until one task packs them all. TASK_ITEMS bins meet in a task at a time; a round that
spares less than SPARED of the bins it got ends the tree too, at every size, as another
one would spare still less.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary
from .common import in_arrow, materialize, sliced, table

#: Items that one task packs at a time.
TASK_ITEMS = 200_000
#: Partitions that meet in one at each level of the tree, and the least share of bins that a round must spare.
FAN_IN, SPARED = 8, 0.001
_BINS = "sequence_id long, fill long, members array<struct<item:long,offset:long>>"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins, as lists of item numbers, by best fit in the order given."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for item, n in enumerate(lengths):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        room -= n
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins


def _packed(ids, fills, starts, items, offsets, capacity: int, first_id: int):
    """One record batch of bins from bins (ids, fills, members from starts) packed anew."""
    order = np.lexsort((ids, -fills))
    bins = best_fit(fills[order].tolist(), capacity)
    out_fill, out_start, parts = [], [0], []
    for b in bins:
        base = 0
        for k in order[b]:
            at = slice(starts[k], starts[k + 1])
            parts.append((items[at], offsets[at] + base))
            base += int(fills[k])
        out_fill.append(base)
        out_start.append(out_start[-1] + sum(int(starts[k + 1] - starts[k]) for k in order[b]))
    flat = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, "i8") for i in (0, 1)]
    members = pa.ListArray.from_arrays(pa.array(out_start, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64())], ["item", "offset"]))
    n = len(out_fill)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first_id, first_id + n), pa.int64()), pa.array(out_fill, pa.int64()), members], names=["sequence_id", "fill", "members"])


def _round(level: int, capacity: int):
    def run(batches):
        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        held, count = [], 0

        def pack():
            nonlocal first
            t = pa.Table.from_batches(held).combine_chunks()
            members = t.column("members").combine_chunks()
            members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
            flat = members.flatten()
            starts = np.concatenate([[0], np.cumsum(np.diff(members.offsets.to_numpy()))])
            out = _packed(t.column("sequence_id").to_numpy(), t.column("fill").to_numpy(), starts, flat.field(0).to_numpy(), flat.field(1).to_numpy(), capacity, first)
            first += out.num_rows
            return out

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= TASK_ITEMS:
                yield pack()
                held, count = [], 0
        if count:
            yield pack()

    return run


def pack_best_fit(items: DataFrame, item: str = "item", length: str = "length", capacity: int = 1024, near: int = 0) -> DataFrame:
    """Place items into sequences of at most ``capacity``: item, sequence_id, offset.

    ``item`` is a unique long, ``length`` from 1 to ``capacity``; other lengths and
    nulls raise an error when the query runs. A sequence with at most ``near``
    tokens of room (none: only full ones) is done; all others go on to the next round. Every item
    gets one place; places in a sequence have no gaps from 0. Equal lengths go by
    item, an empty input gives no rows, other columns are passed over. Each round
    is written to the shared folder, so lost executors can't change a placement.
    """
    size = F.col(length).cast("long")
    checked = F.when(size.between(1, capacity), size).otherwise(F.raise_error(F.lit("an item's length is out of range")).cast("long"))
    bins = items.select(
        F.col(item).cast("long").alias("sequence_id"), checked.alias("fill"),
        F.array(F.struct(F.col(item).cast("long").alias("item"), F.lit(0).cast("long").alias("offset"))).alias("members"),
    )
    whole = bins.filter(F.col("fill") == capacity).withColumn("sequence_id", F.col("sequence_id").bitwiseOR(F.lit(1 << 62)))
    done, level, before = [whole], 0, None
    bins = bins.filter(F.col("fill") < capacity)
    parts = bins.rdd.getNumPartitions()
    while True:
        packed = materialize(in_arrow(bins, _round(level, capacity), _BINS), f"packing-{level}")
        left = packed.filter(F.col("fill") < capacity - near)
        n = left.count()
        least = -(-n // TASK_ITEMS)
        if parts == 1 or not n or (before is not None and packed.count() > (1 - SPARED) * before):
            done.append(packed)
            break
        done.append(packed.filter(F.col("fill") >= capacity - near))
        parts, level, before = max(1, min(parts - 1, max(parts // FAN_IN, least))), level + 1, n
        bins = left.repartition(parts, F.xxhash64("sequence_id", F.lit(level))).sortWithinPartitions("sequence_id")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("sequence_id", F.inline("members")).select("item", "sequence_id", "offset")


#: How byte-level BPE parts a text into words (a fixed value of the format).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def _encoding(blob: bytes) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file, for tiktoken, which is faster; its ids are the ranks."""
    spec = json.loads(blob)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    back = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tokenize(df: DataFrame, vocabulary_path: str, text: str, keys: tuple[str, ...]) -> DataFrame:
    """``keys`` and ``ids``: each whole text's token ids, packed as little-endian unsigned 32-bit; null counts as empty."""
    own = df.select(F.col(text).cast("string").alias("__text"), *keys)
    blob = df.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches):
        encode = _encoding(blob.value).encode_to_numpy
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(0)).to_pylist()
            for a, b in sliced([range(n or 0) for n in lengths]):
                part = batch.slice(a, b - a)
                ids = [encode(t or "", allowed_special="all").astype("<u4").tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, part.num_columns)), pa.array(ids, pa.binary())], names=[*part.schema.names[1:], "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return in_arrow(own, run, f"{fields}, ids binary")


def cut(df: DataFrame, ids: str = "ids", capacity: int = 1024) -> DataFrame:
    """Replace packed ``ids`` by ``pieces``: array of (piece, start, length, ids, ids_crc32), at most
    ``capacity`` tokens each; only the first piece of a longer row is shorter. Null
    or empty ids give no piece. Other columns stay."""
    n = F.octet_length(ids) / F.lit(4)
    count = F.ceil(n / capacity)
    first = n - (count - 1) * capacity
    piece = lambda i: F.struct(
        i.cast("int").alias("piece"),
        (start := F.when(i == 0, F.lit(0)).otherwise(first + (i - 1) * capacity).cast("long")).alias("start"),
        (size := F.when(i == 0, first).otherwise(F.lit(capacity)).cast("long")).alias("length"),
        (part := F.substring(F.col(ids), (start * 4 + 1).cast("int"), (size * 4).cast("int"))).alias("ids"),
        F.crc32(part).alias("ids_crc32"),
    )
    return df.withColumn("pieces", F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), piece))).drop(ids)


def packed_documents(docs: DataFrame, vocabulary_path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Tokenize whole texts, add ``end_id``, cut and pack them: one row per piece.

    Returns ``keys`` and piece, start, length, ids (packed binary; not kept unless
    ``with_ids``), ids_crc32, sequence_id, offset. A null or empty text is one piece that holds ``end_id`` alone.
    """
    clash = {"piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset", "item"} & set(keys)
    if clash:
        raise ValueError(f"keys may not be named {sorted(clash)}")
    ended = tokenize(docs, vocabulary_path, text, keys).withColumn("ids", F.concat("ids", F.lit(end_id.to_bytes(4, "little"))))
    pieces = cut(ended, "ids", capacity).select(*keys, F.inline("pieces")).withColumn("item", F.monotonically_increasing_id())
    pieces = materialize(pieces if with_ids else pieces.drop("ids"), "pieces")
    places = pack_best_fit(pieces.select("item", "length"), capacity=capacity)
    return pieces.join(places, "item").drop("item")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
