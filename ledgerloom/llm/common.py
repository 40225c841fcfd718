"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words and are stripped from lines: \x20 and \x09-\x0D.
BLANKS = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that array code works on at a time: its arrays take some fifty times as much.
SLICE = 1 << 19
#: Bytes that Spark sends to Python at a time.
BATCH = 4 << 20

_own_dir: list[str] = []
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; where that is unset a
    temporary one of this process, if all tasks run on this machine (local runs and tests)."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="shared-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the reread table.

    Cuts the lineage: what follows reads committed files, so an executor that is
    lost later costs no recomputation, and every reader sees the same rows. ``by``: a column with a folder for each value.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # row groups of 32 MB: a task holds one until it is written
    write = df.write.option("parquet.block.size", 32 << 20)
    (write.partitionBy(by) if by else write).parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    """Remove the intermediate tables when the driver ends."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _written:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by now
        return


def sliced(texts, most_bytes: int = 4 << 20):
    """Index ranges ``(from, to)`` over ``texts`` of about ``most_bytes`` characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most_bytes:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in bounded memory.

    Batches to Python hold at most BATCH bytes (the session's limit is lowered to that, if it is higher). Workers
    outlive their tasks, so what a task's arrays took is given back at its end.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(limit) or "").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH:
        conf.set(limit, str(BATCH))

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return freed memory of this process to the system (glibc keeps it otherwise)."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


#: Bits of the table that ``maybe_among`` sends to all tasks: 2 MB, whatever the input.
BITS = 1 << 24


def maybe_among(df: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` whose ``columns`` may be among those of ``wanted`` (same names), before an exact join.

    Rows that are among them all stay; of the others as many as share a bit of BITS with them. So a join that
    needs few rows of a large table moves few, and no more than all where nearly all are wanted.
    """
    bit = F.pmod(F.xxhash64(*columns), F.lit(BITS))
    marks = wanted.select(bit.alias("__bit")).groupBy(F.bitmap_bucket_number("__bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__bits"))
    own = df.withColumn("__bit", bit).withColumns({"__bucket_of": F.bitmap_bucket_number("__bit"), "__place": F.bitmap_bit_position("__bit").cast("int")})
    joined = own.join(F.broadcast(marks), F.col("__bucket_of") == F.col("__bucket"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.col("__place") % 8).bitwiseAND(1) == 1
    return joined.filter(hit).select(*df.columns)


def crc_class(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)
