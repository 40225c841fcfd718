"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of this process, if all tasks run on this machine."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="ledger-"))
    return _own[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts the lineage so that lost executors cost no recomputation. The table goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    """Remove what was written; tables that a result still reads last until the driver ends."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _written:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by now
        return
