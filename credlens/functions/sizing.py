"""Size checks made before a side of a join is broadcast or an input is spread."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 1_000_000
BROADCAST_BYTE_LIMIT = 128 * 1024 * 1024
#: Inputs up to this size are spread over the cores; larger ones are never shuffled for that.
SPREAD_BYTE_LIMIT = 8 * 1024 ** 3


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, which starts no job; exact enough for scans of files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT
) -> bool:
    """Whether ``df`` stays within both bounds.

    A table whose files are small enough by the optimizer's estimate is not read for this (a
    row takes 8 bytes at least, so the estimate bounds the rows as well). Any other is counted
    in one aggregation that each task begins for itself: no rows are moved.
    """
    if estimated_bytes(df) <= min(max_bytes, 8 * max_rows):
        return True
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(width.cast("bigint")).alias("bytes")).first()
    return seen.rows <= max_rows and (seen.bytes or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only for a ``df`` that is known to be small in rows and in bytes.

    For sides whose partner holds whole texts. Beyond the limits the frame is returned without
    a hint, and the join runs as a shuffled join that AQE can split on skew. Narrow tables that
    meet narrow tables need no hint: AQE decides from the sizes it sees. Give a source scan or
    a checkpointed frame, as anything else would be computed twice; streams are returned as
    they are.
    """
    if df.isStreaming or not is_small(df, max_rows):
        return df
    return F.broadcast(df)


def spread(df: DataFrame, *keys: str, per_core: int = 2, max_bytes: int = SPREAD_BYTE_LIMIT) -> DataFrame:
    """Repartition a *source scan* that has fewer splits than the cluster has cores.

    Only inputs of up to ``max_bytes`` (one file, one row group) are spread; beyond, whatever
    the number of cores, texts stay where they are read. Hash partitioning on ``keys`` keeps a
    retried task deterministic.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores * per_core or estimated_bytes(df) > max_bytes:
        return df
    return df.repartition(cores * per_core, *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the checkpoint folder; what reads it does not compute it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def computed_once(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` on the executors' disks within a ``with`` block whose actions read it more than once."""
    already = df.storageLevel.useDisk or df.storageLevel.useMemory
    kept = df if already else df.persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        if not already:
            kept.unpersist()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; set one only in a local session."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is not None:
        return
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="credlens-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
