"""Incremental scans: the same detection on a stream of new or changed documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credlens.operators.suppress import suppress_baseline
from credlens.plans.scan import scan_documents
from credlens.rules import RulePack


def start_incremental_scan(
    documents: DataFrame,
    findings_path: str,
    checkpoint: str,
    pack: RulePack | None = None,
    *,
    baseline: DataFrame | None = None,
    entropy: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the findings that are new to the table at ``findings_path``.

    Each micro-batch writes its own ``batch_id`` partition and compares itself with all
    other partitions, so a batch that is replayed after a failure replaces what it wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        found = scan_documents(batch, pack, baseline=baseline, entropy=entropy)
        known = known_fingerprints(batch.sparkSession, findings_path, batch_id)
        if known is not None:
            found = suppress_baseline(found, known)
        found.write.mode("overwrite").parquet(f"{findings_path}/batch_id={batch_id}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def known_fingerprints(spark: SparkSession, findings_path: str, batch_id: int) -> DataFrame | None:
    """Fingerprints written by other batches; None when there are none yet."""
    try:
        stored = spark.read.parquet(findings_path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return stored.where(F.col("batch_id") != batch_id).select("fingerprint")
