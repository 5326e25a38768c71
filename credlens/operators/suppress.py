"""Baselines (accepted fingerprints) and ignored paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlens.functions import bloom
from credlens.functions.sizing import BROADCAST_ROW_LIMIT, broadcast_if_small, ensure_checkpoint_dir, is_small


def suppress_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint is not accepted yet."""
    accepted = baseline.select("fingerprint")  # both sides are narrow: AQE picks the join
    return findings.join(accepted, "fingerprint", "left_anti").select(*findings.columns)


def exclude_ignored(documents: DataFrame, ignored: DataFrame, *, path: str = "path",
                    max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Documents whose path is not in the ignored-path table.

    A list within ``max_rows`` rows (and the byte bound) is broadcast. A longer one (say, of all
    repositories) becomes a Bloom filter, built by one aggregate and probed where the documents
    are read: documents that are surely not listed pass straight through, unmoved. Only the
    candidates' paths meet the list, in a narrow join; the listed paths that occur are
    broadcast if they are few, else only the candidate documents are shuffled, never the rest.
    A null path is never ignored.
    """
    paths = ignored.select(F.col("path").alias(path))
    if documents.isStreaming or is_small(paths, max_rows):
        return documents.join(broadcast_if_small(paths, max_rows), path, "left_anti").select(*documents.columns)
    flagged = bloom.might_contain(documents, bloom.build(paths, path), path, "_maybe_ignored")
    candidates = flagged.where("_maybe_ignored")
    listed = _checkpointed(candidates.select(path).join(paths, path, "left_semi").distinct())
    kept = candidates.join(broadcast_if_small(listed, max_rows), path, "left_anti")
    return flagged.where("NOT _maybe_ignored").select(*documents.columns).unionByName(kept.select(*documents.columns))


def _checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def baseline_entries(findings: DataFrame, reason: str | None = None) -> DataFrame:
    """Baseline rows for findings; one per fingerprint."""
    return findings.groupBy("fingerprint").agg(
        F.min("rule_id").alias("rule_id"), F.min("path").alias("path"),
    ).withColumn("reason", F.lit(reason or None).cast("string"))


def merge_baseline(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two baselines; a fingerprint that exists keeps its old entry as a whole."""
    columns = ("rule_id", "path", "reason")
    old = existing.select("fingerprint", F.struct(*columns).alias("_old"))
    fresh = new.select("fingerprint", F.struct(*columns).alias("_new"))
    joined = old.join(fresh, "fingerprint", "full_outer")
    # An old fingerprint without any entry takes the entry of the new finding.
    has_entry = F.expr("_old.rule_id IS NOT NULL OR _old.path IS NOT NULL OR _old.reason IS NOT NULL")
    entry = F.when(has_entry, F.col("_old")).otherwise(F.coalesce("_new", "_old"))
    return joined.select("fingerprint", entry.alias("_e")).select("fingerprint", "_e.*")
