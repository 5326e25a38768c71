"""End-to-end pipelines: what one would run as a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from credlens.operators.dedup import first_per_fingerprint
from credlens.operators.detect import ENTROPY_MINIMUM, detect
from credlens.operators.history import scan_history
from credlens.operators.report import file_counts
from credlens.operators.suppress import exclude_ignored, suppress_baseline
from credlens.operators.verify import apply_verification
from credlens.rules import RulePack

__all__ = ["all_findings", "scan_documents", "scan_history", "verify_documents"]


def scan_documents(
    documents: DataFrame,
    pack: RulePack | None = None,
    *,
    baseline: DataFrame | None = None,
    ignored: DataFrame | None = None,
    entropy: bool = False,
    min_entropy: float = ENTROPY_MINIMUM,
    path: str = "path",
    content: str = "content",
    unique_paths: bool = False,
    secret_hash: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """Scan a table of documents: detect, drop repeats, drop accepted findings.

    With ``unique_paths`` the caller states that no path occurs twice. Then a fingerprint
    cannot occur in two rows, and the scan has no shuffle at all. ``observation`` receives
    files_scanned and files_skipped (unreadable files) when the findings are computed, so
    the counters need no further pass over the documents.
    """
    if ignored is not None:
        documents = exclude_ignored(documents, ignored, path=path)
    if observation is not None:
        documents = documents.observe(observation, *file_counts(content))
    findings = detect(documents, pack, path=path, content=content, entropy=entropy,
                      min_entropy=min_entropy, secret_hash=secret_hash)
    if not unique_paths:
        findings = first_per_fingerprint(findings)
    if baseline is not None:
        findings = suppress_baseline(findings, baseline)
    return findings


def verify_documents(documents: DataFrame, outcomes: DataFrame, pack: RulePack | None = None, **options) -> DataFrame:
    """Scan and set the verification state, in one pass over the documents."""
    return apply_verification(scan_documents(documents, pack, secret_hash=True, **options), outcomes)


def all_findings(filesystem: DataFrame, history: DataFrame) -> DataFrame:
    """Both kinds of findings in one table, told apart by ``source``."""
    return filesystem.unionByName(history, allowMissingColumns=True)
