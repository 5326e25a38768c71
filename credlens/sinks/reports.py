"""Writing findings and reports.

A report has several roll-ups of the same findings. The findings are written once, and the
roll-ups read that table: the texts are scanned one time, and a lost executor cannot make
two parts of a report disagree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from credlens.functions.sizing import computed_once
from credlens.operators.compliance import compliance_rollup
from credlens.operators.report import (
    by_severity,
    by_verification,
    csv_rows,
    html_rows,
    report_rows,
    report_summary,
    worst_first,
)

FORMATS = ("parquet", "json", "csv", "html")



def write_findings(findings: DataFrame, path: str, fmt: str) -> str:
    """Write findings as a directory of part files in the given format.

    The sorted formats read the findings twice (for the bounds of the sort's ranges, then for
    the sort), so they are kept on disk meanwhile, and a scan behind them runs once.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported report format: {fmt!r} (use one of {', '.join(FORMATS)})")
    if fmt == "parquet":
        findings.write.mode("overwrite").parquet(path)
        return path
    with computed_once(findings) as kept:
        _write_sorted(kept, path, fmt)
    return path


def _write_sorted(findings: DataFrame, path: str, fmt: str) -> None:
    if fmt == "json":
        report_rows(worst_first(findings)).write.mode("overwrite").json(path)
    elif fmt == "csv":
        csv_rows(worst_first(findings)).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "html":
        (html_rows(findings).orderBy(F.desc("severity_rank"), "location", "rule_id")
         .select("html").write.mode("overwrite").text(path))


def write_report(
    findings: DataFrame,
    path: str,
    fmt: str = "json",
    *,
    scope: str = "filesystem",
    root: str = "",
    observation: Observation | None = None,
) -> DataFrame:
    """Write the findings table, its roll-ups and the formatted rows below ``path``.

    ``observation`` is the one given to the scan; its counters go into the summary. Returns the findings as read back, for further steps.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported report format: {fmt!r} (use one of {', '.join(FORMATS)})")
    findings.write.mode("overwrite").parquet(f"{path}/findings")
    stored = findings.sparkSession.read.parquet(f"{path}/findings")
    if fmt != "parquet":
        _write_sorted(stored, f"{path}/{fmt}", fmt)
    seen = observation.get if observation is not None else {}
    counters = {k: seen[k] for k in ("files_scanned", "commits_scanned") if k in seen}
    small = {
        "by_severity": by_severity(stored).orderBy(F.desc("severity_rank")),
        "by_verification": by_verification(stored),
        "compliance": compliance_rollup(stored).orderBy("framework", "control_id"),
        "summary": report_summary(stored, scope=scope, root=root, **counters),
    }
    for name, frame in small.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")
    return stored
