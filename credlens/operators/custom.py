"""Detectors written in Python, for rules that cannot be expressed as a rule pack entry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlens.functions import text as tx
from credlens.operators.detect import pragma_lines, path_allowed, value_allowed
from credlens.rules import Allowlist, default_rule_pack
from credlens.schema import FILESYSTEM


@dataclass(frozen=True)
class Match:
    """One match of a Python detector: where the value starts, and the value."""

    rule_id: str
    start: int
    secret: str
    description: str = ""
    severity: str = "medium"
    entropy: float | None = None
    verifier: str | None = None


Detector = Callable[[str, str], Iterable[Match]]

_MATCHED = ("path string, rule_id string, description string, severity string, line int, "
            "`column` int, secret string, entropy double, verifier string, error string")
_NAMES = ["path", "rule_id", "description", "severity", "line", "column", "secret", "entropy",
          "verifier", "error"]


def detect_with_python(
    documents: DataFrame,
    detector: Detector,
    *,
    allowlist: Allowlist | None = None,
    path: str = "path",
    content: str = "content",
) -> tuple[DataFrame, DataFrame]:
    """Run ``detector(path, content)`` over all documents; returns (findings, errors).

    A detector that fails on a document loses its own findings of that document only; the
    failure becomes a row of ``errors`` (path, error).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_path, text, pragma in batch.itertuples(index=False):
                try:
                    rows.extend(_placed(doc_path, text, pragma, detector(doc_path, text)))
                except Exception as exc:  # noqa: BLE001 - user code; reported as a row
                    rows.append((doc_path, *[None] * 8, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=_NAMES)

    allowlist = default_rule_pack().allowlist if allowlist is None else allowlist
    if allowlist.path_regex:
        documents = documents.where(f"NOT coalesce({path_allowed(f'`{path}`', allowlist)}, false)")
    prepared = documents.where(F.col(content).isNotNull()).selectExpr(
        f"`{path}` AS path", f"{tx.normalize_newlines(f'`{content}`')} AS text",
    ).selectExpr("path", "text", f"{pragma_lines('text')} AS pragma")
    raw = prepared.mapInPandas(run, _MATCHED)
    allowed = value_allowed("secret", allowlist)
    findings = raw.where(f"error IS NULL AND NOT {allowed}").selectExpr(
        "rule_id", "if(description = '', rule_id, description) AS description", "severity",
        f"{tx.severity_rank('severity')} AS severity_rank", "path", "line", "`column`",
        f"{tx.redact('secret')} AS preview",
        f"{tx.fingerprint('rule_id', 'secret', 'path')} AS fingerprint",
        f"'{FILESYSTEM}' AS source", f"{tx.rounded_entropy('entropy')} AS entropy", "verifier",
        "'unverified' AS verification")
    return findings, raw.where("error IS NOT NULL").select("path", "error")


def _placed(path: str, text: str, pragma, matches: Iterable[Match]) -> Iterator[tuple]:
    """Lines and columns in one sweep over the text; pragma lines and repeats left out."""
    line, line_start, seen = 1, 0, set()
    position = 0
    for m in sorted(matches, key=lambda m: m.start):
        newlines = text.count("\n", position, m.start)
        if newlines:
            line += newlines
            line_start = text.rfind("\n", position, m.start) + 1
        position = m.start
        if pragma is not None and pragma[line - 1]:
            continue
        if (m.rule_id, m.secret) in seen:
            continue
        seen.add((m.rule_id, m.secret))
        yield (path, m.rule_id, m.description, m.severity, line, m.start - line_start + 1, m.secret,
               m.entropy, m.verifier, None)
