"""Temporary SQL functions, so that plain ``spark.sql`` queries can use the same logic."""

from __future__ import annotations

from pyspark.sql import SparkSession

from credlens.functions import text as tx


def register_functions(spark: SparkSession) -> None:
    """Create redact, fingerprint, shannon_entropy and severity_rank for this session.

    They are SQL functions: Catalyst inlines the body, so there is no call overhead.
    """
    bodies = {
        "redact(secret STRING) RETURNS STRING": tx.redact("secret"),
        "fingerprint(rule_id STRING, secret STRING, path STRING) RETURNS STRING":
            tx.fingerprint("rule_id", "secret", "path"),
        "shannon_entropy(txt STRING) RETURNS DOUBLE": tx.shannon_entropy("txt"),
        "severity_rank(severity STRING) RETURNS INT": tx.severity_rank("severity"),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
