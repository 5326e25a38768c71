"""Table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Severities in ascending order, verification states, finding sources.
SEVERITIES = ("info", "low", "medium", "high", "critical")
VERIFICATION_STATES = ("unverified", "valid", "invalid", "skipped")
FILESYSTEM = "filesystem"
HISTORY = "git-history"

DOCUMENT = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType()),
])

PATCH = T.StructType([
    T.StructField("repo", T.StringType(), False),
    T.StructField("commit_seq", T.LongType(), False),
    T.StructField("commit", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("is_merge", T.BooleanType()),
    T.StructField("patch", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("severity_rank", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("preview", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("entropy", T.DoubleType()),
    T.StructField("verifier", T.StringType()),
    T.StructField("verification", T.StringType()),
])

COMMIT_ATTRIBUTES = ("commit", "commit_short", "author", "email", "date", "summary")

BASELINE = T.StructType([
    T.StructField("fingerprint", T.StringType(), False),
    T.StructField("rule_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("reason", T.StringType()),
])

OUTCOME = T.StructType([
    T.StructField("secret_sha256", T.StringType(), False),
    T.StructField("http_status", T.IntegerType()),
])
