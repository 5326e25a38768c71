"""Verification as joins.

Sending live secrets to providers is not done from executors. These operators produce the
queue of distinct secrets to check (as hashes) and take the answers as an outcome table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlens.functions import bloom
from credlens.functions.sizing import checkpointed
from credlens.functions.text import lit
from credlens.operators.detect import detect
from credlens.rules import RulePack, default_rule_pack
from credlens.schema import FILESYSTEM

# Providers whose answer can be told from the HTTP status alone.
REGISTERED_VERIFIERS = ("github_user", "gitlab", "openai", "anthropic", "stripe", "sendgrid")


def is_verifiable(registered: Iterable[str] = REGISTERED_VERIFIERS) -> str:
    names = ", ".join(lit(v) for v in registered)
    return f"(source = '{FILESYSTEM}' AND verifier IS NOT NULL AND verifier IN ({names}))"


def recover_secrets(
    findings: DataFrame,
    documents: DataFrame,
    pack: RulePack | None = None,
    *,
    path: str = "path",
    content: str = "content",
    registered: Iterable[str] = REGISTERED_VERIFIERS,
) -> DataFrame:
    """Find stored findings again in their documents: (fingerprint, secret_sha256).

    For findings whose scan is over. The verifiable rules are run once more, without anything
    that suppresses, but only over documents that can hold a wanted finding: a Bloom filter of
    the wanted findings' paths, built by one aggregate, is probed where the documents are
    read, and the others are not scanned (``candidates_of``). The narrow result meets the
    findings by fingerprint and line: neither texts nor values are shuffled. The wanted findings
    are checkpointed, as the filter's size, the filter and the join each read them: ``findings``
    that are still a scan are computed once. A new scan gets the hash directly with
    ``detect(..., secret_hash=True)`` and needs no second read.
    """
    pack = pack or default_rule_pack()
    names = set(registered)
    rules = [r.rule_id for r in pack.rules if r.verifier in names]
    wanted = checkpointed(
        findings.where(is_verifiable(registered)).select("fingerprint", "line", "path").distinct())
    again = detect(candidates_of(documents, wanted, path), pack.only(*rules).without_allowlist(), path=path,
                   content=content, pragmas=False, dedup=False, secret_hash=True)
    hashes = again.where("secret_sha256 IS NOT NULL").select("fingerprint", "line", "secret_sha256").distinct()
    wanted = wanted.select("fingerprint", "line").distinct()
    return wanted.join(hashes, ["fingerprint", "line"]).select("fingerprint", "secret_sha256").distinct()


def candidates_of(documents: DataFrame, findings: DataFrame, path: str = "path") -> DataFrame:
    """The documents whose path may be among the findings' ``path``: probed by a Bloom filter, no text moved.

    A false positive (about 1 % of the documents that hold no finding) is only scanned for nothing.
    """
    keys = findings.select(F.col("path").alias(path)).where(F.col(path).isNotNull()).distinct()
    flagged = bloom.might_contain(documents, bloom.build(keys, path), path, "_maybe_found")
    return flagged.where("_maybe_found").drop("_maybe_found")


def verification_queue(
    findings: DataFrame, registered: Iterable[str] = REGISTERED_VERIFIERS, pack: RulePack | None = None
) -> DataFrame:
    """Distinct secrets to check, with the verifier of the first finding that holds each.

    First by path and place; at one place the rules go in the order of their pack.

    Takes findings with a ``secret_sha256`` column. The aggregation combines on the map
    side, so one secret copied everywhere is one row per task in the shuffle.
    """
    names = ", ".join(lit(r.rule_id) for r in (pack or default_rule_pack()).rules)
    first = F.struct("path", "line", "column", F.expr(f"array_position(array({names}), rule_id)"), "rule_id")
    return (findings.where(f"{is_verifiable(registered)} AND secret_sha256 IS NOT NULL")
            .groupBy("secret_sha256")
            .agg(F.min(F.struct(first.alias("at"), "verifier")).alias("_first"),
                 F.count(F.lit(1)).alias("n_findings"))
            .selectExpr("secret_sha256", "_first.verifier AS verifier", "n_findings"))


def outcome_state(status: str) -> str:
    """HTTP status to state; no answer counts as unverified."""
    return (f"CASE WHEN {status} BETWEEN 200 AND 299 THEN 'valid' "
            f"WHEN {status} IN (401, 403) THEN 'invalid' ELSE 'unverified' END")


def apply_verification(
    findings: DataFrame, outcomes: DataFrame, registered: Iterable[str] = REGISTERED_VERIFIERS
) -> DataFrame:
    """Set ``verification`` from the outcome of each finding's secret.

    Findings that cannot be checked (no registered verifier, history source, value not on
    one line) are ``skipped``. The hash column is dropped from the result.
    """
    # Of several answers for a secret, one that says it is live decides, then one that says it is not.
    rank = F.expr("CASE WHEN http_status BETWEEN 200 AND 299 THEN 2 WHEN http_status IN (401, 403) THEN 1 ELSE 0 END")
    answers = outcomes.groupBy("secret_sha256").agg(F.max_by("http_status", rank).alias("_status"))
    joined = findings.join(answers, "secret_sha256", "left")
    checked = f"{is_verifiable(registered)} AND secret_sha256 IS NOT NULL"
    state = F.expr(f"CASE WHEN {checked} THEN {outcome_state('_status')} ELSE 'skipped' END")
    columns = [c for c in findings.columns if c != "secret_sha256"]
    return joined.withColumn("verification", state).select(*columns)
