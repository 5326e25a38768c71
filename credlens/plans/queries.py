"""One query per operator, each over the whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlens.functions import text as tx
from credlens.functions.sizing import ensure_checkpoint_dir, spread
from credlens.functions.text import lit
from credlens.operators import compliance, report, suppress, verify
from credlens.operators.custom import Match, detect_with_python
from credlens.operators.detect import ENTROPY_TOKEN, detect, has_inline_pragma
from credlens.operators.files import decode_text, select_scannable
from credlens.operators.history import newest_commits, parse_patches, scan_history
from credlens.plans import planted as src
from credlens.plans.scan import all_findings, scan_documents, verify_documents
from credlens.rules import Allowlist, RulePack, default_rule_pack, parse_rule_pack
from credlens.sinks.reports import write_findings
from credlens.sources.baseline import load_baseline, write_baseline
from credlens.sources import tree_source
from credlens.sources.files import skipped_files
from credlens.sinks.tree import write_tree

Query = Callable[[SparkSession, str], DataFrame]

NEWEST = 100

# A rule pack as a user would add one: a whole-match rule, a captured value and a captured
# value in the middle of the match.
CUSTOM_PACK = {
    "patterns": [
        {"id": "hex_token", "regex": r"token = \"([0-9a-f]{40})\"", "capture": 1,
         "severity": "high", "min_entropy": 3.0},
        {"id": "sentence_end", "regex": r"([A-Z][a-z]{3,20})\.", "capture": 1, "severity": "info"},
        {"id": "dotted_quad", "regex": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "description": "IPv4 address"},
    ],
    "allowlist": {"value_patterns": ["^10\\."]},
}
PATH_ALLOWLIST = ("\\.md$", "^SRC/src1/")


def _scan(spark: SparkSession, d: str, **options) -> DataFrame:
    return scan_documents(src.planted(spark, d), unique_paths=True, **options)


def _table(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    return spread(src.read_table(spark, d, name).select(key, *columns), key)


# Sources and file filters

def select_scannable_files(spark: SparkSession, d: str) -> DataFrame:
    return select_scannable(src.files(spark, d), max_bytes=src.FILE_MAX_BYTES).select("path", "length")


def exclude_ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    ignored = src.planted(spark, d).where("path LIKE '%.md'").select("path")
    return suppress.exclude_ignored(src.planted(spark, d), ignored).select("doc_id", "path")


def normalize_newlines(spark: SparkSession, d: str) -> DataFrame:
    text = tx.normalize_newlines("content")
    return src.planted(spark, d).selectExpr(
        "path", f"sha2({text}, 256) AS text_sha256", f"cast(size(split({text}, '\\n')) AS int) AS n_lines")


def decode_bytes(spark: SparkSession, d: str) -> DataFrame:
    broken = "concat(encode(content, 'UTF-8'), X'FFC0', encode(path, 'UTF-8'), X'E282')"
    return src.planted(spark, d).selectExpr("path", f"{broken} AS content").selectExpr(
        "path", f"sha2({decode_text('content')}, 256) AS text_sha256")


# Detection

def detect_signatures(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d))


def detect_private_key_blocks(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d), default_rule_pack().only("private_key_block"))


def detect_entropy_tokens(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d), signatures=False, entropy=True)


def detect_all(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d), entropy=True)


def detect_custom_rules(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d), parse_rule_pack(CUSTOM_PACK))


QUOTED_PACK = {
    "patterns": [
        {"id": "quoted_hex", "regex": r"(token|password) = ([\"'])([0-9a-f]{24,40})\2", "capture": 3,
         "severity": "high", "keywords": ["TOKEN", "Password"]},
        {"id": "quoted_key", "regex": r"(?:K = (?P<q>\")(AKIA[0-9A-Z]{16})(?P=q))", "capture": 2, "keywords": ["akia"]},
    ],
}


def detect_quoted_rules(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d), parse_rule_pack(QUOTED_PACK))


def detect_every_rule(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted_rules(spark, d))


def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    listed = src.files(spark, d).selectExpr("path", "path AS relative", "length")
    return skipped_files(listed, max_bytes=src.FILE_MAX_BYTES).select("path", "length", "reason")


def detector_errors(spark: SparkSession, d: str) -> DataFrame:
    def detector(path: str, text: str):
        if path.endswith(".md"):
            raise ValueError("refused")
        return ()

    return detect_with_python(src.planted(spark, d), detector)[1]


def detect_python_rules(spark: SparkSession, d: str) -> DataFrame:
    import re
    pattern = re.compile(r"(?:blob |token = \")([A-Za-z0-9+/=]{20,})")

    def detector(path: str, text: str):
        for m in pattern.finditer(text):
            yield Match("blob_value", m.start(1), m.group(1), severity="high")

    return detect_with_python(src.planted(spark, d), detector, allowlist=Allowlist())[0]


def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted_pages(spark, d), keep=["page_id"], entropy=True)


def scan_conversations(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted_turns(spark, d), entropy=True)


def token_entropy(spark: SparkSession, d: str) -> DataFrame:
    tokens = src.planted(spark, d).selectExpr(
        f"explode(regexp_extract_all(content, {lit(ENTROPY_TOKEN)}, 0)) AS token").distinct()
    return tokens.selectExpr("sha2(token, 256) AS token_sha256",
                             f"{tx.rounded_entropy(tx.shannon_entropy('token'))} AS entropy")


def redact_values(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents", "doc_id", "text")
    values = documents.selectExpr("explode(split(text, ' ')) AS value").union(
        documents.select("text")).distinct()
    return values.selectExpr("sha2(value, 256) AS value_sha256", f"{tx.redact('value')} AS preview")


def fingerprint_values(spark: SparkSession, d: str) -> DataFrame:
    return src.planted(spark, d).selectExpr(
        "path", f"{tx.fingerprint(lit('whole_text'), 'content', 'path')} AS fingerprint")


# Suppression

def detect_without_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d), default_rule_pack().without_allowlist())


def allowlist_paths(spark: SparkSession, d: str) -> DataFrame:
    pack = default_rule_pack()
    allow = Allowlist(pack.allowlist.value_patterns, PATH_ALLOWLIST)
    return detect(src.planted(spark, d), RulePack(pack.rules, allow))


def pragma_marked_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = src.planted(spark, d).selectExpr(
        "path", f"posexplode(split({tx.normalize_newlines('content')}, '\\n')) AS (pos, text)")
    return lines.where(has_inline_pragma("text")).selectExpr("path", "pos + 1 AS line")


def detect_ignoring_pragmas(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d), pragmas=False)


def detect_with_repeats(spark: SparkSession, d: str) -> DataFrame:
    return detect(src.planted(spark, d), dedup=False)


def dedup_findings(spark: SparkSession, d: str) -> DataFrame:
    return scan_documents(src.copies(spark, d))


def baseline_suppress(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, baseline=src.accepted(spark, d))


def baseline_merge(spark: SparkSession, d: str) -> DataFrame:
    new = suppress.baseline_entries(_scan(spark, d), reason="triaged")
    return suppress.merge_baseline(src.accepted(spark, d), new)


def baseline_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return suppress.baseline_entries(_scan(spark, d), reason="triaged")


# History

def patch_lines(spark: SparkSession, d: str) -> DataFrame:
    return parse_patches(src.patches(spark, d).where("NOT is_merge")).selectExpr(
        "repo", "commit_seq", "path", "line", "text")


def newest_commits_per_repo(spark: SparkSession, d: str) -> DataFrame:
    return newest_commits(src.patches(spark, d), NEWEST).select("repo", "commit_seq", "commit")


def history_findings(spark: SparkSession, d: str) -> DataFrame:
    return scan_history(src.patches(spark, d))


def history_findings_newest(spark: SparkSession, d: str) -> DataFrame:
    return scan_history(src.patches(spark, d), max_commits=NEWEST, entropy=True)


def all_sources(spark: SparkSession, d: str) -> DataFrame:
    return all_findings(_scan(spark, d), scan_history(src.patches(spark, d)))


# Verification

def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, secret_hash=True)


def verification_queue(spark: SparkSession, d: str) -> DataFrame:
    return verify.verification_queue(_hashed(spark, d))


def recover_secrets(spark: SparkSession, d: str) -> DataFrame:
    # Stored findings of an earlier scan, then a second look at their documents.
    return verify.recover_secrets(_scan(spark, d), src.planted(spark, d))


def apply_verification(spark: SparkSession, d: str) -> DataFrame:
    return verify_documents(src.planted(spark, d), src.outcomes(spark, d), unique_paths=True)


# Reports

def by_severity(spark: SparkSession, d: str) -> DataFrame:
    return report.by_severity(_scan(spark, d, entropy=True))


def by_verification(spark: SparkSession, d: str) -> DataFrame:
    return report.by_verification(apply_verification(spark, d))


def compliance_rollup(spark: SparkSession, d: str) -> DataFrame:
    return compliance.compliance_rollup(_scan(spark, d))


def finding_controls(spark: SparkSession, d: str) -> DataFrame:
    return compliance.with_controls(_scan(spark, d)).select(
        "fingerprint", "rule_id", "framework", "control_id", "title")


def controls_implicated(spark: SparkSession, d: str) -> DataFrame:
    return compliance.controls_implicated(_scan(spark, d))


def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    scanned = src.read_table(spark, d, "documents").select("doc_id")
    return report.scan_summary(_scan(spark, d, entropy=True), scanned)


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    files = src.read_table(spark, d, "documents").count()
    summary = report.report_summary(
        apply_verification(spark, d), scope="filesystem", root="planted", files_scanned=files)
    return summary.selectExpr(
        "scope", "root", "files_scanned", "`count`", "controls_implicated",
        "to_json(by_severity) AS by_severity", "to_json(by_verification) AS by_verification",
        "array_join(transform(compliance, c -> concat(c.framework, ' ', c.control_id, ' ', c.n)), ', ') AS compliance")


def history_summary(spark: SparkSession, d: str) -> DataFrame:
    commits = src.patches(spark, d).where("NOT is_merge").select("commit_seq")
    return report.scan_summary(scan_history(src.patches(spark, d)), commits, scanned_as="commits_scanned")


def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    unreadable = "if(doc_id % 17 = 0, NULL, content) AS content"
    return report.scan_stats(src.planted(spark, d).selectExpr("path", unreadable))


def severity_gate(spark: SparkSession, d: str) -> DataFrame:
    return report.severity_gate(_scan(spark, d), "high")


def live_gate(spark: SparkSession, d: str) -> DataFrame:
    return report.live_gate(apply_verification(spark, d))


def findings_report_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.report_rows(all_sources(spark, d))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored_json_report(spark: SparkSession, d: str) -> DataFrame:
    findings = _scan(spark, d)
    path = write_findings(findings, _folder(spark, "report"), "json")
    return spark.read.schema(report.report_rows(findings).schema).json(path)


def stored_csv_report(spark: SparkSession, d: str) -> DataFrame:
    findings = _scan(spark, d)
    path = write_findings(findings, _folder(spark, "report"), "csv")
    rows = spark.read.schema(report.csv_rows(findings).schema).option("header", True).csv(path)
    return rows.fillna("", ["verifier"])


def stored_baseline(spark: SparkSession, d: str) -> DataFrame:
    return load_baseline(spark, write_baseline(_scan(spark, d), _folder(spark, "baseline"), reason="triaged"))


def findings_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.csv_rows(_scan(spark, d))


def findings_listing(spark: SparkSession, d: str) -> DataFrame:
    return report.listing_rows(report.worst_first(scan_history(src.patches(spark, d))))


def scan_tree(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as a tree of files to the shared folder, listed and read back by the tree source."""
    folder = _folder(spark, "tree")
    write_tree(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text"), folder)
    read = tree_source.scan_tree(spark, folder)
    return read.select("relative", "length", F.sha2("content", 256).alias("content_sha256"), "reason")


def findings_html_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.html_rows(_scan(spark, d)).select("html", F.col("severity_rank"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        select_scannable_files, exclude_ignored_paths, normalize_newlines, decode_bytes,
        detect_signatures, detect_private_key_blocks, detect_entropy_tokens, detect_all,
        detect_custom_rules, detect_quoted_rules, detect_every_rule, detect_python_rules, detector_errors, skip_reasons, scan_pages, scan_conversations,
        token_entropy, redact_values, fingerprint_values,
        detect_without_allowlist, allowlist_paths, pragma_marked_lines, detect_ignoring_pragmas,
        detect_with_repeats, dedup_findings, baseline_suppress, baseline_merge, baseline_overwrite,
        patch_lines, newest_commits_per_repo, history_findings, history_findings_newest, all_sources,
        verification_queue, recover_secrets, apply_verification,
        by_severity, by_verification, compliance_rollup, finding_controls, controls_implicated,
        scan_summary, report_summary, history_summary, scan_stats, severity_gate, live_gate,
        findings_report_rows, findings_csv_rows, stored_json_report, stored_csv_report, stored_baseline, findings_listing, findings_html_rows,
        scan_tree,
    )
}
