import csv
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import AWS, GITHUB
from credlens.operators import compliance, report, verify
from credlens.operators.detect import detect
from credlens.plans.scan import all_findings, scan_documents, verify_documents
from credlens.schema import FINDING, OUTCOME
from credlens.sinks.reports import write_findings, write_report

GITLAB = "gl" + "pat-" + "A1b2C3d4E5f6G7h8I9j0"


@pytest.fixture
def table(spark):
    """Findings with given (rule_id, severity, verification)."""
    def build(*rows):
        rank = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
        full = [(r, "d", s, rank[s], f"p{i}", 1, 1, "prev", f"f{i}", "filesystem", None, None, v)
                for i, (r, s, v) in enumerate(rows)]
        return spark.createDataFrame(full, FINDING)
    return build


@pytest.mark.parametrize(("status", "state"), [
    (200, "valid"), (204, "valid"), (299, "valid"), (300, "unverified"), (401, "invalid"), (403, "invalid"),
    (404, "unverified"), (429, "unverified"), (500, "unverified"), (None, "unverified")])
def test_status_to_state(spark, docs, status, state):
    rows = docs(("a.py", f"t = {GITHUB}"))
    digest = detect(rows, secret_hash=True).first().secret_sha256
    outcome = spark.createDataFrame([(digest, status)], OUTCOME)
    found = verify_documents(rows, outcome)
    assert [r.verification for r in found.collect()] == [state]
    assert found.columns == [f.name for f in FINDING.fields]


def test_what_cannot_be_checked_is_skipped(spark, docs):
    rows = docs(("a.py", f"{AWS}\n{GITHUB}\npass" + 'word = "hunter2hunter2hunter2"'))
    hashed = detect(rows, secret_hash=True)
    none = spark.createDataFrame([], OUTCOME)
    state = {r.rule_id: r.verification for r in verify.apply_verification(hashed, none).collect()}
    assert state == {"aws_access_key_id": "skipped", "github_pat": "unverified",
                     "generic_api_key_assignment": "skipped"}
    history = verify.apply_verification(hashed.withColumn("source", F.lit("git-history")), none)
    assert {r.verification for r in history.collect()} == {"skipped"}


def test_queue_has_every_secret_once(spark, docs):
    rows = docs(("b.py", f"{GITHUB}"), ("a.py", f"{GITHUB}\n{GITLAB}\n{AWS}"))
    queue = verify.verification_queue(detect(rows, secret_hash=True))
    assert sorted((r.verifier, r.n_findings) for r in queue.collect()) == [("github_user", 2), ("gitlab", 1)]


def test_recover_secrets_matches_the_hash_of_the_scan(docs):
    rows = docs(("a.py", f"x\n{GITHUB} {GITLAB}\n{GITHUB[:-1]}Z"), ("b.py", f"y\r\n{GITHUB}"), ("c.py", AWS))
    scan = detect(rows, secret_hash=True)
    expected = {(r.fingerprint, r.secret_sha256) for r in scan.collect() if r.verifier in verify.REGISTERED_VERIFIERS}
    stored = scan.drop("secret_sha256")
    assert {tuple(r) for r in verify.recover_secrets(stored, rows).collect()} == expected
    assert len(expected) == 4
    moved = docs(("a.py", f"{GITHUB}"))
    assert verify.recover_secrets(stored.where("path = 'a.py'"), moved).count() == 0


def test_rollups(table):
    t = table(("jwt", "medium", "valid"), ("r", "critical", "skipped"), ("r", "critical", "valid"))
    assert {r.severity: r.n for r in report.by_severity(t).collect()} == {"medium": 1, "critical": 2}
    assert {r.verification: r.n for r in report.by_verification(t).collect()} == {"valid": 2, "skipped": 1}


@pytest.mark.parametrize(("level", "failed", "n"), [("critical", False, 0), ("high", True, 1), ("info", True, 2)])
def test_severity_gate(table, level, failed, n):
    t = table(("a", "high", "valid"), ("b", "low", "skipped"))
    assert report.severity_gate(t, level).first() == (failed, n)
    assert report.severity_gate(t.where("false"), level).first() == (False, 0)


def test_live_gate(table):
    assert report.live_gate(table(("a", "low", "valid"), ("b", "low", "invalid"))).first() == (True, 1)
    assert report.live_gate(table(("a", "low", "invalid"))).first() == (False, 0)


@pytest.mark.parametrize(("rule", "controls"), [
    ("aws_access_key_id", {"CWE-798", "A07:2021", "PCI DSS 8.6.2", "PCI DSS 6.2.4", "IA-5"}),
    ("private_key_block", {"CWE-321", "A02:2021", "PCI DSS 8.6.2", "PCI DSS 6.2.4", "IA-5", "SC-12"}),
    ("gcp_service_account", {"CWE-321", "A02:2021", "PCI DSS 8.6.2", "PCI DSS 6.2.4", "IA-5", "SC-12"}),
    ("jwt", {"CWE-522", "A07:2021", "PCI DSS 8.6.2", "PCI DSS 6.2.4", "IA-5"}),
])
def test_controls_of_a_rule(table, rule, controls):
    rows = compliance.with_controls(table((rule, "low", "valid")))
    assert {r.control_id for r in rows.collect()} == controls


def test_compliance_rollup(table):
    t = table(("jwt", "low", "valid"), ("private_key_block", "low", "valid"), ("x", "low", "valid"), ("y", "low", "valid"))
    counts = {r.control_id: r.n for r in compliance.compliance_rollup(t).collect()}
    assert counts == {"CWE-522": 1, "CWE-321": 1, "CWE-798": 2, "A07:2021": 3, "A02:2021": 1,
                      "PCI DSS 8.6.2": 4, "PCI DSS 6.2.4": 4, "IA-5": 4, "SC-12": 1}
    assert compliance.controls_implicated(t).first() == (9, 4)
    empty = compliance.compliance_rollup(t.where("false")).collect()
    assert {(r.framework, r.control_id, r.n) for r in empty} == {(f, None, 0) for f in compliance.FRAMEWORKS}
    assert compliance.controls_implicated(t.where("false")).first() == (0, 0)


def test_summary(table, docs):
    t = table(("jwt", "medium", "valid"), ("r", "critical", "skipped"))
    row = report.scan_summary(t, docs(("a", "x"), ("b", "y"), ("c", "z"))).first()
    assert (row.findings, row.live, row.severity_medium, row.severity_low, row.files_scanned) == (2, 1, 1, 0, 3)
    nested = report.report_summary(t, scope="filesystem", root="/r").first()
    assert nested["count"] == 2 and nested.by_severity == {"medium": 1, "critical": 1}
    assert {c.control_id: c.n for c in nested.compliance}["IA-5"] == 2 and nested.controls_implicated == 6
    nothing = report.report_summary(t.where("false"), scope="filesystem", root="/r", files_scanned=3).first()
    assert (nothing["count"], nothing.by_severity, nothing.compliance, nothing.files_scanned) == (0, {}, [], 3)
    assert nested.scope == "filesystem" and nested.generated_at.endswith("Z")


def test_report_files(spark, docs, tmp_path):
    rows = docs(("a<b>.py", f"{AWS}\n{GITHUB}"), ("b.py", f"{GITHUB}\n\npass" + 'word = "hunter2hunter2hunter2"'))
    seen = Observation()
    found = scan_documents(rows, observation=seen)
    stored = write_report(found, str(tmp_path / "r"), "json", root="/x", observation=seen)
    assert spark.read.json(str(tmp_path / "r/summary")).first().files_scanned == 2
    assert stored.count() == 4
    lines = [json.loads(x) for f in sorted((tmp_path / "r/json").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["severity"] for x in lines] == ["critical"] * 3 + ["medium"]
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "r/by_severity")).collect()) == [1, 3]

    write_findings(found, str(tmp_path / "c"), "csv")
    part = next(f for f in sorted((tmp_path / "c").glob("part-*")) if f.read_text())
    assert next(csv.reader(part.read_text().splitlines())) == [
        "severity", "rule_id", "path", "line", "source", "verification", "verifier", "fingerprint", "description"]

    write_findings(found, str(tmp_path / "h"), "html")
    html = "".join(f.read_text() for f in (tmp_path / "h").glob("part-*"))
    assert "a&lt;b&gt;.py:1" in html and "<b>" not in html
    everything = "".join(f.read_text(errors="ignore") for d in ("r/json", "c", "h") for f in (tmp_path / d).glob("part-*"))
    assert not any(v in everything for v in (AWS, GITHUB, "hunter2hunter2hunter2"))


def test_unknown_format_raises(docs, tmp_path):
    found = detect(docs(("a", AWS)))
    with pytest.raises(ValueError):
        write_findings(found, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        write_report(found, str(tmp_path / "x"), "xml")


def test_report_rows_and_union(docs):
    found = detect(docs(("a", AWS)))
    both = all_findings(found, found.withColumn("source", F.lit("git-history")).withColumn("author", F.lit("T"))
                        .withColumn("commit_short", F.lit("12345678")).withColumn("date", F.lit("d")))
    rows = report.report_rows(both)
    assert len(rows.columns) == 14
    assert sorted((r.source, r.commit) for r in rows.collect()) == [("filesystem", None), ("git-history", "12345678")]
    assert "preview" not in report.csv_rows(found).columns
    labels = {r.commit_label for r in report.listing_rows(both.where("source = 'git-history'")).collect()}
    assert labels == {"12345678 T"}


def test_counters_are_observed_in_the_same_pass(docs):
    seen = Observation()
    found = scan_documents(docs(("a", AWS), ("b", "x"), ("c", None)), unique_paths=True, observation=seen)
    assert found.count() == 1
    assert seen.get == {"files_scanned": 2, "files_skipped": 1}


def test_a_live_answer_decides(spark):
    found = spark.createDataFrame([("f", "filesystem", "openai", s) for s in "abcd"], "rule_id string, source string, verifier string, secret_sha256 string")
    answers = [("a", 200), ("a", 401), ("b", 200), ("b", 500), ("c", 401), ("c", 503), ("d", None), ("d", 429)]
    outcomes = spark.createDataFrame(answers, "secret_sha256 string, http_status int")
    rows = verify.apply_verification(found.withColumns({"key": F.col("secret_sha256"), "verification": F.lit("")}), outcomes).collect()
    assert {r.key: r.verification for r in rows} == {"a": "valid", "b": "valid", "c": "invalid", "d": "unverified"}


@pytest.fixture
def counted(spark):
    """A table whose rows are counted each time that they are computed, and the counter."""
    def build(rows):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return rows.mapInArrow(count, rows.schema), seen
    return build


def test_recover_secrets_computes_the_findings_once(docs, counted):
    rows = docs(*[(f"{i}.py", f"x\n{GITHUB[:-1]}{i}") for i in range(8)])
    texts, seen = counted(rows)
    assert verify.recover_secrets(detect(texts), rows).count() == 8
    assert seen.value == 8


@pytest.mark.parametrize("fmt", ["json", "csv", "html"])
def test_sorted_reports_compute_the_findings_once(spark, docs, counted, tmp_path, fmt):
    texts, seen = counted(docs(*[(f"{i}.py", f"{GITHUB}\n{AWS}") for i in range(8)]).repartition(4))
    found = detect(texts)
    write_findings(found, str(tmp_path / fmt), fmt)
    assert seen.value == 8
    lines = spark.read.text(str(tmp_path / fmt)).where("value NOT LIKE 'severity,%'")
    assert lines.count() == 16
    assert not found.storageLevel.useDisk
