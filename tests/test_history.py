import shutil
import subprocess

import pytest
from pyspark.sql import Observation

from conftest import AWS, AWS_SAMPLE, GITHUB
from credlens.operators.history import added_content, newest_commits, parse_patches, scan_history
from credlens.operators.suppress import baseline_entries
from credlens.schema import PATCH
from credlens.sources.patches import GIT_LOG_FORMAT, read_git_log


def patch(path, hunks, old="/dev/null"):
    lines = [f"diff --git a/{path} b/{path}", "index 0..1 100644", f"--- {old}", f"+++ b/{path}"]
    for start, added in hunks:
        lines += [f"@@ -0,0 +{start},{len(added)} @@"] + [f"+{a}" for a in added]
    return "\n".join(lines) + "\n"


@pytest.fixture
def commits(spark):
    def build(*rows):
        full = [(r.get("repo", "r"), r["seq"], f"{r['seq']:040x}", "Rowan", "t@x.invalid", "2024-01-01", r.get("summary", ""),
                 r.get("merge", False), r["patch"]) for r in rows]
        return spark.createDataFrame(full, PATCH)
    return build


def test_parse_lines(commits):
    text = "\n".join([
        "", "diff --git a/x.py b/x.py", "index 1..2 100644", "--- a/x.py", "+++ b/x.py",
        "@@ -1 +1,2 @@ def f():", "-old", "--- removed that looks like a header", "+++ added that looks like one",
        "+second", "@@ -9,0 +20 @@", "+far", "\\ No newline at end of file",
        "diff --git a/gone.txt b/gone.txt", "--- a/gone.txt", "+++ /dev/null", "@@ -1 +0,0 @@", "-bye",
        "diff --git a/img.bin b/img.bin", "Binary files differ",
        "diff --git a/my file.py b/my file.py", "--- /dev/null", "+++ b/my file.py\t", "@@ -0,0 +1 @@", "+diff --git a/n b/n",
    ])
    rows = parse_patches(commits({"seq": 1, "patch": text})).select("path", "line", "text").collect()
    assert [tuple(r) for r in rows] == [
        ("x.py", 1, "++ added that looks like one"), ("x.py", 2, "second"), ("x.py", 20, "far"),
        ("my file.py", 1, "diff --git a/n b/n")]


def test_added_content_and_optional_cut(commits):
    one = commits({"seq": 1, "patch": patch("a", [(3, ["abc", "def"])])})
    assert added_content(one).select("content", "line_map").first() == ("abc\ndef", [3, 4])
    assert added_content(one, max_chars=5).first().content == "abc\nd"


def test_a_secret_removed_later_is_attributed_to_the_first_commit(commits):
    rows = commits(
        {"seq": 2, "patch": patch("job/run.sh", [(9, [f"K = '{AWS}'"])]), "summary": "again"},
        {"seq": 1, "patch": patch("job/run.sh", [(1, ["a", f"K = '{AWS}'"])]), "summary": "wire up storage"},
        {"seq": 3, "patch": patch("job/run.sh", [(1, ["K = env()"])]), "summary": "read it from the vault"})
    row = scan_history(rows).collect()
    assert len(row) == 1
    row = row[0]
    assert (row.summary, row.line, row.source, row.author) == ("wire up storage", 2, "git-history", "Rowan")
    assert row.commit_short == row.commit[:8] and len(row.commit) == 40


def test_lines_are_those_of_the_new_file_and_pems_still_match(commits):
    pem = ["-----BEGIN RSA PRIVATE" + " KEY-----", "QUJD", "-----END RSA PRIVATE" + " KEY-----"]
    rows = commits({"seq": 1, "patch": patch("k", [(5, ["x"]), (40, pem), (90, [AWS])])})
    found = {r.rule_id: (r.line, r.preview) for r in scan_history(rows).collect()}
    assert found["private_key_block"] == (40, f"----…-- ({len(chr(10).join(pem))} chars)")
    assert found["aws_access_key_id"][0] == 90


def test_allowlist_pragma_merges_and_baseline(commits):
    rows = commits(
        {"seq": 1, "patch": patch("guide/intro.rst", [(1, [f"use {AWS_SAMPLE} as id"])])},
        {"seq": 2, "patch": patch("job/run.sh", [(1, [f"K = {AWS} # pragma: allowlist secret"])])},
        {"seq": 3, "patch": patch("m.py", [(1, [AWS])]), "merge": True},
        {"seq": 4, "patch": patch("ok.py", [(1, [AWS])])})
    found = scan_history(rows)
    assert [r.path for r in found.collect()] == ["ok.py"]
    assert scan_history(rows, baseline=baseline_entries(found)).count() == 0


def test_dedup_is_per_repository(commits):
    rows = commits(*[{"seq": i, "repo": f"r{i % 2}", "patch": patch("a", [(1, [AWS])])} for i in range(6)])
    assert sorted((r.repo, r.commit_seq) for r in scan_history(rows).collect()) == [("r0", 0), ("r1", 1)]


@pytest.mark.parametrize(("limit", "kept"), [(None, 9), (0, 9), (2, 4), (5, 8), (1200, 9)])
def test_newest_commits(commits, limit, kept):
    rows = commits(*[{"seq": i, "repo": "hot" if i < 6 else "small", "patch": ""} for i in range(9)],
                   {"seq": 99, "repo": "hot", "patch": "", "merge": True})
    got = newest_commits(rows, limit)
    assert got.count() == kept and got.columns == rows.columns
    if limit == 2:
        assert sorted(r.commit_seq for r in got.collect()) == [4, 5, 7, 8]


def test_commits_without_added_lines_are_counted(commits):
    seen = Observation()
    rows = commits({"seq": 1, "patch": ""}, {"seq": 2, "patch": patch("a", [(1, [AWS])])},
                   {"seq": 3, "patch": "", "merge": True})
    assert scan_history(rows, observation=seen).count() == 1
    assert seen.get == {"commits_scanned": 2}


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True)


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_a_real_log(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q")
    git(repo, "config", "user.email", "t@x.invalid")
    git(repo, "config", "user.name", "Rowan")
    steps = [("deploy/settings.ini", f"a\nb\nKEY = '{AWS}'\n", "wire up storage"), ("deploy/settings.ini", "a\nb\n", "read it from the vault"),
             ("other.txt", f"{GITHUB}\r\nsecond\r\n", "more | odd"), ("é x.py", f"t = {AWS}\n", "space")]
    for name, content, message in steps:
        (repo / name).parent.mkdir(exist_ok=True)
        (repo / name).write_bytes(content.encode())
        git(repo, "add", "-A")
        git(repo, "commit", "-q", "-m", message)
    log = subprocess.run(["git", "-C", str(repo), "-c", "core.quotePath=false", "log", "--all", "--no-merges", "--reverse", "--no-color", "-p",
                          "--unified=0", f"--format={GIT_LOG_FORMAT}"], check=True, capture_output=True).stdout
    (tmp_path / "log.txt").write_bytes(log)
    table = read_git_log(spark, str(tmp_path / "log.txt"), "demo")
    assert [r.summary for r in table.orderBy("commit_seq").collect()] == [m for _, _, m in steps]
    assert table.schema.simpleString() == PATCH.simpleString()
    found = {(r.rule_id, r.line, r.summary) for r in scan_history(table).collect()}
    assert "é x.py" in {r.path for r in scan_history(table).collect()}
    assert found == {("aws_access_key_id", 3, "wire up storage"), ("github_pat", 1, "more | odd"),
                     ("aws_access_key_id", 1, "space")}


def test_carriage_returns_in_added_lines(spark):
    key = "AK" + "IA" + "QWERTYUIOPASDFGH"
    patch = (f"diff --git a/w.txt b/w.txt\r\n--- a/w.txt\r\n+++ b/w.txt\r\n@@ -0,0 +1,3 @@\n+one\rK = {key}\r\n+two\r\n+\rthree\n")
    rows = spark.createDataFrame([("r", 1, "c", False, patch)], "repo string, commit_seq bigint, commit string, is_merge boolean, patch string")
    lines = [(r.path, r.line, r.text) for r in parse_patches(rows).collect()]
    assert lines == [("w.txt", 1, "one"), ("w.txt", 1, f"K = {key}"), ("w.txt", 2, "two"), ("w.txt", 3, ""), ("w.txt", 3, "three")]
