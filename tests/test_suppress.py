import json

import pytest

from conftest import AWS, GITHUB
from credlens.operators.dedup import first_per_fingerprint
from credlens.operators.detect import detect
from credlens.operators.suppress import exclude_ignored, merge_baseline, suppress_baseline
from credlens.plans.scan import scan_documents
from credlens.schema import BASELINE
from credlens.sources.baseline import load_baseline, load_baseline_json, write_baseline


def test_a_written_baseline_suppresses_its_findings(spark, docs, tmp_path):
    rows = docs(("a.py", AWS), ("b.py", GITHUB))
    first = scan_documents(rows)
    path = write_baseline(first.where("path = 'a.py'"), str(tmp_path / "v1"))
    left = scan_documents(rows, baseline=load_baseline(spark, path))
    assert [r.path for r in left.collect()] == ["b.py"]
    assert left.columns == first.columns


def test_update_merges_and_overwrite_replaces(spark, docs, tmp_path):
    a, b = detect(docs(("a.py", AWS))), detect(docs(("b.py", AWS)))
    v1 = write_baseline(a, str(tmp_path / "v1"), reason="known fixture")
    v2 = write_baseline(b, str(tmp_path / "v2"), existing=v1, reason="later")
    entries = {r.path: r.reason for r in load_baseline(spark, v2).collect()}
    assert entries == {"a.py": "known fixture", "b.py": "later"}
    v3 = write_baseline(b, str(tmp_path / "v3"))
    assert [r.path for r in load_baseline(spark, v3).collect()] == ["b.py"]
    again = write_baseline(a, str(tmp_path / "v4"), existing=v2, reason="not used")
    assert {r.path: r.reason for r in load_baseline(spark, again).collect()} == entries


def test_baseline_is_sorted_and_refuses_its_own_path(spark, docs, tmp_path):
    rows = detect(docs(*[(f"f{i}.py", AWS) for i in range(20)]))
    path = write_baseline(rows, str(tmp_path / "v1"))
    prints = [r.fingerprint for r in spark.read.parquet(path).collect()]
    assert sorted(prints) == sorted(set(prints)) and len(prints) == 20
    with pytest.raises(ValueError):
        write_baseline(rows, path, existing=path + "/")


def test_missing_baseline_is_empty(spark, tmp_path):
    assert load_baseline(spark, str(tmp_path / "none")).count() == 0


def test_json_baseline(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"fingerprints": ["f1", "f2"], "count": 2, "entries": {
        "f1": {"rule_id": "r", "path": "a", "reason": "ok"}, "f3": {"rule_id": "r", "path": "c"}}}, indent=2))
    rows = {r.fingerprint: r.reason for r in load_baseline_json(spark, str(path)).collect()}
    assert rows == {"f1": "ok", "f2": None}
    path.write_text(json.dumps({"entries": {"f3": {"rule_id": "r", "path": "c"}}}))
    assert [tuple(r) for r in load_baseline_json(spark, str(path)).collect()] == [("f3", "r", "c", None)]
    path.write_text("{}")
    assert load_baseline_json(spark, str(path)).count() == 0


def test_merge_keeps_the_old_entry_as_a_whole(spark):
    old = spark.createDataFrame([("f1", "r1", "a", None), ("f2", None, None, None)], BASELINE)
    new = spark.createDataFrame([("f1", "r1", "a", "new"), ("f2", "r2", "b", "new"), ("f3", "r3", "c", "new")], BASELINE)
    rows = {r.fingerprint: tuple(r)[1:] for r in merge_baseline(old, new).collect()}
    assert rows == {"f1": ("r1", "a", None), "f2": ("r2", "b", "new"), "f3": ("r3", "c", "new")}


def test_ignored_paths(spark, docs):
    rows = docs(("src/main.go", AWS), ("build/out.log", AWS))
    ignored = spark.createDataFrame([("build/out.log",)], "path string")
    assert [r.path for r in exclude_ignored(rows, ignored).collect()] == ["src/main.go"]
    assert scan_documents(rows, ignored=ignored).count() == 1
    assert exclude_ignored(rows, ignored.where("false")).count() == 2


def test_a_long_ignore_list_is_cut_to_the_documents(spark, docs, monkeypatch):
    from credlens.operators import suppress
    monkeypatch.setattr(suppress, "is_small", lambda df, *a: False)
    rows = docs(("a.py", AWS), ("b.py", AWS))
    ignored = spark.range(50).selectExpr("concat('x', id) AS path").union(
        spark.createDataFrame([("b.py",)], "path string"))
    assert [r.path for r in exclude_ignored(rows, ignored).collect()] == ["a.py"]


def test_repeated_paths_give_one_finding(docs):
    rows = docs(("a.py", f"\n\n{AWS}"), ("a.py", AWS), ("a.py", f"x {AWS}"), ("b.py", AWS))
    found = scan_documents(rows)
    assert sorted((r.path, r.line, r.column) for r in found.collect()) == [("a.py", 1, 1), ("b.py", 1, 1)]
    assert scan_documents(rows, unique_paths=True).count() == 4


def test_dedup_ranks_before_the_shuffle(docs):
    plan = first_per_fingerprint(detect(docs(("a", AWS))))._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before


def test_a_large_baseline_is_not_hinted(spark, docs):
    from credlens.functions.sizing import broadcast_if_small
    keys = spark.range(100).selectExpr("cast(id AS string) AS fingerprint")
    assert "broadcast" in broadcast_if_small(keys, 100)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in broadcast_if_small(keys, 99)._jdf.queryExecution().analyzed().toString().lower()
    found = detect(docs(("a", AWS)))
    assert suppress_baseline(found, keys).count() == 1
