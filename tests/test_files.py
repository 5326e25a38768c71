import os

import pytest

from conftest import AWS
from credlens.operators.files import MAX_BYTES, decode_text, select_scannable
from credlens.operators.suppress import exclude_ignored
from credlens.plans.scan import scan_documents
from credlens.sources.files import list_files, read_ignored_paths, read_tree, skipped_files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "build" / "repo"      # a noise name above the root does not matter
    for directory in ("node_modules", "src/deep/deeper", ".git"):
        (root / directory).mkdir(parents=True)
    (root / "a.py").write_text(f"KEY='{AWS}'")
    (root / ".env").write_text(f"KEY={AWS}\n")
    (root / "_under.txt").write_text("x")
    (root / "img.PNG").write_bytes(b"\x89PNG")
    (root / "nul.txt").write_bytes(b"ab\x00cd")
    (root / "late_nul.txt").write_bytes(b"a" * 1024 + b"\x00")
    (root / "big.txt").write_bytes(b"b" * (MAX_BYTES + 1))
    (root / "exact.txt").write_bytes(b"e" * MAX_BYTES)
    (root / "node_modules" / "x.js").write_text(AWS)
    (root / ".git" / "config").write_text(AWS)
    (root / "bad_utf8.py").write_bytes(b"caf\xc3\xa9 \xff\xfe ok")
    (root / "crlf.py").write_bytes(f"x\r\nK = '{AWS}'\r\n".encode())
    (root / "src" / "deep" / "deeper" / "vendor").write_text("a file named like a noise directory")
    (root / "src" / "deep" / "deeper" / "z.cfg").write_text("z")
    (root / "src" / "loop").symlink_to(root, target_is_directory=True)
    return root


def test_read_tree(spark, tree):
    rows = {os.path.relpath(r.path, tree): r.content for r in read_tree(spark, str(tree), partitions=3).collect()}
    assert set(rows) == {"a.py", ".env", "_under.txt", "late_nul.txt", "exact.txt", "bad_utf8.py", "crlf.py",
                         "src/deep/deeper/z.cfg"}
    assert rows["bad_utf8.py"] == "café  ok"
    assert rows["crlf.py"] == f"x\nK = '{AWS}'\n"


def test_extra_skip_dirs_and_size(spark, tree):
    rows = read_tree(spark, str(tree), extra_skip_dirs=["deeper"], max_bytes=100)
    names = {os.path.relpath(r.path, tree) for r in rows.select("path").collect()}
    assert "src/deep/deeper/z.cfg" not in names and "exact.txt" not in names and "a.py" in names


def test_a_single_file_is_read_without_filters(spark, tree):
    rows = read_tree(spark, str(tree / "nul.txt")).collect()
    assert [(os.path.basename(r.path), r.content) for r in rows] == [("nul.txt", "ab\x00cd")]


def test_listing_has_sizes_and_relative_paths(spark, tree):
    rows = {r.relative: r.length for r in list_files(spark, str(tree)).collect()}
    assert rows["exact.txt"] == MAX_BYTES
    assert "node_modules/x.js" not in rows and ".git/config" not in rows


def test_a_file_uri_works_like_a_path(spark, tree):
    rows = read_tree(spark, f"file://{tree}", max_bytes=1000).select("path").collect()
    assert f"file://{tree}/.env" in {r.path for r in rows}


def test_scan_of_a_tree(spark, tree):
    found = scan_documents(read_tree(spark, str(tree)), unique_paths=True)
    places = {(os.path.relpath(r.path, tree), r.line) for r in found.collect()}
    assert places == {("a.py", 1), (".env", 1), ("crlf.py", 2)}


def test_an_unreadable_file_has_null_content(spark, tree, monkeypatch):
    from credlens.operators.report import scan_stats
    from credlens.sources import files as source
    listed = spark.createDataFrame([(str(tree / "gone.py"), "gone.py", 1), (str(tree / "a.py"), "a.py", 1)],
                                   source._LISTED)
    row = scan_stats(source._read_contents(listed)).first()
    assert (row.files_scanned, row.files_skipped) == (1, 1)


@pytest.mark.parametrize(("path", "kept"), [
    ("src/a.py", True), ("build/a.py", False), ("a/.git/config", False), ("builder/a.py", True),
    ("a/x.tar.GZ", False), ("a/.env", True), ("a/.png", True), ("a/x.", True), ("a.png/x", True),
    ("env", False), ("x.min.js", True), ("x.so", False), ("x.so.1", True),
])
def test_path_rules(spark, path, kept):
    df = spark.createDataFrame([(path, 3, bytearray(b"abc"))], "path string, length bigint, content binary")
    assert select_scannable(df).count() == int(kept)


@pytest.mark.parametrize(("raw", "text"), [
    (b"ok", "ok"), ("é😀\r\n".encode(), "é😀\n"), (b"a\xffb", "ab"), (b"a\xe2\x82", "a"),
    ("keep �".encode(), "keep �"),
])
def test_decode(spark, raw, text):
    df = spark.createDataFrame([(bytearray(raw),)], "content binary")
    assert df.selectExpr(f"{decode_text('content')} AS t").first().t == text


def test_ignored_paths_file(spark, tmp_path):
    (tmp_path / "ignored").write_bytes(b"a b.txt\0dir/c\nd\0")
    assert [r.path for r in read_ignored_paths(spark, str(tmp_path / "ignored")).collect()] == ["a b.txt", "dir/c\nd"]


def test_ignore_list_of_a_tree(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("keep.txt", "deep/drop.txt", "deep/keep.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "ignored").write_bytes(b"deep/drop.txt\0")
    found = exclude_ignored(read_tree(spark, str(tmp_path)), read_ignored_paths(spark, str(tmp_path / "ignored")), path="relative")
    assert sorted(r.relative for r in found.collect()) == ["deep/keep.txt", "keep.txt"]  # the list itself has NUL bytes


def test_left_out_files_have_a_reason(spark, tmp_path):
    (tmp_path / "a.png").write_text("x")
    (tmp_path / "b.txt").write_text("x" * 50)
    listed = list_files(spark, str(tmp_path))
    assert {(r.relative, r.reason) for r in skipped_files(listed, max_bytes=9).collect()} == {("a.png", "extension"), ("b.txt", "size")}
    assert [r.reason for r in skipped_files(listed, max_bytes=None).collect()] == ["extension"]
    assert read_tree(spark, str(tmp_path), max_bytes=None).count() == 1
