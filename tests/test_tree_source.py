from pyspark.sql import functions as F

from credlens.sources import tree_source as ts


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_four_hundred_directories_over_many_tasks(spark, tmp_path):
    for i in range(400):
        d = tmp_path / f"d{i:03}" / "inner"
        d.mkdir(parents=True)
        (d / f"f{i}.txt").write_text("x" * i)
    dirs = spark.createDataFrame([(str(tmp_path / f"d{i:03}"),) for i in range(400)], "path string")
    dealt = ts._dealt(dirs, 400, ts.DIRS_PER_TASK, "path")
    assert dealt.rdd.getNumPartitions() == 50 and tasks_with_rows(dealt) > 1
    listed = {r.relative: r.length for r in ts.list_tree(spark, str(tmp_path)).collect()}
    assert listed == {f"d{i:03}/inner/f{i}.txt": i for i in range(400)}


def test_flat_directory_in_pages(spark, tmp_path):
    for i in range(3_000):
        (tmp_path / f"n{i}").write_bytes(b"")
    dirs = spark.createDataFrame([(str(tmp_path),)], "path string")
    pages = ts._pages(dirs, 250).collect()
    assert sorted(p.start for p in pages) == list(range(0, 3_000, 250))
    per_page = ts._entries(spark.createDataFrame(pages, ts._PAGE).repartition(6), str(tmp_path), frozenset())
    counted = per_page.groupBy(F.spark_partition_id()).count().collect()
    assert len(counted) > 1 and sum(r["count"] for r in counted) == 3_000
    listed = ts.list_tree(spark, str(tmp_path), names_per_page=250).select("relative").collect()
    assert sorted(r.relative for r in listed) == sorted(f"n{i}" for i in range(3_000))


def test_bins_by_bytes_and_binary_sniff(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i:02}.txt").write_bytes(b"a" * 1_000)
    (tmp_path / "big.txt").write_bytes(b"b" * 10_000)
    (tmp_path / "nul.txt").write_bytes(b"\x00" + b"z" * 5_000_000)
    (tmp_path / "late.txt").write_bytes(b"a" * 1024 + b"\x00")
    (tmp_path / "skip.png").write_bytes(b"png")
    read = ts.scan_tree(spark, str(tmp_path), bytes_per_task=4_000)
    rows = {r.relative: r for r in read.collect()}
    assert set(rows) == {f"f{i:02}.txt" for i in range(40)} | {"big.txt", "nul.txt", "late.txt"}
    assert rows["nul.txt"].content is None and rows["nul.txt"].reason == "binary"
    assert rows["late.txt"].reason is None and len(rows["late.txt"].content) == 1025
    assert bytes(rows["big.txt"].content) == b"b" * 10_000
    assert 8 <= read.rdd.getNumPartitions() <= 14  # about 55 kB of text files in bins of 4 kB, big ones alone
    assert tasks_with_rows(read) == read.rdd.getNumPartitions()


def test_unreadable_file(tmp_path):
    assert ts.read_file(str(tmp_path / "gone"))[1].startswith("unreadable")
