"""A tree of files as a Spark data source: listed by many tasks, read in partitions packed by bytes.

Three steps, none of which holds the tree on the driver or in one task:

1. **Listing**, one level of directories at a time. The directories of a level are dealt to an
   explicit number of tasks (``dirs_per_task`` each; an explicit count is never merged into
   one task by adaptive coalescing). A directory is first counted, streaming, and then listed
   in pages of ``names_per_page`` entries by start offset, each page a row of its own, so a
   flat directory of a million names is spread over tasks and never one Python list. Each
   level is checkpointed to the shared folder.
2. **Packing**: the listed files are range-partitioned by path; within each range a running
   sum of lengths cuts bins of about ``bytes_per_task`` bytes (a larger file is a bin of its
   own). The manifest (files by bin, and one summary row per bin) is written to the shared
   folder.
3. **Reading** through the ``credlens_tree`` data source: one input partition per bin. The
   reader reads the first ``SNIFF_BYTES`` of a file and stops there if they hold a NUL byte
   (reason ``binary``); otherwise it reads the rest. A file that can't be read gives a null
   content and the reason ``unreadable``.

Local folders are listed with ``os.scandir`` (streaming); other file systems through
pyarrow, whose listing of one directory is a list: paging then bounds what each task keeps
and sends, not what the store returns. Links to directories are not followed. Pages are
offsets in the order the system lists a directory: a directory that changes while it is
listed may miss or repeat the entries that changed.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from credlens.functions.sizing import ensure_checkpoint_dir
from credlens.operators.files import MAX_BYTES, SKIP_DIRS, SNIFF_BYTES, has_skipped_extension

#: Names in one page of a directory; directories (or pages) that one listing task takes; bytes in one read partition.
NAMES_PER_PAGE, DIRS_PER_TASK, BYTES_PER_TASK = 10_000, 8, 128 * 1024 * 1024
#: Listed rows per range when packing.
ROWS_PER_RANGE = 200_000
LISTED = "path string, relative string, length bigint"
READ = "path string, relative string, length bigint, content binary, reason string"
_PAGE = "path string, start bigint, stop bigint"
_ENTRY = LISTED + ", is_directory boolean"


def _filesystem(uri: str):
    """(file system, path inside it) of a path or URI; ``file:`` URIs are local paths."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _names(directory: str) -> Iterator[tuple[str, int, bool]]:
    """(name, size, is_directory) of a directory's entries, streaming where the system allows."""
    from pyarrow import fs
    system, inside = _filesystem(directory)
    if isinstance(system, fs.LocalFileSystem):
        try:
            with os.scandir(inside) as entries:
                for e in entries:
                    try:
                        if e.is_symlink() and e.is_dir():  # may lead back up
                            continue
                        is_dir = e.is_dir(follow_symlinks=False)
                        yield e.name, 0 if is_dir else e.stat().st_size, is_dir
                    except FileNotFoundError:  # gone since it was listed
                        continue
        except (PermissionError, FileNotFoundError, NotADirectoryError):
            return
        return
    for i in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
        yield i.base_name, i.size or 0, i.type == fs.FileType.Directory


def _pages(directories: DataFrame, names_per_page: int) -> DataFrame:
    """(path, start, stop): the pages of each directory, counted without keeping its names."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for directory in frame["path"]:
                n = sum(1 for _ in _names(directory))
                rows += [(directory, s, s + names_per_page) for s in range(0, max(n, 1), names_per_page)]
            yield pd.DataFrame(rows, columns=["path", "start", "stop"])
    return directories.mapInPandas(count, _PAGE)


def _entries(pages: DataFrame, base: str, skip: frozenset[str]) -> DataFrame:
    """(path, relative, length, is_directory) of the entries of each page; noise names left out."""
    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for directory, start, stop in frame.itertuples(index=False):
                above = directory.rstrip("/")
                rows = []
                for i, (name, size, is_dir) in enumerate(_names(directory)):
                    if i >= stop:
                        break
                    if i >= start and name not in skip:
                        path = f"{above}/{name}"
                        rows.append((path, path[len(base):].lstrip("/"), size, is_dir))
                yield pd.DataFrame(rows, columns=["path", "relative", "length", "is_directory"])
    return pages.mapInPandas(listed, _ENTRY)


def _dealt(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """``df`` (checkpointed, ``rows`` long) dealt to an explicit number of tasks, ``per_task`` rows each."""
    return df.repartition(max(1, math.ceil(rows / per_task)), *keys)


def list_tree(spark: SparkSession, root: str, *, extra_skip_dirs: Iterable[str] = (),
              names_per_page: int = NAMES_PER_PAGE, dirs_per_task: int = DIRS_PER_TASK) -> DataFrame:
    """(path, relative, length) of every file below ``root``, dotfiles included, noise directories left out.

    Per level: directories are counted into pages, the pages listed, both over an explicit
    number of tasks. The driver sees two counts a level, never a name.
    """
    ensure_checkpoint_dir(spark)
    base = root.rstrip("/") or "/"
    skip = frozenset((*SKIP_DIRS, *extra_skip_dirs))
    frontier, n = spark.createDataFrame([(base,)], "path string"), 1
    levels: list[DataFrame] = []
    while n:
        pages = _pages(_dealt(frontier, n, dirs_per_task, "path"), names_per_page).checkpoint()
        level = _entries(_dealt(pages, pages.count(), dirs_per_task, "path", "start"), base, skip).checkpoint()
        levels.append(level.where("NOT is_directory").select("path", "relative", "length"))
        frontier = level.where("is_directory").select("path").checkpoint()
        n = frontier.count()
    return reduce(DataFrame.unionByName, levels)


def pack(files: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """``files`` (path, relative, length) with ``bin``: runs of paths of about ``bytes_per_task`` bytes.

    Ranges of paths are cut apart; within a range, a file's bin is its running byte offset
    divided by ``bytes_per_task``, so a bin is never spread over ranges and none grows beyond
    its bytes except by one file.
    """
    rows = files.count()
    ranged = files.repartitionByRange(max(1, math.ceil(rows / ROWS_PER_RANGE)), "path").withColumn(
        "_range", F.spark_partition_id())
    before = F.coalesce(F.sum("length").over(Window.partitionBy("_range").orderBy("path").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("bin", F.col("_range").cast("long") * (1 << 32) + F.floor(before / F.lit(max(1, bytes_per_task)))).drop("_range")


def write_manifest(files: DataFrame, folder: str, bytes_per_task: int = BYTES_PER_TASK) -> str:
    """Write ``files`` packed into bins below ``folder``: ``files/bin=K/`` and one ``bins`` row per bin."""
    packed = pack(files, bytes_per_task).checkpoint()
    packed.repartition("bin").write.partitionBy("bin").parquet(f"{folder}/files")
    packed.groupBy("bin").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).write.parquet(f"{folder}/bins")
    return folder


class _Bin(InputPartition):
    def __init__(self, folder: str, bin_id: int) -> None:
        super().__init__(bin_id)
        self.folder, self.bin_id = folder, bin_id


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["manifest"]

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds
        system, inside = _filesystem(f"{self.folder}/bins")
        bins = ds.dataset(inside, filesystem=system, format="parquet").to_table(columns=["bin"]).column("bin").to_pylist()
        return [_Bin(self.folder, b) for b in sorted(bins)] or [_Bin(self.folder, -1)]

    def read(self, partition: _Bin) -> Iterator[tuple]:
        import pyarrow.dataset as ds
        if partition.bin_id < 0:
            return
        system, inside = _filesystem(f"{partition.folder}/files/bin={partition.bin_id}")
        listed = ds.dataset(inside, filesystem=system, format="parquet").to_table(columns=["path", "relative", "length"])
        for path, relative, length in zip(*(listed.column(c).to_pylist() for c in ("path", "relative", "length"))):
            yield (path, relative, length, *read_file(path))


def read_file(path: str) -> tuple[bytes | None, str | None]:
    """(content, reason): the bytes of a file, unless a NUL in its first bytes makes it ``binary``."""
    system, inside = _filesystem(path)
    try:
        with system.open_input_stream(inside) as stream:
            head = stream.read(SNIFF_BYTES)
            if b"\x00" in head:
                return None, "binary"
            return head + stream.read(), None
    except (PermissionError, FileNotFoundError, IsADirectoryError, OSError) as exc:
        return None, f"unreadable: {type(exc).__name__}"


class TreeSource(DataSource):
    """``spark.read.format("credlens_tree").option("manifest", folder).load()``: the files of a manifest."""

    @classmethod
    def name(cls) -> str:
        return "credlens_tree"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def read_manifest(spark: SparkSession, files: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """(path, relative, length, content, reason) of ``files`` (path, relative, length), through the data source."""
    ensure_checkpoint_dir(spark)
    folder = write_manifest(files, f"{spark.sparkContext.getCheckpointDir()}/tree-{uuid.uuid4().hex}", bytes_per_task)
    register(spark)
    return spark.read.format("credlens_tree").option("manifest", folder).load()


def scan_tree(spark: SparkSession, root: str, *, extra_skip_dirs: Iterable[str] = (), max_bytes: int | None = MAX_BYTES,
              bytes_per_task: int = BYTES_PER_TASK, names_per_page: int = NAMES_PER_PAGE) -> DataFrame:
    """(path, relative, length, content, reason) of the scannable files below ``root``.

    Files with a skipped extension or above ``max_bytes`` are not read (``skipped_files`` lists
    them); binary ones are read up to their first ``SNIFF_BYTES`` and come with null content
    and the reason ``binary``.
    """
    listed = list_tree(spark, root, extra_skip_dirs=extra_skip_dirs, names_per_page=names_per_page)
    chosen = listed.where(("true" if max_bytes is None else f"length <= {max_bytes}") + f" AND NOT {has_skipped_extension('relative')}")
    return read_manifest(spark, chosen, bytes_per_task)
