"""Trees of files as a table.

Spark's file sources silently drop names that start with ``.`` or ``_``; files such as
``.env`` are the ones a credential scan must see. So the tree is listed and read by tasks
of our own: listing and reading are separate steps, and the (narrow) path table is spread
over the cluster between them, so one huge directory does not become one task.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlens.functions.sizing import ensure_checkpoint_dir
from credlens.sources import tree_source
from credlens.operators.files import (
    MAX_BYTES,
    SKIP_DIRS,
    decode_text,
    has_skipped_extension,
    looks_binary,
)

_LISTED = "path string, relative string, length bigint"
_ENTRY = _LISTED + ", is_directory boolean"
_READ = _LISTED + ", content binary, read_error string"
_BATCH_ROWS = 10_000
_BATCH_BYTES = 32 * 1024 * 1024


def _filesystem(uri: str):
    """(file system, path inside it, scheme prefix) of a path or URI."""
    from pyarrow import fs
    if "://" not in uri:
        return fs.LocalFileSystem(), uri, ""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri.split("://", 1)[0] + "://"


def _list_level(directories: DataFrame, base: str, skip: frozenset[str]) -> DataFrame:
    """Entries of the given directories, one level deep; noise directories are left out."""
    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        for batch in batches:
            for directory in batch["path"]:
                system, inside, _ = _filesystem(directory)
                local = isinstance(system, fs.LocalFileSystem)
                try:
                    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
                except PermissionError:  # any other error fails the task, and Spark tries again
                    continue
                # Paths are built from the root as it was given, so its host and account stay.
                above = directory.rstrip("/")
                rows = [
                    (f"{above}/{i.base_name}", f"{above}/{i.base_name}"[len(base):].lstrip("/"), i.size or 0,
                     i.type == fs.FileType.Directory)
                    for i in found if i.base_name not in skip
                    # Links to directories are not followed: they may lead back up.
                    and not (local and i.type == fs.FileType.Directory and os.path.islink(i.path))
                ]
                for start in range(0, len(rows), _BATCH_ROWS):
                    yield pd.DataFrame(rows[start:start + _BATCH_ROWS],
                                       columns=["path", "relative", "length", "is_directory"])

    return directories.select("path").mapInPandas(entries, _ENTRY)


def list_files(spark: SparkSession, root: str, *, extra_skip_dirs: Iterable[str] = ()) -> DataFrame:
    """(path, relative, length) of every file below ``root``, dotfiles included.

    Listed by ``tree_source.list_tree``: one level at a time, each directory counted and
    listed in pages, over an explicit number of tasks; nothing but counts reaches the driver.
    """
    return tree_source.list_tree(spark, root, extra_skip_dirs=extra_skip_dirs)


def _read_contents(files: DataFrame) -> DataFrame:
    """Bytes of each file; an unreadable file gives null bytes and the error text."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "relative", "length", "content", "read_error"]
        for batch in batches:
            rows, held = [], 0
            for path, relative, length in batch.itertuples(index=False):
                system, inside, _ = _filesystem(path)
                data = error = None
                try:
                    with system.open_input_stream(inside) as stream:
                        data = stream.read()
                except (PermissionError, FileNotFoundError) as exc:  # others fail the task
                    error = str(exc)
                rows.append((path, relative, length, data, error))
                held += len(data or b"")
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "relative", "length").mapInPandas(read, _READ)


def read_tree(
    spark: SparkSession,
    root: str,
    *,
    extra_skip_dirs: Iterable[str] = (),
    max_bytes: int | None = MAX_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """Documents (path, relative, content) of the scannable files below ``root``.

    ``path`` is the full path or URI, ``relative`` the path below the root, as ignore lists
    have it: ``exclude_ignored(read_tree(..), ignored, path="relative")``. ``max_bytes=None``
    sets no size limit; ``skipped_files`` lists what is left out, with the reason.

    A root that is one file is read without any filter. A file that cannot be read has a
    null content; ``scan_stats`` counts it as skipped. Files are read through the
    ``credlens_tree`` data source, in partitions packed by bytes; ``partitions`` asks for
    about so many (default: ``tree_source.BYTES_PER_TASK`` bytes each). Binary files are
    sniffed by their first bytes and not read further.
    """
    from pyarrow import fs
    system, base, _ = _filesystem(root)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        single = spark.createDataFrame([(root, root.rsplit("/", 1)[-1], info.size)], _LISTED)
        return _read_contents(single).select("path", "relative", F.expr(decode_text("content")).alias("content"))

    # Noise names, of directories and of files, were left out while listing.
    chosen = list_files(spark, root, extra_skip_dirs=extra_skip_dirs).where(
        ("true" if max_bytes is None else f"length <= {max_bytes}") + f" AND NOT {has_skipped_extension('relative')}").checkpoint()
    per_task = tree_source.BYTES_PER_TASK
    if partitions:
        per_task = max(1, math.ceil((chosen.agg(F.sum("length")).first()[0] or 0) / partitions))
    read = tree_source.read_manifest(spark, chosen, per_task)
    return read.where("reason IS NULL OR reason LIKE 'unreadable%'").select(
        "path", "relative", F.expr(decode_text("content")).alias("content"))


def skipped_files(files: DataFrame, *, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, relative, length, reason) of the listed files that ``read_tree`` leaves out unread."""
    too_large = f"length > {max_bytes}" if max_bytes is not None else "false"
    reason = f"CASE WHEN {has_skipped_extension('relative')} THEN 'extension' WHEN {too_large} THEN 'size' END"
    return files.selectExpr("path", "relative", "length", f"{reason} AS reason").where("reason IS NOT NULL")


def read_ignored_paths(spark: SparkSession, path: str) -> DataFrame:
    """Ignored paths as written by ``git check-ignore -z --stdin`` (NUL-separated)."""
    return spark.read.option("lineSep", "\0").text(path).where("value <> ''").selectExpr("value AS path")
