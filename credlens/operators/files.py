"""Which files are scanned, and how their bytes become text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from credlens.functions.text import lit, normalize_newlines

# Directories and extensions never scanned, size cap, sniffed bytes.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", "env",
    "dist", "build", ".eggs", ".pytest_cache", ".mypy_cache", ".idea", ".vscode",
    "vendor", "target", ".terraform",
)
SKIP_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg",
    ".pdf", ".zip", ".gz", ".tar", ".7z", ".rar", ".jar", ".war",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".class",
    ".mp3", ".mp4", ".mov", ".avi", ".wav", ".woff", ".woff2", ".ttf", ".eot",
    ".pyc", ".pyo",
)
MAX_BYTES = 5 * 1024 * 1024
SNIFF_BYTES = 1024


def in_skipped_dir(path: str, extra: Iterable[str] = ()) -> str:
    names = ", ".join(lit(d) for d in (*SKIP_DIRS, *extra))
    return f"arrays_overlap(split({path}, '/'), array({names}))"


def has_skipped_extension(path: str) -> str:
    """Last suffix only, any case. A dotfile such as ``.env`` has no suffix."""
    names = ", ".join(lit(e) for e in SKIP_EXTENSIONS)
    return f"lower(regexp_extract({path}, {lit(r'[^/](\.[^./]+)$')}, 1)) IN ({names})"


def looks_binary(content: str) -> str:
    """A NUL byte among the first bytes."""
    return f"contains(substring({content}, 1, {SNIFF_BYTES}), X'00')"


def select_scannable(
    files: DataFrame,
    *,
    path: str = "path",
    length: str = "length",
    content: str = "content",
    extra_skip_dirs: Iterable[str] = (),
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Drop noise directories, binary formats, oversized files and binary contents.

    ``path`` is relative to the scanned root. On a ``binaryFile`` scan the length test is
    pushed to the source, so the contents of oversized files are not read.
    """
    return files.where(
        f"{length} <= {max_bytes} AND NOT {in_skipped_dir(path, extra_skip_dirs)} "
        f"AND NOT {has_skipped_extension(path)} AND NOT {looks_binary(content)}")


def decode_text(content: str) -> str:
    """UTF-8 text of bytes, without invalid bytes and with LF line ends."""
    raw = f"cast({content} AS string)"
    valid = f"if(is_valid_utf8({raw}), {raw}, replace(make_valid_utf8({raw}), '�', ''))"
    return normalize_newlines(valid)
