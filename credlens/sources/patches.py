"""Commit patches as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each commit of the log starts with this mark at the start of a line. Lines of a patch
# start with one of a few printable characters, so no content can look like it.
COMMIT_MARK = "\x1e\x1fcommit\x1f"
GIT_LOG_FORMAT = "%x1e%x1fcommit%x1f%H%x1f%an%x1f%ae%x1f%aI%x1f%s"
GIT_LOG_COMMAND = (
    "git -c core.quotePath=false log --all --no-merges --reverse --no-color -p --unified=0 "
    f"--format={GIT_LOG_FORMAT}"
)


def read_git_log(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Patch rows of a text file written by ``GIT_LOG_COMMAND`` (one file per repository).

    The mark is the record separator of a text scan, so a large log is split over tasks and
    every record is one commit. ``commit_seq`` follows the order in the file: the start of
    the file split plus the record's number in it, which is smaller than the split's size.
    """
    records = (
        spark.read.option("lineSep", "\n" + COMMIT_MARK).text(path)
        .select("value", F.col("_metadata.file_block_start").alias("_start"))
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumn("value", F.regexp_replace(F.make_valid_utf8("value"), "^" + COMMIT_MARK, ""))
        .where("value <> ''")
    )
    header = F.split(F.substring_index("value", "\n", 1), "\x1f")
    fields = ("commit", "author", "email", "date", "summary")
    return records.select(
        F.lit(repo).alias("repo"),
        (F.col("_start") + F.col("_row")).alias("commit_seq"),
        *[F.coalesce(F.try_element_at(header, F.lit(i + 1)), F.lit("")).alias(name)
          for i, name in enumerate(fields)],
        F.lit(False).alias("is_merge"),
        F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 2)").alias("patch"),
    )
