"""Commit patches: added lines, detection on them, and attribution to the first commit.

One row of the patch table is one commit with the text of its zero-context patch. A patch
is parsed inside its row (split into files, then hunks, then lines), so no window and no
shuffle is needed, and each changed file becomes a row of its own before detection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from credlens.functions.sizing import broadcast_if_small, ensure_checkpoint_dir
from credlens.functions.text import bind, lit
from credlens.operators.dedup import first_per_fingerprint
from credlens.operators.detect import detect
from credlens.operators.suppress import suppress_baseline
from credlens.rules import RulePack
from credlens.schema import HISTORY

ATTRIBUTES = ("commit", "author", "email", "date", "summary")
_SALTS = 64
_PATH_LINE = r"\n\+{3} ([^\n]*)"


def newest_commits(patches: DataFrame, max_commits: int | None) -> DataFrame:
    """The newest ``max_commits`` non-merge commits of every repository (0/None: all).

    Only (repo, commit_seq) is ranked, first inside 64 salted groups, then over their
    survivors, so a repository with most of the commits is not one task. The result of the
    ranking, one cut-off per repository, is written once and then measured, so the keys are
    read once; the patches themselves are never sorted.
    """
    commits = patches.where("NOT coalesce(is_merge, false)")
    if not max_commits:
        return commits
    keys = commits.select("repo", "commit_seq")
    salted = keys.withColumn("_salt", F.pmod(F.hash("commit_seq"), F.lit(_SALTS)))
    newest = F.col("commit_seq").desc()
    for group in (("repo", "_salt"), ("repo",)):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(newest))
        salted = salted.withColumn("_rank", rank).where(F.col("_rank") <= max_commits).drop("_rank")
    cutoff = salted.groupBy("repo").agg(F.min("commit_seq").alias("_cutoff"))
    if not patches.isStreaming:
        ensure_checkpoint_dir(patches.sparkSession)
        cutoff = cutoff.checkpoint()
    return (commits.join(broadcast_if_small(cutoff), "repo")
            .where("commit_seq >= _cutoff").select(*patches.columns))


def _added_lines(section: str) -> str:
    """array<struct<line, text>> of the lines that one file section adds.

    Inside a hunk every line that starts with ``+`` is an added line, also one whose own
    text starts with ``++``; file headers can only stand before the first hunk. The pieces
    between hunk marks start with the line ranges; the piece before the first is the header.
    """
    # Lines end with LF. A CR before it belongs to the line end, any other starts a further line
    # of the text that has the same number in the file.
    whole = "if(endswith(l, '\\r'), left(l, length(l) - 1), l)"
    parts = f"if(contains(l, '\\r'), split(substring({whole}, 2), '\\r'), array(substring(l, 2)))"
    start = r"cast(regexp_extract(hunk, '^\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1) AS int)"
    added = "filter(split(hunk, '\\n'), l -> startswith(l, '+'))"
    hunks = f"filter(split({section}, '\\n@@ -'), (hunk, i) -> i > 0)"
    numbered = bind("first", start, (
        f"flatten(transform({added}, (l, i) -> transform({parts}, p -> named_struct('line', first + i, 'text', p))))"))
    return f"flatten(transform({hunks}, hunk -> {numbered}))"


def added_lines(patches: DataFrame) -> DataFrame:
    """One row per (commit, file) with added lines: ``path`` and ``added`` in file order."""
    others = [c for c in patches.columns if c != "patch"]
    sections = patches.selectExpr(
        *others, f"explode(split(patch, '\\ndiff --git ')) AS _section")
    headed = sections.selectExpr(
        *others, "_section",
        "trim(BOTH ' \\t\\r' FROM regexp_extract(substring_index(_section, '\\n@@ ', 1), "
        f"{lit(_PATH_LINE)}, 1)) AS _target",
    ).where("_target NOT IN ('', '/dev/null')")
    return headed.selectExpr(
        *others,
        "if(_target LIKE 'a/%' OR _target LIKE 'b/%', substring(_target, 3), _target) AS path",
        f"{_added_lines('_section')} AS added",
    )


def parse_patches(patches: DataFrame) -> DataFrame:
    """One row per added line: the commit's columns, path, new line number and text."""
    others = [c for c in patches.columns if c != "patch"]
    return added_lines(patches).select(*others, "path", F.inline("added"))


def added_content(patches: DataFrame, *, max_chars: int | None = None) -> DataFrame:
    """Per (commit, file): the added lines as one text, and the real number of each line.

    Whole texts by default. ``max_chars`` cuts each text, for those who want to bound the
    work per file as the single-machine tool does (it uses 1,048,576).
    """
    others = [c for c in patches.columns if c != "patch"]
    text = "array_join(added.text, '\\n')"
    return added_lines(patches).where("size(added) > 0").selectExpr(
        *others, "path",
        f"{f'left({text}, {max_chars})' if max_chars else text} AS content",
        "added.line AS line_map",
    )


def scan_history(
    patches: DataFrame,
    pack: RulePack | None = None,
    *,
    baseline: DataFrame | None = None,
    max_commits: int | None = None,
    max_chars: int | None = None,
    entropy: bool = False,
    min_entropy: float = 4.0,
    observation: Observation | None = None,
) -> DataFrame:
    """Findings in commit history, each attributed to the first commit that added it.

    The commit's own short columns ride along with the few findings, so there is no join
    back to the commits. The only shuffle is the one that finds the first occurrence.
    ``observation`` receives commits_scanned, commits without added lines included.
    """
    commits = newest_commits(patches, max_commits)
    if observation is not None:
        commits = commits.observe(observation, F.count(F.lit(1)).alias("commits_scanned"))
    contents = added_content(commits, max_chars=max_chars)
    found = detect(
        contents, pack, keep=("repo", "commit_seq", *ATTRIBUTES), line_map="line_map",
        entropy=entropy, min_entropy=min_entropy, source=HISTORY)
    first = first_per_fingerprint(
        found, scope=("repo",), order=("commit_seq", "line", "column", "rule_id"))
    if baseline is not None:
        first = suppress_baseline(first, baseline)
    return first.withColumn("commit_short", F.substring("commit", 1, 8))
