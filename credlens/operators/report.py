"""Roll-ups, report rows and gates over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlens.functions import text as tx
from credlens.functions.text import lit
from credlens.operators.compliance import CONTROLS, FRAMEWORKS, TITLES, rule_class
from credlens.schema import SEVERITIES, VERIFICATION_STATES


def by_severity(findings: DataFrame) -> DataFrame:
    """Count per severity; severities without findings are absent."""
    return (findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("severity_rank", F.expr(tx.severity_rank("severity"))))


def by_verification(findings: DataFrame) -> DataFrame:
    return findings.groupBy("verification").agg(F.count(F.lit(1)).alias("n"))


def file_counts(content: str = "content") -> list[Column]:
    """Files scanned and files skipped because they could not be read."""
    return [F.count(content).alias("files_scanned"),
            F.count_if(F.col(content).isNull()).alias("files_skipped")]


def scan_stats(documents: DataFrame, *, content: str = "content") -> DataFrame:
    """The counters of a scan as a frame; ``scan_documents`` can observe them in passing."""
    return documents.agg(*file_counts(content))


def _counts(column: str, values: tuple[str, ...], prefix: str) -> list:
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]


def scan_summary(findings: DataFrame, scanned: DataFrame, *, scanned_as: str = "files_scanned") -> DataFrame:
    """One row of totals. ``scanned`` is the frame of scanned units (files or commits).

    Both sides are reduced to one row each and added up, so there is no join and the
    findings are read once for all counts.
    """
    totals = findings.agg(
        F.count(F.lit(1)).alias("findings"),
        F.countDistinct("fingerprint").alias("distinct_fingerprints"),
        F.count_if(F.col("verification") == "valid").alias("live"),
        *_counts("severity", SEVERITIES, "severity_"),
    )
    units = scanned.agg(F.count(F.lit(1)).alias(scanned_as))
    stacked = totals.unionByName(units, allowMissingColumns=True)
    return stacked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stacked.columns])


def report_summary(
    findings: DataFrame, *, scope: str, root: str, files_scanned: int = 0, commits_scanned: int = 0
) -> DataFrame:
    """The report without its findings, as one nested row.

    The findings are read once, by (severity, verification, rule class): at most 60 rows,
    from which all maps and the control list are built. Every finding maps to a control, so
    ``findings_mapped`` is their number; ``frameworks`` counts the implicated controls of each
    framework, also of those that have none. The counters of the scan come from its observation.
    """
    cells = findings.groupBy("severity", "verification", F.expr(rule_class()).alias("rule_class")).agg(
        F.count(F.lit(1)).alias("n"))
    cells = cells.agg(F.collect_list(F.struct("*")).alias("cells"))

    def as_map(column: str, values: tuple[str, ...]) -> str:
        """{value: sum of n} without the values that do not occur."""
        pairs = ", ".join(
            f"named_struct('key', {lit(v)}, 'n', aggregate(filter(cells, c -> c.{column} = {lit(v)}), "
            "0L, (acc, c) -> acc + c.n))" for v in values)
        return f"map_from_entries(filter(array({pairs}), p -> p.n > 0))"

    controls = ", ".join(
        f"named_struct('framework', {lit(f)}, 'control_id', {lit(i)}, 'title', {lit(TITLES[i])}, 'n', "
        f"aggregate(filter(cells, c -> c.rule_class IN ({', '.join(lit(c) for c in classes)})), "
        "0L, (acc, c) -> acc + c.n))" for (f, i), classes in _classes_of_controls().items())
    return cells.selectExpr(
        f"{lit(scope)} AS scope",
        "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ssXXX\") AS generated_at",
        f"{lit(root)} AS root",
        f"cast({files_scanned} AS bigint) AS files_scanned",
        f"cast({commits_scanned} AS bigint) AS commits_scanned",
        "aggregate(cells, 0L, (acc, c) -> acc + c.n) AS count",
        f"{as_map('severity', tuple(reversed(SEVERITIES)))} AS by_severity",
        f"{as_map('verification', VERIFICATION_STATES)} AS by_verification",
        f"filter(array({controls}), c -> c.n > 0) AS compliance",
    ).withColumns({
        "controls_implicated": F.size("compliance"),
        "findings_mapped": F.col("count"),
        "frameworks": F.expr(f"map_from_entries(transform(array({', '.join(lit(f) for f in FRAMEWORKS)}), "
                             "f -> struct(f, size(filter(compliance, c -> c.framework = f)))))"),
    })


def _classes_of_controls() -> dict[tuple[str, str], list[str]]:
    classes: dict[tuple[str, str], list[str]] = {}
    for name, framework, control in CONTROLS:
        classes.setdefault((framework, control), []).append(name)
    return classes


def severity_gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """One row: did any finding reach the severity, and how many did."""
    threshold = SEVERITIES.index(fail_on)
    at_or_above = F.count_if(F.col("severity_rank") >= threshold)
    return findings.agg(at_or_above.alias("n")).select((F.col("n") > 0).alias("failed"), "n")


def live_gate(findings: DataFrame) -> DataFrame:
    """One row: is any credential confirmed live, and how many are."""
    live = F.count_if(F.col("verification") == "valid")
    return findings.agg(live.alias("n")).select((F.col("n") > 0).alias("failed"), "n")


def report_rows(findings: DataFrame) -> DataFrame:
    """The fourteen published fields of a finding."""
    has = set(findings.columns)
    commit = {"commit": "commit_short", "author": "author", "date": "date"}
    return findings.select(
        "rule_id", "severity", "path", "line", "preview", "fingerprint", "description",
        "entropy", "source", "verifier", "verification",
        *[(F.col(c) if c in has else F.lit(None).cast("string")).alias(name)
          for name, c in commit.items()],
    )


def csv_rows(findings: DataFrame) -> DataFrame:
    """The nine fields of the CSV report; no preview."""
    return findings.select(
        "severity", "rule_id", "path", "line", "source", "verification",
        F.coalesce("verifier", F.lit("")).alias("verifier"), "fingerprint", "description")


def listing_rows(findings: DataFrame) -> DataFrame:
    """What a person reads: severity, rule, location, commit label, preview."""
    label = (F.expr("trim(concat_ws(' ', coalesce(commit_short, '?'), coalesce(author, '')))")
             if "commit_short" in findings.columns else F.lit(None).cast("string"))
    return findings.select(
        "severity", "severity_rank", "rule_id",
        F.concat_ws(":", "path", F.col("line").cast("string")).alias("location"),
        label.alias("commit_label"), "verification", "preview")


def worst_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity_rank"), "path", "line", "column", "rule_id")


def html_rows(findings: DataFrame) -> DataFrame:
    """Findings as escaped HTML table rows, for the HTML report."""
    def escaped(column: str) -> str:
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            column = f"replace({column}, {lit(raw)}, {lit(entity)})"
        return f"replace({column}, {lit(chr(39))}, '&#x27;')"

    rows = listing_rows(findings)
    cells = ", ".join(f"'<td>', {escaped(c)}, '</td>'" for c in (
        "severity", "rule_id", "location", "coalesce(commit_label, '')", "verification", "preview"))
    return rows.selectExpr("severity_rank", "location", "rule_id", f"concat('<tr>', {cells}, '</tr>') AS html")
