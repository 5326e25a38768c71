"""Controls implicated by findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlens.functions.text import lit

# Rule classes, frameworks in report order, control ids and titles.
KEY_RULES = ("private_key_block", "private_key_assignment", "gcp_service_account")
JWT_RULES = ("jwt",)
RULE_CLASSES = ("key", "jwt", "credential")
FRAMEWORKS = ("CWE", "OWASP_2021", "PCI_DSS_4", "NIST_800_53")
TITLES = {
    "CWE-798": "Use of Hard-coded Credentials",
    "CWE-321": "Use of Hard-coded Cryptographic Key",
    "CWE-522": "Insufficiently Protected Credentials",
    "A07:2021": "Identification and Authentication Failures",
    "A02:2021": "Cryptographic Failures",
    "PCI DSS 8.6.2": "Do not hard-code passwords/credentials in files or scripts",
    "PCI DSS 6.2.4": "Address common coding vulnerabilities in software development",
    "IA-5": "Authenticator Management",
    "SC-12": "Cryptographic Key Establishment and Management",
}
CONTROLS = (
    ("key", "CWE", "CWE-321"),
    ("jwt", "CWE", "CWE-522"),
    ("credential", "CWE", "CWE-798"),
    ("key", "OWASP_2021", "A02:2021"),
    ("jwt", "OWASP_2021", "A07:2021"),
    ("credential", "OWASP_2021", "A07:2021"),
    ("key", "PCI_DSS_4", "PCI DSS 8.6.2"),
    ("jwt", "PCI_DSS_4", "PCI DSS 8.6.2"),
    ("credential", "PCI_DSS_4", "PCI DSS 8.6.2"),
    ("key", "PCI_DSS_4", "PCI DSS 6.2.4"),
    ("jwt", "PCI_DSS_4", "PCI DSS 6.2.4"),
    ("credential", "PCI_DSS_4", "PCI DSS 6.2.4"),
    ("key", "NIST_800_53", "IA-5"),
    ("jwt", "NIST_800_53", "IA-5"),
    ("credential", "NIST_800_53", "IA-5"),
    ("key", "NIST_800_53", "SC-12"),
)


def rule_class(rule_id: str = "rule_id") -> str:
    keys = ", ".join(lit(r) for r in KEY_RULES)
    jwts = ", ".join(lit(r) for r in JWT_RULES)
    return (f"CASE WHEN {rule_id} IN ({keys}) THEN 'key' "
            f"WHEN {rule_id} IN ({jwts}) THEN 'jwt' ELSE 'credential' END")


def controls_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({lit(c)}, {lit(f)}, {lit(i)}, {lit(TITLES[i])})" for c, f, i in CONTROLS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule_class, framework, control_id, title)")


def with_controls(findings: DataFrame) -> DataFrame:
    """Findings x their controls; the control table has sixteen rows."""
    controls = F.broadcast(controls_table(findings.sparkSession))
    return findings.withColumn("rule_class", F.expr(rule_class())).join(controls, "rule_class")


def compliance_rollup(findings: DataFrame) -> DataFrame:
    """Findings per framework and control.

    Findings are counted per rule class first (three rows), so the join with the controls
    and the final sum see a handful of rows. A framework without any finding has one row
    with a null control and a count of 0.
    """
    spark = findings.sparkSession
    per_class = findings.groupBy(F.expr(rule_class()).alias("rule_class")).agg(F.count(F.lit(1)).alias("n"))
    controls = controls_table(spark)
    counted = (per_class.join(F.broadcast(controls), "rule_class")
               .groupBy("framework", "control_id", "title").agg(F.sum("n").alias("n")))
    rows = ", ".join(f"({lit(f)})" for f in FRAMEWORKS)
    frameworks = spark.sql(f"SELECT * FROM VALUES {rows} AS t(framework)")
    # At most one row per control, so this side is bounded by the control table.
    return (frameworks.join(F.broadcast(counted), "framework", "left")
            .select("framework", "control_id", "title", F.coalesce("n", F.lit(0)).alias("n")))


def controls_implicated(findings: DataFrame) -> DataFrame:
    """One row: number of implicated controls and number of findings mapped to them."""
    per_class = findings.groupBy(F.expr(rule_class()).alias("rule_class")).agg(F.count(F.lit(1)).alias("n"))
    joined = per_class.join(F.broadcast(controls_table(findings.sparkSession)), "rule_class")
    return joined.agg(
        F.countDistinct("framework", "control_id").alias("controls_implicated"),
        # Every rule class has exactly one CWE, so this counts each finding once.
        F.coalesce(F.sum(F.when(F.col("framework") == "CWE", F.col("n"))), F.lit(0)).alias("findings_mapped"),
    )
