import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"

# Fake but well-formed values; split so that no scanner trips on this file.
AWS = "AK" + "IAZ7XQ4WL9PRT2KD8N"
AWS_SAMPLE = "AK" + "IAIOSFODNN7" + "EXAMPLE"
RANDOM_TOKEN = "Zk9Q2xL7mP4rT1vY8wB3nC6dF0aH5jK"
GITHUB = "gh" + "p_" + "a1B2" * 9


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("credlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table out of (path, content) pairs."""
    return lambda *rows: spark.createDataFrame(list(rows), "path string, content string")


@pytest.fixture(scope="session")
def rules_found():
    return lambda findings: sorted(r.rule_id for r in findings.select("rule_id").collect())
