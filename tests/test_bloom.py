import re

from pyspark.sql import functions as F

from credlens.functions import bloom
from credlens.operators.suppress import exclude_ignored
from credlens.operators.verify import candidates_of


def test_no_member_missed_and_few_false_positives(spark):
    keys = spark.range(10_000).select(F.concat(F.lit("repo/"), F.col("id").cast("string")).alias("k"))
    probe = spark.range(20_000).select(F.concat(F.lit("repo/"), F.col("id").cast("string")).alias("k"), (F.col("id") < 10_000).alias("listed"))
    filt = bloom.build(keys, "k")
    assert filt.bits == 2**17 and filt.table.count() <= filt.bits // bloom.ROW_BITS
    rows = bloom.might_contain(probe.union(spark.createDataFrame([(None, False)], "k string, listed boolean")), filt, "k").collect()
    assert all(r._maybe for r in rows if r.listed)
    false = sum(r._maybe for r in rows if not r.listed)
    assert false / 10_001 < 0.03  # about 1.2 % expected; the null key is never a member


def exchanged_columns(df):
    """The input columns of every Exchange in the formatted plan."""
    plan = df._jdf.queryExecution().explainString(spark_mode("formatted"))
    return [m for m in re.findall(r"\(\d+\) (?:Exchange|ShuffleExchange)[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)]


def spark_mode(name):
    from pyspark.sql import SparkSession
    jvm = SparkSession.getActiveSession()._jvm
    return getattr(jvm.org.apache.spark.sql.execution, "ExplainMode").fromString(name)


def test_long_ignore_list_moves_no_text(spark):
    docs = spark.createDataFrame([(f"repo/{i}", f"text {i}") for i in range(300)] + [(None, "nameless")], "path string, content string")
    ignored = spark.range(0, 5_000, 3).select(F.concat(F.lit("repo/"), F.col("id").cast("string")).alias("path"))
    small = {r.path for r in exclude_ignored(docs, ignored).collect()}
    out = exclude_ignored(docs, ignored, max_rows=100)
    assert {r.path for r in out.collect()} == small == {f"repo/{i}" for i in range(300) if i % 3} | {None}
    assert all("content" not in cols for cols in exchanged_columns(out))
    shuffled = docs.join(ignored.hint("shuffle_merge"), "path", "left_anti")
    assert any("content" in cols for cols in exchanged_columns(shuffled))  # the check can see a moved text


def test_candidates_of_findings(spark):
    docs = spark.createDataFrame([(f"f{i}.py", "x") for i in range(2_000)], "path string, content string")
    findings = spark.createDataFrame([("f7.py",), ("f70.py",), ("absent.py",), (None,)], "path string")
    got = {r.path for r in candidates_of(docs, findings).collect()}
    assert {"f7.py", "f70.py"} <= got and len(got) < 2 + 60
