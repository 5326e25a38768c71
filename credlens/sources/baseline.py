"""Reading and writing baselines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credlens.operators.suppress import baseline_entries, merge_baseline
from credlens.schema import BASELINE

_ENTRY = T.StructType([f for f in BASELINE.fields if f.name != "fingerprint"])
_JSON = T.StructType([
    T.StructField("fingerprints", T.ArrayType(T.StringType())),
    T.StructField("count", T.LongType()),
    T.StructField("entries", T.MapType(T.StringType(), _ENTRY)),
])


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline table (parquet directory); a missing path gives an empty baseline."""
    try:
        return spark.read.schema(BASELINE).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], BASELINE)
        raise


def load_baseline_json(spark: SparkSession, path: str) -> DataFrame:
    """A single-object JSON baseline: ``fingerprints`` list plus ``entries`` by fingerprint.

    When the list is empty the entries' keys count as the fingerprints.
    """
    raw = spark.read.schema(_JSON).option("multiLine", True).json(path)
    keyed = raw.select(
        F.coalesce("fingerprints", F.array().cast("array<string>")).alias("fps"),
        F.coalesce("entries", F.map_from_arrays(F.array().cast("array<string>"),
                                                F.array().cast(T.ArrayType(_ENTRY)))).alias("entries"),
    )
    listed = keyed.select(
        F.explode(F.when(F.size("fps") > 0, F.array_distinct("fps"))
                  .otherwise(F.map_keys("entries"))).alias("fingerprint"))
    entries = keyed.select(F.explode("entries").alias("fingerprint", "e")).select("fingerprint", "e.*")
    return listed.join(entries, "fingerprint", "left")


def write_baseline(
    findings: DataFrame, path: str, *, existing: str | None = None, reason: str | None = None
) -> str:
    """Write a baseline of ``findings`` to ``path``, merged with the one at ``existing``.

    ``existing`` must be another path: a job cannot overwrite what it still reads, and an
    executor lost half-way must not cost the old baseline.
    """
    if existing is not None and existing.rstrip("/") == path.rstrip("/"):
        raise ValueError("write the merged baseline to a new path, not over the one being read")
    rows = baseline_entries(findings, reason)
    if existing is not None:
        rows = merge_baseline(load_baseline(findings.sparkSession, existing), rows)
    rows.orderBy("fingerprint").write.mode("overwrite").parquet(path)
    return path
