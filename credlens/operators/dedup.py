"""First finding per fingerprint across rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("path", "line", "column", "rule_id")


def first_per_fingerprint(
    findings: DataFrame, *, scope: Sequence[str] = (), order: Sequence[str] = ORDER
) -> DataFrame:
    """Keep the first finding of every fingerprint, within ``scope`` columns if given.

    ``detect`` has already reduced each text, so only findings are shuffled here, never
    texts. Spark ranks inside each map task first (window group limit), so a fingerprint
    that fills a third of the rows sends one row per map task.
    """
    window = Window.partitionBy(*scope, "fingerprint").orderBy(*order)
    return (findings.withColumn("_rank", F.row_number().over(window))
            .where("_rank = 1").drop("_rank"))
