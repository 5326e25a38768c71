"""What several operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credlens.functions.sizing import ensure_checkpoint_dir

#: The white space of all contracts here: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes up to which a table of counted size is broadcast; beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 * 1024 * 1024


def read_table(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a whole table; with no names, all of them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that all executors share, and cut its lineage.

    For narrow tables that are read more than once. Lost executors cost nothing that was
    written, and what ``monotonically_increasing_id`` gave stays as it is.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The URI of the folder that the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, as ``materialize`` does for wide rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, *strings: str) -> bool:
    """Whether a materialized table is within the bounds for a broadcast, rows and bytes."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(16 * len(df.columns)))
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return seen["n"] <= BROADCAST_ROWS and (seen["b"] or 0) <= BROADCAST_BYTES


def word_count(text: str | Column) -> Column:
    """How many words a text has; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Number the rows of a materialized table from 0 in a total order, without one task for all.

    Ranges of the order are counted apart; the driver sees one count for each range.
    """
    pid = "_range"
    ranged = materialize(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()))
    counts = sorted((r[pid], r["count"]) for r in ranged.groupBy(pid).count().collect())
    offsets, before = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(before)]
        before += n
    base = F.create_map(*offsets)[F.col(pid)] if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy(pid).orderBy(*order))
    return ranged.withColumn(name, (base + place - 1).cast("long")).drop(pid)


def tag_rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(row, id, digest) and more: whole rows beside a key made of id and text."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").cast("long").alias("id"), digest.alias("digest"), *more)


def keep_rows(tagged: DataFrame, marked: DataFrame) -> DataFrame:
    """The whole rows of which ``marked`` (id, digest, kept), one line per row, keeps the key.

    Only keys that go are joined to the rows, by an anti join. Rows that share id and text
    can't be told apart by their keys: where such a key is kept, one of its rows stays.
    """
    key = [F.coalesce("id", F.lit(-(2**63))).alias("id"), "digest"]
    # Dealt by both: copies share a digest, so its rows must not stay together.
    keys = materialize(marked.select(*key, "kept").repartition("id", "digest").groupBy("id", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("n > 1 or not kept"))
    rows = tagged.select("row", *key)
    once = rows.join(keys.select("id", "digest"), ["id", "digest"], "left_anti").select("row.*")
    repeats = keys.filter("kept").select("id", "digest")
    if repeats.isEmpty():
        return once
    again = rows.join(repeats, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    return once.unionByName(again.select("row.*"))
