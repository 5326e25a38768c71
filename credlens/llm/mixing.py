"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit key, a hash of its id. Of a source, the documents with the
smallest keys are taken once more than the rest, up to the source's budget. The threshold is
found without sorting: tokens are summed by source and key bucket, the bucket in which the
running sum passes the budget is found, and only that bucket is split again, until it holds
one key. Buckets nest, so each round reads fewer documents.

Defined results: null text has size 0; a null source is a source of its own, after all
others; a null id has the key of an empty string; documents of size 0 are taken 0 times. The
one document at the threshold is taken if that brings the source nearer to its target. Rows
that share the key at the threshold (repeated ids) share what is left in proportion to their
sizes, in whole words; where the documents themselves are taken, such rows are told apart by a
hash of the whole row instead, and each is taken or left whole. An empty table gives an empty
mix; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlens.llm.shared import fits_broadcast, materialize, ranked, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Budget as a share of all sizes, and the most that a document is taken.
SHARE, EPOCHS = 1.5, 2
#: Bits of a key, and those that one round of the histogram splits by.
KEY_BITS, ROUND_BITS = 60, 12
#: Copies of a source's threshold when it can't be broadcast, so that a hot source is dealt out.
SALTS = 64
#: Copies of one row that are written in one go.
BLOCK = 1000


def document_key(id_col: str | Column) -> Column:
    """60 bits of the MD5 of the id as text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    name = F.coalesce(column.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def allocate(sources: DataFrame) -> DataFrame:
    """Add weight and target to materialized (source, source_size, place) rows.

    A target is least(2 * size, weight * level); the level rises while sources reach their
    cap and leave their excess to the others. Only sums over all sources reach the driver.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    sources = sources.withColumn("weight", F.element_at(weights, (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int")))
    cap = F.col("source_size") * EPOCHS
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rest, open_weight = SHARE * total, None
    while True:
        full = F.lit(False) if open_weight is None else cap * F.lit(float(open_weight)) <= F.col("weight") * F.lit(rest)
        seen = sources.agg(F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        now = (SHARE * total - (seen["capped"] or 0), seen["w"])
        if now[1] is None or now == (rest, open_weight):
            break
        rest, open_weight = now
    level = F.col("weight") * F.lit(float(rest)) / F.lit(float(open_weight or 1))
    return sources.withColumn("target", F.least(cap.cast("double"), level))


def _running(hist: DataFrame) -> DataFrame:
    """The bucket of each source in which the running sum passes what is left to take."""
    by = Window.partitionBy("place").orderBy("bucket")
    before = F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (hist.withColumn("before", F.col("base") + F.coalesce(before, F.lit(0)))
            .filter("before <= extra and extra < before + tokens"))


def _edges(rows: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(place, edge, before, tokens, rows): the key in (place, extra, size, key, base) rows that passes each budget."""
    shift = KEY_BITS
    while True:
        shift -= ROUND_BITS
        bucket = F.shiftright("key", shift)
        edges = materialize(_running(
            rows.groupBy("place", "extra", "base", bucket.alias("bucket"))
            .agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("rows"),
                 F.min("key").alias("edge"), F.max("key").alias("last"))))
        if shift == 0 or edges.filter("edge < last").isEmpty():
            break
        inside = edges.select(F.col("place").alias("p"), F.col("bucket").alias("b"), F.col("before").alias("base"))
        rows = rows.drop("base").join(hint(inside), (F.col("place") == F.col("p")) & (bucket == F.col("b"))).drop("p", "b")
    return edges.select("place", "edge", "before", "tokens", "rows")


@dataclass
class Mix:
    """Per-source decisions; ``apply`` adds them to documents."""

    thresholds: DataFrame
    small: bool

    def apply(self, docs: DataFrame) -> DataFrame:
        """Add source_size, target and taken to rows with (source, size, key)."""
        t = self.thresholds
        if self.small:
            joined = docs.join(F.broadcast(t), docs["source"].eqNullSafe(t["mix_source"]))
        else:
            t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            docs = docs.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
            joined = docs.join(t, docs["source"].eqNullSafe(t["mix_source"]) & (docs["salt"] == t["salt"]))
        left = F.col("extra") - F.col("before")
        nearest = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(0)
        shared = F.floor(left * F.col("size") / F.col("tokens"))
        more = (F.when(F.col("key") < F.col("edge"), F.col("size"))
                .when((F.col("key") == F.col("edge")) & (F.col("rows") == 1), nearest)
                .when(F.col("key") == F.col("edge"), shared).otherwise(0))
        return joined.withColumn("taken", (F.col("full") * F.col("size") + more).cast("long"))


def plan_mix(sized: DataFrame) -> Mix:
    """Find every source's threshold from a materialized (source, size, key) table."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = allocate(ranked(totals, "place", F.col("source").asc_nulls_last()))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(EPOCHS))).otherwise(0)
    sources = materialize(sources.withColumn("full", full.cast("long"))
                          .withColumn("extra", F.col("target") - F.col("full") * F.col("source_size")))
    small = fits_broadcast(sources, "source")
    hint = F.broadcast if small else (lambda df: df)

    keys = sources.select(F.col("source").alias("s"), "place", "extra")
    rows = sized.join(hint(keys), sized["source"].eqNullSafe(F.col("s"))).select("place", "extra", "size", "key")
    at = _edges(rows.withColumn("base", F.lit(0).cast("long")), hint)
    thresholds = sources.join(hint(at), "place", "left").withColumnRenamed("source", "mix_source")
    return Mix(materialize(thresholds.drop("weight")), small)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key) of every document."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       word_count(F.col(f"`{text_col}`")).alias("size"), document_key(f"`{id_col}`").alias("key"))


def mix_sources(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = materialize(sizes(docs, **columns))
    return plan_mix(sized).apply(sized).select("doc_id", "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, text_col: str = "text", **columns: str) -> DataFrame:
    """The mixed documents themselves: a document taken twice is there twice, always whole.

    Rows that share the key at the threshold (repeated ids) have a threshold of their own among
    them, by a hash of the whole row. Rows that are equal in all columns are taken as often as
    brings the source nearest to its target.
    """
    names = docs.columns
    plan = plan_mix(materialize(sizes(docs, text_col=text_col, **columns)))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    c = {"id_col": "doc_id", "source_col": "source"} | columns
    tagged = docs.select(row, F.col(f"`{c['source_col']}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"),
                         document_key(f"`{c['id_col']}`").alias("key"))
    rows = plan.apply(tagged).filter("size > 0")
    shares = F.coalesce((F.col("key") == F.col("edge")) & (F.col("rows") > 1), F.lit(False))
    copies = F.when(shares, F.col("full")).otherwise(F.floor(F.col("taken") / F.col("size"))).cast("int")
    mixed = rows.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
    if plan.thresholds.filter("rows > 1").isEmpty():
        return mixed
    hint = F.broadcast if plan.small else (lambda df: df)
    tied = rows.filter(shares).select("row", "place", "extra", "before", "size", document_key(F.to_json("row")).alias("tie"))
    inner = _edges(materialize(tied.select("place", "extra", F.col("before").alias("base"), "size", F.col("tie").alias("key"))), hint)
    inner = inner.select(F.col("place").alias("p"), F.col("edge").alias("inner_edge"), F.col("before").alias("inner_before"))
    tied = tied.join(hint(inner), F.col("place") == F.col("p"))
    below = tied.filter("tie < inner_edge").select("row.*")
    left = F.col("extra") - F.col("inner_before")
    times = F.floor((2 * left + F.col("size")) / (2 * F.col("size"))).cast("long")
    last = tied.filter("tie = inner_edge").dropDuplicates(["place", "tie"]).select("row", times.alias("times")).filter("times > 0")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / BLOCK)))
    dealt = last.select("row", "times", block.alias("block")).repartition(F.col("block"))
    each = F.least(F.lit(BLOCK), F.col("times") - BLOCK * F.col("block")).cast("int")
    at = dealt.select("row", F.explode(F.array_repeat(F.lit(0), each))).select("row.*")
    return mixed.unionByName(below).unionByName(at)
