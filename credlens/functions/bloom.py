"""A Bloom filter over a key column, built by one aggregate and probed map-side by broadcast joins.

Build: each key sets ``hashes`` bits ``pmod(xxhash64(i, key), bits)``; bits are OR-ed per 64-bit
word in one aggregation that combines in every task before its shuffle, and words are put in
rows of ``ROW_BITS`` bits. The table has at most ``MAX_BITS / ROW_BITS`` rows of 64 longs, so
its size has a bound (64 MiB) whatever the number of keys; with more keys only the share of
false positives grows (about 1.2 % at 10 bits a key and 4 hashes, the sizes chosen below up
to 53 million keys).

Probe: a row's bit places are computed in the row's own task, and each of them meets the
table by a broadcast hash join on the row index; no row of the probed side moves. A null key
is never a member. A false positive costs only an exact check later; a member is never missed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlens.functions.sizing import checkpointed

BITS_PER_KEY, HASHES, ROW_BITS, MAX_BITS = 10, 4, 4096, 2**29


@dataclass(frozen=True)
class Bloom:
    table: DataFrame  # (_r, _words): the words of each row of bits; rows without a set bit are absent
    bits: int
    hashes: int


def _places(key: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def build(keys: DataFrame, key: str, n_keys: int | None = None, hashes: int = HASHES) -> Bloom:
    """The filter of the non-null values of ``keys[key]``; ``n_keys`` (counted if not given) sizes it."""
    n = keys.count() if n_keys is None else n_keys
    bits = ROW_BITS
    while bits < n * BITS_PER_KEY and bits < MAX_BITS:
        bits *= 2
    column = F.col(f"`{key}`")
    places = keys.where(column.isNotNull()).select(F.explode(F.array(*_places(column, bits, hashes))).alias("p"))
    words = places.groupBy((F.col("p") / ROW_BITS).cast("long").alias("_r"), ((F.col("p") % ROW_BITS) / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("b"))
    rows = words.groupBy("_r").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m")).select(
        "_r", F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), lambda j: F.coalesce(F.col("m")[j], F.lit(0).cast("long"))).alias("_words"))
    # Written to the shared folder: every probe reads it, none builds it again.
    return Bloom(checkpointed(rows), bits, hashes)


def might_contain(df: DataFrame, bloom: Bloom, key: str, flag: str = "_maybe") -> DataFrame:
    """``df`` with a boolean ``flag``: false means surely not a key of the filter."""
    column = F.col(f"`{key}`")
    places = _places(column, bloom.bits, bloom.hashes)
    out = df.select("*", *[p.alias(f"_bloom_p{i}") for i, p in enumerate(places)])
    member = column.isNotNull()
    for i in range(bloom.hashes):
        row = bloom.table.select(F.col("_r").alias(f"_bloom_r{i}"), F.col("_words").alias(f"_bloom_w{i}"))
        out = out.join(F.broadcast(row), (F.col(f"_bloom_p{i}") / ROW_BITS).cast("long") == F.col(f"_bloom_r{i}"), "left")
        word = F.element_at(F.col(f"_bloom_w{i}"), ((F.col(f"_bloom_p{i}") % ROW_BITS) / 64).cast("int") + 1)
        bit = F.expr(f"cast(_bloom_p{i} % 64 AS int)")
        member = member & F.coalesce(F.call_function("shiftright", word, bit).bitwiseAND(1) == 1, F.lit(False))
    extra = [f"_bloom_p{i}" for i in range(bloom.hashes)] + [f"_bloom_r{i}" for i in range(bloom.hashes)] + [f"_bloom_w{i}" for i in range(bloom.hashes)]
    return out.withColumn(flag, member).drop(*extra)
