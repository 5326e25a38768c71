"""Near-duplicate detection: SimHash fingerprints, linked by a binary trie self-join.

Distinct fingerprints are the leaves of binary tries. Two that differ in three bits or fewer
agree in one of their four 16-bit blocks, so there are four tries, each with another block
moved to the front: the levels of that block are the shuffle key and cost no errors. Below,
a task walks pairs of nodes together, adds the bits in which they part, and drops a pair as
soon as it has more than three. Links become the edges of a forest within the task, at most
one for each fingerprint, so a dense group sends no list of its pairs. The forests of all
tasks are joined to components by star contraction.

A block value shared by more than ``unit`` fingerprints is split by the bits that follow into
pairs of subtrees within three bits of each other.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a
null id takes part but is no component's id unless all its ids are null (then null); repeated
rows are in one component; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlens.llm.shared import fits_broadcast, keep_rows, materialize, tag_rows

#: Words of a shingle, seed of its hash, bits of a fingerprint, and the error budget of a link.
SHINGLE, SEED, BITS, ERRORS = 3, 42, 64, 3
#: Bits of the block that leads a trie; with ERRORS + 1 blocks one is free of errors.
BLOCK = BITS // (ERRORS + 1)
#: Fingerprints below one block value before it is split, and node pairs walked at a time.
UNIT, FRONTIER = 1 << 22, 1 << 19
#: Fingerprints gathered before a task walks its tries (one block value at least).
GATHER = 1 << 19


def fingerprint(text: str) -> int:
    """64 bits, unsigned; a bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, stops[:-SHINGLE] + 1].tolist()
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(joined[a:b], SEED) for a, b in zip(starts, stops[SHINGLE - 1:].tolist())], ">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py() or "") for t in batch.column(0)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints)],
                                         [*batch.schema.names[1:], "print"])


def fingerprints(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """The kept columns and ``print``, the fingerprint as a signed long."""
    source = docs.select(text.alias("text"), *keep)
    kinds = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[1:])
    return source.mapInArrow(_fingerprints, kinds + ", print bigint")


class _Forest:
    """Links within one task, kept as a forest over positions."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[at]
            if (up == at).all():
                return at
            at = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.root, b, a)


def link_sorted(units: np.ndarray, sides: np.ndarray, prints: np.ndarray, errors: int = ERRORS,
                frontier: int = FRONTIER) -> np.ndarray:
    """For every position, the first position linked to it, over fingerprints sorted by (unit, side, print).

    A unit whose rows are all on side 0 is walked against itself; one with rows on sides 0
    and 1 is a pair of subtrees, of which one is walked against the other.
    """
    n = len(prints)
    forest = _Forest(n)
    nodes = np.flatnonzero(np.r_[True, (units[1:] != units[:-1]) | (sides[1:] != sides[:-1])])
    stops = np.r_[nodes[1:], n]
    second = np.r_[False, units[nodes[1:]] == units[nodes[:-1]]]
    crossed = np.r_[second[1:], False]
    alone = ~crossed & ~second & (sides[nodes] == 0)
    a0 = np.r_[nodes[alone], nodes[crossed]]
    a1 = np.r_[stops[alone], stops[crossed]]
    b0 = np.r_[nodes[alone], nodes[second]]
    b1 = np.r_[stops[alone], stops[second]]
    work = [(0, a0, a1, b0, b1, np.zeros(len(a0), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while work:
        depth, a0, a1, b0, b1, wrong = work.pop()
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[single], b0[single]
        close = np.bitwise_count(prints[x] ^ prints[y]) <= errors
        forest.link(x[close], y[close])
        a0, a1, b0, b1, wrong = (v[~single] for v in (a0, a1, b0, b1, wrong))
        if depth == BITS:  # equal fingerprints are linked where both sides hold them
            forest.link(a0, b0)
            continue
        if not len(a0):
            continue
        if len(a0) > frontier:
            half = len(a0) // 2
            work += [(depth, *(v[:half] for v in (a0, a1, b0, b1, wrong))), (depth, *(v[half:] for v in (a0, a1, b0, b1, wrong)))]
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((prints >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int32)]
        sums = ones[depth]
        am, bm = a1 - (sums[a1] - sums[a0]), b1 - (sums[b1] - sums[b0])
        own = a0 == b0
        parts = [(a0, am, b0, bm, wrong, None), (am, a1, bm, b1, wrong, None),
                 (a0, am, bm, b1, wrong + 1, None), (am, a1, b0, bm, wrong + 1, ~own)]
        kept = []
        for p0, p1, q0, q1, w, where in parts:
            live = (p1 > p0) & (q1 > q0) & (w <= errors) & ~((p0 == q0) & (p1 - p0 == 1))
            live = live if where is None else live & where
            kept.append([v[live] for v in (p0, p1, q0, q1, w)])
        work.append((depth + 1, *(np.concatenate(v) for v in zip(*kept))))
    return forest.find(np.arange(n))


def _walk(batches: Iterator[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, side, turned, print) sorted by the first three; yields forest edges."""
    def links(table: pa.Table) -> pa.RecordBatch:
        unit, side, turned, own = (c.to_numpy() for c in table.columns)
        order = np.lexsort((turned.view(np.uint64), side, unit))
        unit, side, turned, own = unit[order], side[order], turned[order].view(np.uint64), own[order]
        first = own[link_sorted(unit, side, turned, errors)]
        linked = first != own
        return pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(first[linked])], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        if not len(batch):
            continue
        unit = batch.column(0).to_numpy()
        if rows >= GATHER:  # cut where a unit ends
            cut = int(np.searchsorted(unit != held[-1].column(0)[-1].as_py(), True))
            if cut < len(batch):
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += len(batch)
    if held:
        yield links(pa.Table.from_batches(held))


def _masks(bits: int, errors: int) -> list[int]:
    return sorted(sum(1 << b for b in c) for k in range(errors + 1) for c in combinations(range(bits), min(k, bits)))


def link_fingerprints(prints: DataFrame, errors: int = ERRORS, unit: int = UNIT, split_bits: int = 6) -> DataFrame:
    """Edges (u, v) of distinct fingerprints (print bigint) that connect all links."""
    turned = [F.struct(F.lit(k).alias("k"), (F.shiftleft("print", BLOCK * k)
              .bitwiseOR(F.shiftrightunsigned("print", BITS - BLOCK * k)) if k else F.col("print")).alias("turned"))
              for k in range(errors + 1)]
    tries = prints.select("print", F.explode(F.array(*turned)).alias("t")).select("print", "t.*")
    block = F.shiftrightunsigned("turned", BITS - BLOCK)
    tries = tries.withColumn("block", F.shiftleft(F.col("k").cast("long"), BLOCK).bitwiseOR(block))
    counts = tries.groupBy("block").count().filter(F.col("count") > unit)
    hot = materialize(counts.select("block", F.lit(True).alias("hot")))
    plain = tries.select(F.shiftleft("block", 2 * split_bits).alias("unit"), F.lit(0).alias("side"), "turned", "print", "block")
    if not hot.isEmpty():
        hot = F.broadcast(hot) if fits_broadcast(hot) else hot
        own = F.shiftrightunsigned("turned", BITS - BLOCK - split_bits).bitwiseAND(F.lit((1 << split_bits) - 1))
        pairs = tries.join(hot, "block").withColumn("own", own).withColumn(
            "other", F.explode(F.array(*[F.lit(m).cast("long") for m in dict.fromkeys(_masks(split_bits, errors))]))
        ).withColumn("other", F.col("own").bitwiseXOR(F.col("other")))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        split = pairs.select(
            F.shiftleft("block", 2 * split_bits).bitwiseOR(F.shiftleft(low, split_bits)).bitwiseOR(high).alias("unit"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "turned", "print", "block")
        plain = plain.join(hot, "block", "left_anti").unionByName(split)
    dealt = plain.drop("block").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(partial(_walk, errors=errors), "u bigint, v bigint").distinct()


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of materialized edges (u, v); the root is the least node.

    Alternates large-star and small-star contraction; each round is written to the shared
    folder. Only a count and a checksum of the edges reach the driver.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("low"))

    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(least(both), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct())
        pairs = F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))))
        edges = materialize(large.join(least(large), "u").select(pairs.alias("e")).select("e.*").filter("u != v").distinct())
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(prints: DataFrame, **limits: int) -> DataFrame:
    """(print, root) of every distinct fingerprint in materialized rows with ``print``."""
    distinct = materialize(prints.select("print").distinct())
    roots = connect(link_fingerprints(distinct, **limits))
    return distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialize(fingerprints(docs, F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long").alias("doc_id")))
    roots = components(rows, **limits)
    firsts = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    classes = roots.join(firsts, "print")
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = classes.join(ids, "root").select("print", "component_id")
    return rows.join(known, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Whole rows of ``docs``: of each component the row with the smallest id (nulls last, then the digest)."""
    tagged = tag_rows(docs, id_col, text_col)
    rows = materialize(fingerprints(tagged, F.col(f"row.`{text_col}`"), F.col("id"), F.col("digest")))
    placed = rows.join(components(rows, **limits), "print")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("digest"))
    best = placed.groupBy("root").agg(F.min(order).alias("best"))
    marked = placed.join(best, "root").select("id", "digest", (order == F.col("best")).alias("kept"))
    return keep_rows(tagged, marked)
