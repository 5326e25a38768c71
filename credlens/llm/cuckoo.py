"""Exact deduplication with a cuckoo-filter index over text digests.

Digests are dealt to shards by their hash; each shard is one task with an index of its own.
A shard's filter answers "surely new" or "perhaps there"; a hit is verified against the full
key stored for that slot's bucket. Copies in one partition meet before the shuffle, so a
group of copies of any size sends at most one row for each buffer that saw it.

Defined results: null text counts as empty, and empty texts are equal to one another; a null
id ranks below every other; of rows that share text and id one stays, the others are dropped;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlens.llm.shared import keep_rows, materialize, tag_rows

#: Slots of a bucket, and how often an insertion may move another key before the index grows.
SLOTS, KICKS = 4, 256
#: Digests that one partition combines before it sends them on.
BUFFER = 50_000
_LOWEST = -(2**63)


class CuckooIndex:
    """A cuckoo filter whose slots point to the stored keys; insertion, lookup, deletion.

    ``find`` returns the entry of a key or -1. Partial-key hashing: a key has two buckets, the
    second of which follows from the first and the 16-bit fingerprint, so keys can be moved
    without rehashing. When an insertion finds no room, the table doubles and is filled again
    from the stored keys. Keys are digests of 16 bytes or more, evenly spread by themselves.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self.keys: list[bytes | None] = []
        self.free: list[int] = []
        self._table(buckets)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _table(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.entries = array("q", bytes(8 * SLOTS * buckets))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[slot] == mark and self.keys[self.entries[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        slot = self._slot(key)
        return self.entries[slot] if slot >= 0 else -1

    def insert(self, key: bytes) -> int:
        """Store a key that is not there yet; returns its entry."""
        if self.free:
            entry = self.free.pop()
            self.keys[entry] = key
        else:
            entry = len(self.keys)
            self.keys.append(key)
        if not self._place(key, entry):
            self._grow()
        return entry

    def delete(self, key: bytes) -> int:
        """Remove a key; returns the entry that becomes free, -1 if the key was not there."""
        slot = self._slot(key)
        if slot < 0:
            return -1
        entry = self.entries[slot]
        self.prints[slot] = 0
        self.keys[entry] = None
        self.free.append(entry)
        return entry

    def _place(self, key: bytes, entry: int) -> bool:
        mark, bucket, second = self._places(key)
        for turn in range(KICKS):
            for b in (bucket, second) if turn == 0 else (bucket,):
                for slot in range(SLOTS * b, SLOTS * b + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.entries[slot] = mark, entry
                        return True
            slot = SLOTS * bucket + (turn + entry) % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            entry, self.entries[slot] = self.entries[slot], entry
            bucket = self._other(bucket, mark)
        return False

    def _grow(self) -> None:
        buckets = 2 * self.buckets
        while True:
            self._table(buckets)
            if all(self._place(k, e) for e, k in enumerate(self.keys) if k is not None):
                return
            buckets *= 2


_PARTIAL = pa.schema([("digest", pa.binary()), ("top", pa.int64()), ("rid", pa.int64()), ("n", pa.int64())])
_PARTIAL_DDL = "digest binary, top bigint, rid bigint, n bigint"


def _best(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """Of two (id, row number), the larger id, then the smaller row number."""
    return a if (a[0], -a[1]) >= (b[0], -b[1]) else b


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), _PARTIAL.types)], schema=_PARTIAL)


def _combine(batches: Iterator[pa.RecordBatch], buffer: int) -> Iterator[pa.RecordBatch]:
    """Merge the copies of one partition; digests are passed on from ``buffer`` on."""
    held: dict[bytes, tuple[tuple[int, int], int]] = {}
    for batch in batches:
        for digest, top, rid in _columns(batch):
            key = (_LOWEST if top is None else top, rid)
            was = held.get(digest)
            held[digest] = (key, 1) if was is None else (_best(was[0], key), was[1] + 1)
        if len(held) >= buffer:
            yield _batch([(d, *k, n) for d, (k, n) in held.items()])
            held = {}
    if held:
        yield _batch([(d, *k, n) for d, (k, n) in held.items()])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: insert what is new, merge what is verified to be there already."""
    index, kept, sizes = CuckooIndex(), [], []
    for batch in batches:
        for digest, top, rid, n in _columns(batch):
            entry = index.find(digest)
            if entry < 0:
                index.insert(digest)
                kept.append((top, rid))
                sizes.append(n)
            else:
                kept[entry] = _best(kept[entry], (top, rid))
                sizes[entry] += n
    for at in range(0, len(kept), BUFFER):
        yield _batch([(k, *kept[e], sizes[e]) for e, k in enumerate(index.keys[at:at + BUFFER], at)])


def group_copies(rows: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Groups of equal digests: (digest, top, rid, n) of (digest, top, rid) rows.

    ``top`` is the largest id of the group (the lowest long for null), ``rid`` the number of
    the row that stays, ``n`` the rows of the group. A shard holds about 100 bytes a digest,
    so ``spark.sql.shuffle.partitions`` sets the memory of a task.
    """
    return (rows.select("digest", "top", "rid").mapInArrow(partial(_combine, buffer=buffer), _PARTIAL_DDL)
            .repartition("digest").mapInArrow(_index, _PARTIAL_DDL))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buffer: int = BUFFER) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("top"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("rid")))
    groups = group_copies(rows, buffer).select(
        "digest", F.when(F.col("top") != _LOWEST, F.col("top")).alias("keep_id"),
        F.col("rid").alias("keep_rid"), F.col("n").alias("group_size"))
    return rows.join(groups, "digest").select(
        F.col("top").alias("doc_id"), "keep_id", "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    tagged = tag_rows(docs, id_col, text_col)
    rows = materialize(tagged.select(F.coalesce("id", F.lit(_LOWEST)).alias("top"), "digest",
                                     F.monotonically_increasing_id().alias("rid")))
    groups = group_copies(rows).filter("n > 1").select("digest", F.col("top").alias("best"))
    marked = rows.join(groups, "digest").select(F.col("top").alias("id"), "digest", (F.col("top") == F.col("best")).alias("kept"))
    return keep_rows(tagged, marked)


def update_live(live: DataFrame, changes: DataFrame, shards: int = 64) -> DataFrame:
    """Live digests after a batch of changes: (digest, n) of which n > 0.

    ``live`` (digest binary, n bigint) is what an earlier call returned; ``changes``
    (seq bigint, op string 'insert' or 'delete', digest binary) are applied by ``seq`` within
    each shard. A delete of a digest that is not live changes nothing; a digest whose last
    copy goes leaves the filter. Rows with a null digest are passed over. ``shards`` sets how
    many digests a task holds.
    """
    shard = F.pmod(F.hash("digest"), F.lit(shards)).alias("shard")

    def apply(have: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        index, counts = CuckooIndex(), {}
        for digest, n in zip(have["digest"], have["n"]):
            entry = index.find(digest)
            entry = index.insert(digest) if entry < 0 else entry
            counts[entry] = counts.get(entry, 0) + int(n)
        for op, digest in ops.sort_values("seq", kind="stable")[["op", "digest"]].itertuples(index=False):
            entry = index.find(digest)
            if op == "insert":
                entry = index.insert(digest) if entry < 0 else entry
                counts[entry] = counts.get(entry, 0) + 1
            elif entry >= 0:
                counts[entry] -= 1
                if not counts[entry]:
                    index.delete(digest)
                    del counts[entry]
        return pd.DataFrame([(index.keys[e], n) for e, n in counts.items()], columns=["digest", "n"])

    keyed = lambda df, *c: df.filter("digest is not null").select(shard, "digest", *c).groupBy("shard")
    return keyed(live, "n").cogroup(keyed(changes, "seq", "op")).applyInPandas(apply, "digest binary, n bigint")
