"""Removal of repeated byte strings, by common-prefix interval trees over suffix arrays.

Whatever a text shares with another place for ``LENGTH`` bytes or more is removed. To bring
equal windows of that length together without sorting all suffixes of the corpus in one place:

1. Every window has an anchor, the ``GRAM``-byte string in it with the least hash; windows that
   are equal have equal anchors. Neighbouring windows of one anchor make a context, some 550
   bytes. Only hashes of anchors and contexts are shuffled; an anchor seen once is dropped.
2. Texts are gathered once for the contexts that are left; each distinct context is cut out once.
3. All contexts of an anchor meet in one task, which builds an enhanced suffix array over them.
   A stack scan walks the tree of LCP intervals and tests left-extension diversity: the maximal
   repeats come out as groups with all their occurrences.
4. Occurrences are carried to every document that holds the context, and their union is removed.

An anchor with more than ``UNIT`` distinct contexts (a passage that very many documents share) is
split by content: windows are cut finer, and each piece goes by the bytes that all its windows
have in common. Pieces that only one place holds drop out. At the finest cut a piece is one window.

Defined results: null text is empty; texts below ``LENGTH`` bytes keep everything; repeated rows
and equal texts repeat each other; null ids are passed on; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlens.llm.shared import fits_broadcast, materialize, stage_table
from credlens.llm.suffix_array import SuffixArray, covered

#: Bytes of a repeat, and of the string that anchors it.
LENGTH, GRAM = 400, 64
#: Distinct contexts of one anchor in one suffix array; bytes of one batch of smaller anchors.
UNIT, BATCH = 2048, 1 << 20
#: Windows of a piece when an anchor is split, coarse to fine.
CUTS = (32, 4, 1)
#: Bytes that are hashed at a time; positions in a block take BLOCK_BITS of a hash.
BLOCK, BLOCK_BITS = 1 << 20, 21
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << BLOCK_BITS) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, BLOCK + LENGTH + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK + LENGTH + 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    n = len(data)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _DOWN[:n], dtype=np.uint64)]
    h = (sums[GRAM:] - sums[:-GRAM]) * _UP[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each position on."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram, ctx, start, windows, anchor) of all contexts of texts data[offsets[i]:offsets[i + 1]].

    ``start`` is the first window's position in ``data``, ``anchor`` counts from there; the
    context is data[start:start + windows - 1 + LENGTH].
    """
    found = []
    view = memoryview(data)
    starts = offsets[:-1]
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    for low in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        high = min(low + BLOCK, len(data) - LENGTH + 1)
        first, last = np.clip(starts, low, high), np.clip(starts + counts, low, high)
        valid = covered(first - low, last - first, high - low)
        if not valid.any():
            continue
        h = _gram_hashes(data[low:high + LENGTH - 1])
        keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        anchor = (_window_minima(keys, LENGTH - GRAM + 1) & _LOW).astype(np.int64)
        fresh = valid & np.r_[True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]]
        stop = valid & np.r_[fresh[1:] | ~valid[1:], True]
        a, b = np.flatnonzero(fresh), np.flatnonzero(stop)
        spots = anchor[a]
        ctx = np.array([xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip((a + low).tolist(), (b + low + LENGTH).tolist())], np.uint64)
        found.append((h[spots].view(np.int64), ctx.view(np.int64), a + low, b - a + 1, spots - a))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found))


_ANCHORS = ("gram bigint, ctx bigint, start int, windows int, anchor int")


def _lists(offsets: np.ndarray, columns: list[np.ndarray], kinds: list[pa.DataType]) -> pa.Array:
    fields = [pa.field(n, k) for n, k in zip(("gram", "ctx", "start", "windows", "anchor"), kinds)]
    values = pa.StructArray.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        text = batch.column(0).cast(pa.large_binary())
        _, where, body = text.buffers()
        offsets = np.frombuffer(where, np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        gram, ctx, start, windows, anchor = contexts(data, offsets)
        owner = np.searchsorted(offsets, start, "right") - 1
        edges = np.searchsorted(owner, np.arange(len(text) + 1))
        found = _lists(edges, [gram, ctx, start - offsets[owner], windows, anchor], kinds)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(offsets)), found],
                                         [*batch.schema.names[1:], "n_bytes", "found"])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _refine(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[pa.RecordBatch]:
    """Contexts (key, text, found) cut into pieces of ``cut`` windows at fixed distances from the anchor."""
    for batch in batches:
        rows = []
        for key, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = text.encode()
            for f in found:
                spot = f["start"] + f["anchor"]
                low, high = f["start"] - spot, f["start"] + f["windows"] - spot  # windows, relative to the anchor
                for piece in range(low // cut, (high - 1) // cut + 1):
                    a, b = max(low, piece * cut), min(high, (piece + 1) * cut)
                    core = raw[spot + (piece + 1) * cut - 1:spot + piece * cut + LENGTH]
                    gram = _signed(xxhash.xxh3_64_intdigest(core, seed=(f["gram"] + piece) % (1 << 64)))
                    ctx = _signed(xxhash.xxh3_64_intdigest(raw[spot + a:spot + b - 1 + LENGTH]))
                    rows.append((key, gram, ctx, spot + a, b - a, -a))
        if rows:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             ["key", "gram", "ctx", "start", "windows", "anchor"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each context: (gram, ctx, n, body) of (key, text, found)."""
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()
            rows += [(f["gram"], f["ctx"], f["n"], raw[f["start"]:f["start"] + f["windows"] - 1 + LENGTH]) for f in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["gram", "ctx", "n", "body"])


def interval_groups(bodies: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(bytes, [(text, offset), ...]) of every maximal repeat of ``length`` bytes or more among texts."""
    data = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
    n = len(data) - 8
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    stops = np.cumsum(sizes)
    starts = stops - sizes
    packed = np.lib.stride_tricks.sliding_window_view(data, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)
    array = SuffixArray(data[:n], np.repeat(stops, sizes), packed, 8, length)
    left = np.r_[np.int64(-1), data[:n - 1].astype(np.int64)]
    left[starts[sizes > 0]] = -1 - np.flatnonzero(sizes > 0)  # nothing before a text: its like is nowhere else
    for size, low, high in array.maximal_repeats(left, length):
        places = array.order[low:high + 1]
        owner = np.searchsorted(stops, places, "right")
        yield size, list(zip(owner.tolist(), (places - starts[owner]).tolist()))


def _solve_groups(rows: list[tuple]) -> list[tuple]:
    """All occurrences: (gram, ctx, start, size, repeat)."""
    bodies = [r[3] for r in rows]
    out = [(g, c, 0, len(body), c) for g, c, n, body in rows if n > 1]
    for size, places in interval_groups(bodies):
        name = xxhash.xxh3_64_intdigest(bodies[places[0][0]][places[0][1]:places[0][1] + size]) >> 1
        out += [(*rows[i][:2], at, size, name) for i, at in places]
    return out


def _solve_spans(rows: list[tuple]) -> list[tuple]:
    """The union of all occurrences in each context: (gram, ctx, start, size, 0)."""
    edges = np.cumsum([0, *(len(r[3]) + 1 for r in rows)])  # one position between contexts
    starts, sizes = [edges[i] for i, r in enumerate(rows) if r[2] > 1], [len(r[3]) for r in rows if r[2] > 1]
    for size, places in interval_groups([r[3] for r in rows]):
        starts += [edges[i] + at for i, at in places]
        sizes += [size] * len(places)
    gone = covered(np.array(starts, np.int64), np.array(sizes, np.int64), int(edges[-1]))
    runs = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    owner = np.searchsorted(edges, runs[::2], "right") - 1
    return [(*rows[i][:2], a - int(edges[i]), b - a, 0)
            for i, a, b in zip(owner.tolist(), runs[::2].tolist(), runs[1::2].tolist())]


def _trees(batches: Iterator[pa.RecordBatch], solve: Callable, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, ctx, n, body) in the order of gram; whole grams are solved together."""
    def flush() -> Iterator[pa.RecordBatch]:
        if out := solve(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["gram", "ctx", "start", "size", "repeat"])

    held, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if row[0] != last and size >= batch_bytes:
                yield from flush()
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[3]), row[0]
    if held:
        yield from flush()


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One written row per document: doc_id, sha, key, n_bytes, found (its contexts)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    done = rows.mapInArrow(_anchor, f"doc_id bigint, sha binary, n_bytes bigint, found array<struct<{_ANCHORS.replace(' ', ': ').replace(',:', ',')}>>")
    return stage_table(done.withColumn("key", F.substring("sha", 1, 16)), "suffix-anchors")


def _again(found: DataFrame) -> DataFrame:
    """The rows whose gram is seen more than once."""
    grams = materialize(found.groupBy("gram").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1").select("gram"))
    return found.join(grams, "gram", "left_semi")


def _occurrences(docs: DataFrame, base: DataFrame, text_col: str, solve: Callable, unit: int, batch_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Texts that hold a repeated anchor (key, text), and what ``solve`` finds (key, start, size, repeat)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = materialize(_again(base.select("key", F.explode("found").alias("f")).select("key", "f.*")))
    keys = found.select("key").distinct()
    texts = stage_table(docs.select(F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"), text.alias("text"))
                        .groupBy("key").agg(F.first("text").alias("text")).join(keys, "key", "left_semi"), "suffix-texts")

    def with_texts(rows: DataFrame, *columns: str) -> DataFrame:
        return texts.join(rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("found")), "key").select("key", "text", "found")

    parts = []
    for cut in (*CUTS, None):
        distinct = found.groupBy("gram", "ctx").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "windows", "anchor")).alias("one"))
        counts = materialize(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("members")))
        hot = counts.filter(F.col("members") > unit).select("gram")
        more = cut is not None and not hot.isEmpty()
        hint = F.broadcast if more and fits_broadcast(hot) else (lambda df: df)
        cold = found.join(hint(hot), "gram", "left_anti") if more else found
        parts.append((cold, counts.filter(F.col("members") <= unit) if more else counts))
        if not more:
            break
        pieces = with_texts(found.join(hint(hot), "gram", "left_semi").distinct(), "gram", "start", "windows", "anchor")
        refined = pieces.mapInArrow(partial(_refine, cut=cut), "key binary, gram bigint, ctx bigint, start int, windows int, anchor int")
        copies = base.groupBy("key").count().filter("count > 1")
        refined = refined.join(copies, "key", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("count", F.lit(1)), F.lit(2))))).drop("count", "copy")
        found = materialize(_again(refined))

    out = []
    for rows, counts in parts:
        distinct = rows.groupBy("gram", "ctx").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "windows")).alias("one"))
        distinct = materialize(distinct.join(counts, "gram").select("gram", "ctx", "n", "members", "one.*"))
        bodies = with_texts(distinct.filter("members > 1"), "gram", "ctx", "start", "windows", "n").mapInArrow(
            _cut_out, "gram bigint, ctx bigint, n bigint, body binary")
        repeats = bodies.repartition("gram").sortWithinPartitions("gram").mapInArrow(
            partial(_trees, solve=solve, batch_bytes=batch_bytes), "gram bigint, ctx bigint, start bigint, size bigint, repeat bigint")
        alone = distinct.filter("members = 1 and n > 1").select(
            "gram", "ctx", F.lit(0).cast("long").alias("start"), (F.col("windows") + LENGTH - 1).cast("long").alias("size"), F.col("ctx").alias("repeat"))
        at = repeats.unionByName(alone).withColumnRenamed("start", "inside")
        out.append(rows.select("gram", "ctx", "key", "start").distinct().join(at, ["gram", "ctx"])
                   .select("key", (F.col("start") + F.col("inside")).alias("start"), "size", "repeat"))
    joined = out[0]
    for more in out[1:]:
        joined = joined.unionByName(more)
    return texts, joined


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = text.encode()
            gone = covered(np.array([s["start"] for s in spans]), np.array([s["size"] for s in spans]), len(raw))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            runs = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
            rows.append((key, int(gone.sum()), runs, hashlib.sha256(kept).digest(), kept))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "n_removed", "n_spans", "kept_sha", "kept"])


def _cleaned(docs: DataFrame, text_col: str, base: DataFrame, unit: int, batch_bytes: int) -> DataFrame:
    texts, occurrences = _occurrences(docs, base, text_col, _solve_spans, unit, batch_bytes)
    spans = occurrences.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    return texts.join(spans, "key").select("key", "text", "spans").mapInArrow(
        _remove, "key binary, n_removed bigint, n_spans bigint, kept_sha binary, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   unit: int = UNIT, batch_bytes: int = BATCH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    base = _base(docs, id_col, text_col)
    cleaned = _cleaned(docs, text_col, base, unit, batch_bytes).drop("kept")
    zero = F.lit(0).cast("long")
    return base.select("doc_id", "sha", "key", "n_bytes").join(cleaned, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  unit: int = UNIT, batch_bytes: int = BATCH) -> DataFrame:
    """Maximal repeats with all occurrences: (repeat, size, text_key, start), by distinct text.

    ``text_key`` is the first half of the text's SHA-256 in hex. A repeat is maximal within
    the windows of its anchor; longer ones come as groups that overlap.
    """
    base = _base(docs, id_col, text_col)
    _, occurrences = _occurrences(docs, base, text_col, _solve_groups, unit, batch_bytes)
    return occurrences.select("repeat", "size", F.lower(F.hex("key")).alias("text_key"), "start").distinct()
