"""How far each source of a language departs from the others and from the language as a whole.

Counting is done where the texts are read. Each Arrow batch of (lang, source, text) is one
byte array: A-Z are lower-cased in place, terms are the runs of letter bytes (ASCII letters
and every byte of a non-ASCII character, which is what the term pattern of the contract
means on UTF-8), never across documents; a long batch is taken in slices of ``SLICE_BYTES``, so
that memory follows no batch size. Terms are then bucketed by length: one of up to 8
bytes becomes one uint64 word, one of 9 to 16 bytes two words (big-endian and zero-padded,
so the order of words is the order of bytes; a term holds no zero byte), and these are
radix-sorted with (group, term, document) in 16-bit digits and counted by runs. Longer terms
go to buckets of their own length and are sorted as bytes. Each batch sends (lang, source,
term, occurrences, documents), which Spark adds up over the whole table.

Scores, all in exact integers (decimals where a product could pass 64 bits): a lang keeps
the V terms found in at least ``min_docs`` of its documents; a group (the lang as a whole, or
one of its (lang, source) groups) with N occurrences of kept terms gives a kept term that
occurs ``count`` times there ``p = 1 + floor(10^9 * (count + 1) / (N + V))``; against a second
distribution q a term weighs ``f = floor((p - q)^2 / q)``.

- part ``pair``: for each other source of the lang, the sum of f over all kept terms, with q
  the other source's; terms absent from both add the same amount each, so only terms present
  in one of the two are joined, the rest are counted;
- part ``term``: each kept term present in the group whose p is above the lang's, valued f
  with q the lang's; only ranks up to ``top``.

Ranks count from 1 in each (lang, source, part), value descending, then the item's UTF-8
bytes ascending. Defined results: null lang, source or text are read as empty; a group with
no terms still has its pair rows; a lang with one source has no pair rows; V = 0 gives pair
values of 0 and no term rows; an empty table gives an empty result; further columns are
never read. A source that holds a third of all rows is no one task: counts combine in each
task, pair sums are made in each task (in numpy, 64-bit or Python integers) before their
shuffle, and the top of each group is cut within each task first. A kept term is one row with
its counts in its sources, written once and read by the totals and both parts. The sources of
one lang travel with its terms, so their number should stay small (tens to thousands), as
sources of a mix do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credlens.functions.sizing import broadcast_if_small
from credlens.llm.shared import materialize

#: Fixed values of the contract: a term is in at least MIN_DOCS documents of its lang; the scale of p; the ranks kept.
MIN_DOCS, SCALE, TOP = 3, 10**9, 200
#: Terms up to this many bytes are packed into uint64 words; longer ones are sorted as bytes.
PACKED_BYTES = 16

#: Bytes of text whose terms are counted at a time; a worker takes about 200 MB for their arrays.
SLICE_BYTES = 8 << 20
#: Cells (terms by sources) whose p are worked on at a time.
CELLS = 1 << 20

COUNT_SCHEMA = "lang string, source string, term string, n long, docs long"
PAIR_SCHEMA = "lang string, i int, j int, f long, u long"


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The permutation that sorts rows by ``keys`` (uint64 arrays, most significant first).

    Least significant digit first, 16 bits at a time; each pass is a stable sort of 16-bit
    digits, which numpy does as a counting sort. Digits that are equal in all rows are skipped.
    """
    n = len(keys[0]) if keys else 0
    order = np.arange(n)
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = ((key[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if n and digit.min() != digit.max():
                order = order[np.argsort(digit, kind="stable")]
    return order


def run_counts(sorted_keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over rows sorted by (keys, docs): first row of each run of equal keys, its length, its distinct docs."""
    n = len(docs)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for key in sorted_keys:
        change[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(change)
    new_doc = change.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    return first, np.diff(np.append(first, n)), np.add.reduceat(new_doc.astype(np.int64), first)


def term_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased and zero padding, starts, lengths, document of each term)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    letter = (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A))
    n = len(data)
    doc_start, doc_end = np.zeros(n, bool), np.zeros(n, bool)
    doc_start[offsets[:-1][offsets[:-1] < n]] = True
    doc_end[offsets[1:][offsets[1:] > 0] - 1] = True
    before = np.concatenate(([False], letter[:-1]))
    after = np.concatenate((letter[1:], [False]))
    starts = np.flatnonzero(letter & (~before | doc_start))
    ends = np.flatnonzero(letter & (~after | doc_end)) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return np.concatenate((data, np.zeros(PACKED_BYTES, np.uint8))), starts, ends - starts, doc


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """(terms, width // 8) uint64 words of the terms' bytes, big-endian, zero-padded.

    A word is read at its place in the bytes (``data`` ends with ``PACKED_BYTES`` zeros) and what
    follows the term is shifted out, so no table of single bytes is made.
    """
    at = np.ndarray(len(data) - 7, ">u8", data, 0, (1,))  # the word that begins at each byte
    out = np.empty((len(starts), width // 8), np.uint64)
    for i in range(width // 8):
        spare = (8 * np.clip(8 * (i + 1) - lengths, 0, 8)).astype(np.uint64)  # bits behind the term
        word = at[starts + 8 * i].astype(np.uint64)
        low = np.minimum(spare, np.uint64(63))
        out[:, i] = np.where(spare == 64, np.uint64(0), word >> low << low)
    return out


def count_terms(groups: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term bytes, occurrences, documents) for each distinct (group, term) of a batch.

    ``groups`` gives each document's group as an integer.
    """
    data, starts, lengths, doc = term_spans(texts)
    group = groups[doc].astype(np.uint64)
    out_g, out_t, out_n, out_d = [], [], [], []
    for low, high in ((1, 8), (9, PACKED_BYTES)):
        pick = (lengths >= low) & (lengths <= high)
        if not pick.any():
            continue
        words = _packed(data, starts[pick], lengths[pick], high if high == 8 else PACKED_BYTES)
        keys = [group[pick], *words.T]
        order = radix_order([*keys, doc[pick].astype(np.uint64)])
        sorted_keys = [k[order] for k in keys]
        first, n, d = run_counts(sorted_keys, doc[pick][order])
        kept = np.ascontiguousarray(words[order][first].astype(">u8")).view(f"S{words.shape[1] * 8}").ravel()
        out_g.append(sorted_keys[0][first])
        out_t += kept.tolist()
        out_n.append(n)
        out_d.append(d)
    for length in np.unique(lengths[lengths > PACKED_BYTES]):
        pick = lengths == length
        terms = data[starts[pick][:, None] + np.arange(length)].view(f"S{length}").ravel()
        g, dd = group[pick], doc[pick]
        order = np.lexsort((dd, terms, g))
        first, n, d = run_counts([g[order], terms[order]], dd[order])
        out_g.append(g[order][first])
        out_t += terms[order][first].tolist()
        out_n.append(n)
        out_d.append(d)
    if not out_g:
        return np.zeros(0, np.uint64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_g), out_t, np.concatenate(out_n), np.concatenate(out_d)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``size`` bytes of text; Spark adds up their counts in the same task."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0), np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, SLICE_BYTES):
        langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
        codes = np.asarray(langs.indices, np.int64) * len(sources.dictionary) + np.asarray(sources.indices, np.int64)
        unique, groups = np.unique(codes, return_inverse=True)
        g, terms, n, d = count_terms(groups, batch.column(2))
        if not len(g):
            continue
        code = unique[g.astype(np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pc.take(langs.dictionary, pa.array(code // len(sources.dictionary))),
             pc.take(sources.dictionary, pa.array(code % len(sources.dictionary))),
             pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
            ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over the whole table: occurrences and documents of each term."""
    src = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = src.mapInArrow(_count_batches, COUNT_SCHEMA)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str, total: str, vocab: str, kind: str = "decimal(38,0)") -> str:
    """SQL for 1 + floor(SCALE * (count + 1) / (total + vocab)) in ``kind``: exact where no product passes it."""
    return f"(1 + (cast({SCALE} as {kind}) * cast({count} + 1 as {kind})) div cast({total} + {vocab} as {kind}))"


def _f(p: str, q: str) -> F.Column:
    """floor((p - q)^2 / q) of two SQL expressions."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def pair_sums(at: list[np.ndarray], n: list[np.ndarray], tots: np.ndarray, vocab: int,
              exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sum of f, terms) of each pair of sources, over the terms that occur in one of the two.

    ``at`` and ``n`` give the sources of each term and its counts there, ``tots`` all sources'
    totals. Each source is taken with the terms that occur in it, so the work follows the
    counts. ``exact`` says that 64 bits hold every product; else Python's integers do the work.
    """
    k, kind = len(tots), np.uint64 if exact else object
    f, u = np.zeros((k, k), kind), np.zeros((k, k), np.int64)
    scale, size = np.array(SCALE, kind), tots.astype(kind) + np.array(vocab, kind)
    step = max(1, CELLS // k)
    for low in range(0, len(at), step):
        rows = np.repeat(np.arange(len(at[low:low + step])), [len(a) for a in at[low:low + step]])
        columns, counts = np.concatenate(at[low:low + step]), np.concatenate(n[low:low + step])
        count, has = np.zeros((rows[-1] + 1, k), kind), np.zeros((rows[-1] + 1, k), bool)
        count[rows, columns] = counts.astype(kind)
        has[rows, columns] = True
        p = scale * (count + np.array(1, kind)) // size + np.array(1, kind)
        for j in range(k):
            here = has[:, j]
            ps, q, other = p[here], p[here, j][:, None], ~has[here]
            square = (np.maximum(ps, q) - np.minimum(ps, q)) ** np.array(2, kind)
            f[:, j] += (square // q).sum(axis=0)
            f[j] += np.where(other, square // ps, np.array(0, kind)).sum(axis=0)
            u[:, j] += len(ps)
            u[j] += other.sum(axis=0)
    return f, u


def _pair_sums(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    """Over rows (lang, vocab, tots, at, n) of terms: the task's sums (lang, i, j, f, u)."""
    sums = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = np.asarray(langs.indices)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            part = batch.take(np.flatnonzero(codes == code))
            at, n = (np.split(np.asarray(c.flatten()), np.cumsum(pc.list_value_length(c))[:-1]) for c in part.columns[3:])
            f, u = pair_sums(at, n, np.asarray(part.column(2)[0].values), part.column(1)[0].as_py(), exact)
            before = sums.get(lang, (0, 0))
            sums[lang] = f + before[0], u + before[1]
    for lang, (f, u) in sums.items():
        i, j = np.nonzero(u)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
             pa.array([int(x) for x in f[i, j]], pa.int64()), pa.array(u[i, j], pa.int64())], ["lang", "i", "j", "f", "u"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for all (lang, source) groups of ``docs`` (lang, source, text)."""
    groups = materialize(docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
                                       for c in ("lang", "source")]).distinct())
    numbered = materialize(groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("all")).select(
        "lang", F.posexplode("all").alias("at", "source")))

    # One row per kept term: its count in the lang, and its count in each source where it occurs.
    placed = F.collect_list(F.struct("at", "n")).alias("places")
    kept = materialize(term_counts(docs).join(broadcast_if_small(numbered), ["lang", "source"]).groupBy("lang", "term").agg(
        F.sum("docs").alias("df"), F.sum("n").alias("cl"), placed).filter(F.col("df") >= min_docs).select(
        "lang", "term", "cl", F.col("places.at").alias("at"), F.col("places.n").alias("n")))
    totals = kept.select("lang", F.inline(F.arrays_zip("at", "n"))).groupBy("lang", "at").agg(F.sum("n").alias("tot"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocab"), F.sum("cl").alias("ltot"), F.max("cl").alias("largest"))
    sized = materialize(numbered.join(totals, ["lang", "at"], "left").join(langs, "lang", "left").fillna(
        0, ["tot", "vocab", "ltot", "largest"]))

    # 64-bit arithmetic where SCALE * (count + 1) stays below 2^63 for every count (one aggregate
    # decides), else decimals; results are exact either way.
    largest = sized.agg(F.max("largest")).first()[0] or 0
    exact = (largest + 1) * SCALE < 2**63
    kind = "bigint" if exact else "decimal(38,0)"

    # part pair: from each kept term, f for every pair of sources with at least one where it occurs,
    # summed in each task before the shuffle. Terms absent from both sources add f(p(0), q(0))
    # each and are counted, not listed.
    sources = materialize(sized.groupBy("lang").agg(
        F.first("vocab").alias("vocab"), F.sort_array(F.collect_list(F.struct("at", "tot"))).alias("all")).select(
        "lang", "vocab", F.col("all.tot").alias("tots")))
    summed = kept.select("lang", "at", "n").join(broadcast_if_small(sources), "lang").select(
        "lang", "vocab", "tots", "at", "n").mapInArrow(partial(_pair_sums, exact=exact), PAIR_SCHEMA).groupBy("lang", "i", "j").agg(
        F.sum("f").alias("f"), F.sum("u").alias("u"))
    pairs = sized.alias("a").join(sized.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.at") != F.col("b.at"))).select(
        F.col("a.lang").alias("lang"), F.col("a.at").alias("i"), F.col("b.at").alias("j"), F.col("a.source").alias("source"),
        F.col("b.source").alias("other"), F.col("a.tot").alias("tota"), F.col("b.tot").alias("totb"), F.col("a.vocab").alias("vocab"))
    absent = F.when(F.col("vocab") > 0, (F.col("vocab") - F.coalesce("u", F.lit(0))) *
                    _f(_p("0", "tota", "vocab", kind), _p("0", "totb", "vocab", kind)))
    pair_rows = pairs.join(summed, ["lang", "i", "j"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
        (F.coalesce("f", F.lit(0)) + F.coalesce(absent, F.lit(0))).cast("long").alias("value"))

    # part term: each present term whose p is above the lang's.
    scored = kept.select("lang", "term", "cl", F.inline(F.arrays_zip("at", "n"))).join(broadcast_if_small(sized), ["lang", "at"]).select(
        "lang", "source", "term", F.expr(_p("n", "tot", "vocab", kind)).alias("p"), F.expr(_p("cl", "ltot", "vocab", kind)).alias("q"))
    term_rows = scored.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").cast("long").alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").cast("binary"))
    ranked_pairs = pair_rows.withColumn("rank", F.row_number().over(order))
    ranked_terms = term_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked_pairs.unionByName(ranked_terms)


def divergence_report(docs: DataFrame) -> DataFrame:
    """The audit of ``docs`` with the contract's columns and types."""
    out = divergence(docs)
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
