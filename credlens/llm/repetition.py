"""Quality rules on repetition within a document, by suffix arrays over its words.

Documents of a task are taken in batches of bounded size; a batch is one suffix array in which
the words of different documents are different symbols. Suffixes that share a prefix of
``min_words`` or more lie in an LCP interval; the union of the intervals' spans gives the
covered words, the deepest interval the longest repeat. Whole texts count: a document longer
than a batch is a batch of its own.

Defined results: null and empty texts have no word and fail the base rule; a null id is passed
on; repeated rows are judged one by one; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlens.llm.suffix_array import SuffixArray, covered

#: Base rule: fewest words, and the largest share of words in repeated 3-word windows.
BASE_WORDS, BASE_WINDOW, BASE_SHARE = 50, 3, 0.5
#: A repeat counts from so many words on; limits for the share it covers and for the longest.
MIN_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.3, 100
#: Words of one batch, unless a single document has more.
BATCH_WORDS = 200_000
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"

_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
           ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
           ("kept", pa.bool_()), ("n_covered_words", pa.int64()), ("longest_repeat", pa.int64())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, n_covered_words bigint, longest_repeat bigint")


def _numbers(words: list[bytes], base: int) -> list[int]:
    """The words as numbers from ``base`` on, equal for equal words."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    return [number(w, base + len(known)) for w in words]


def word_array(texts: list[list[bytes]], least: int = BASE_WINDOW) -> tuple[SuffixArray, np.ndarray]:
    """One suffix array for texts given as words, and where each text starts (and the end)."""
    symbols: list[int] = []
    bounds = [0]
    for words in texts:
        symbols += _numbers(words, bounds[-1])
        bounds.append(len(symbols))
    edges = np.array(bounds)
    return SuffixArray(np.array(symbols, np.int64), np.repeat(edges[1:], np.diff(edges)), least=least), edges


def _repeats(texts: list[list[bytes]], min_words: int) -> Iterator[tuple[int, int, int]]:
    """(words in repeated 3-word windows, covered words, longest repeat) of each text."""
    array, edges = word_array(texts)
    n = edges[-1]
    longest = array.longest_shared()
    window = np.flatnonzero(longest >= BASE_WINDOW)
    deep = np.flatnonzero(longest >= min_words)
    counts = [np.r_[0, np.cumsum(c)] for c in (
        covered(window, np.full(len(window), BASE_WINDOW), n), covered(deep, longest[deep], n))]
    for a, b in zip(edges[:-1], edges[1:]):
        top = int(longest[a:b].max()) if b > a else 0
        yield int(counts[0][b] - counts[0][a]), int(counts[1][b] - counts[1][a]), top if top >= min_words else 0


def _judge(batches: Iterator[pa.RecordBatch], min_words: int, max_covered: float, max_longest: int) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        rows = []
        for (doc_id, n, *base), (again, cover, top) in zip(held, _repeats(texts, min_words)):
            failed = n < BASE_WORDS or again > BASE_SHARE * n
            rows.append((doc_id, n, *base, again, failed,
                         not failed and cover <= max_covered * n and top <= max_longest, cover, top))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    held, texts, total = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            raw = text.encode()
            words = raw.split()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            held.append((doc_id, len(words), len(text) - len(raw) + len(raw.translate(None, _SPACE)),
                         len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines))))
            texts.append(words)
            total += len(words)
            if total >= BATCH_WORDS or len(held) >= 10_000:
                yield flush()
                held, texts, total = [], [], 0
    if held:
        yield flush()


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                     max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document: the base counts, its verdict, covered words and longest repeat."""
    run = partial(_judge, min_words=min_words, max_covered=max_covered, max_longest=max_longest)
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, _DDL)


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", **limits: float) -> DataFrame:
    """The documents that pass, all columns as they are; one pass, no shuffle."""
    limits = {"min_words": MIN_WORDS, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST} | limits

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index(text_col)
            inner = pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(column)], ["doc_id", "text"])
            verdicts = [v for out in _judge(iter([inner]), **limits) for v in out.column("kept").to_pylist()]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS) -> DataFrame:
    """Every maximal repeat of a document: (doc_id, first_word, n_words, occurrences).

    ``first_word`` counts from 0 and is where the first occurrence starts.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                array, edges = word_array([(text.as_py() or "").encode().split()], min_words)
                symbols = np.empty(edges[-1], np.int64)
                symbols[array.order] = array.levels[0][1][array.order]
                left = np.r_[-1, symbols[:-1]][: edges[-1]]
                rows += [(doc_id, int(array.order[a:b + 1].min()), length, b - a + 1)
                         for length, a, b in array.maximal_repeats(left, min_words)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["doc_id", "first_word", "n_words", "occurrences"])

    ddl = "doc_id bigint, first_word bigint, n_words bigint, occurrences bigint"
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(find, ddl)
