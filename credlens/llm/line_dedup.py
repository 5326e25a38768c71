"""Line deduplication across documents, in DataFrame functions alone.

Each text is exploded into its ``\\n`` lines with their positions. A line's key is the line
with white space (space, tab to carriage return) stripped at both ends and A-Z lower-cased;
keys of at least ``min_chars`` code points are hashed (two 64-bit hashes, so that a collision
is out of reach at any corpus size). Distinct documents are counted per hash: first one row
per (hash, document), then per hash, so a line that a third of all documents hold is
combined in every task before it is shuffled. Keys found in at least ``min_docs`` documents
lose every line except those in the largest doc_id holding them; the kept lines of each row
are put back together by position.

Defined results: null or empty text is one empty line; documents are told apart by doc_id,
and a null doc_id counts as one document that ranks below all others, so its lines of a
frequent key always go; rows that repeat a doc_id are one document, and each of them keeps
the lines its id keeps; every input row gives one output row; a document whose lines all go
keeps the empty text; an empty table gives an empty result; further columns are never read,
so names that clash with the ones made here do no harm. The row numbers that put lines back
in place come from ``monotonically_increasing_id`` on the input, which must therefore be a
deterministic scan (a Parquet table, as everywhere here), so a retried task numbers alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlens.functions.sizing import broadcast_if_small
from credlens.llm.shared import materialize

#: Fixed values of the contract: line white space, and the bounds of a frequent key.
SPACE = r"[\x20\x09-\x0D]"
MIN_CHARS, MIN_DOCS = 20, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The characters of SPACE, for trim.
_SPACES = " \t\n\x0b\x0c\r"


def line_key(line: F.Column) -> F.Column:
    """The key of a line: white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def exploded_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _doc, _pos, _line, _h1, _h2): every line of every row.

    Long keys get their two hashes; a short line gets nulls, which match nothing. A line of
    fewer than ``MIN_CHARS`` code points can't have a long key, so its key is not computed.
    """
    lines = numbered(docs, id_col, text_col).select(
        "_row", "_doc", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    key = F.when(F.char_length("_line") >= MIN_CHARS, line_key(F.col("_line")))
    long = F.char_length(key) >= MIN_CHARS
    return lines.select("_row", "_doc", "_pos", "_line", F.when(long, F.xxhash64(key)).alias("_h1"),
                        F.when(long, F.xxhash64(F.lit(1), key)).alias("_h2"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _doc, _text): each input row with its number, null text as empty."""
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_doc"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))


def frequent_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_h1, _h2, _keeper): keys held by ``min_docs`` documents or more, and their largest doc_id.

    One row per (hash, document) first, then a count per hash: both aggregations combine
    within each task before their shuffle, so no key, however common, reaches one task whole.
    """
    held = lines.filter(F.col("_h2").isNotNull()).select("_h1", "_h2", "_doc").distinct()
    counted = held.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.max("_doc").alias("_keeper"))
    return counted.filter(F.col("_n") >= min_docs).select("_h1", "_h2", "_keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, text (the kept lines joined by ``\\n``).

    Only the places of lines that go travel back to their rows, as one array per row that has
    any; each row then filters its own split text, so texts are never regrouped from lines.
    """
    # The long lines' keys, narrow, are written once: counting and dropping both read them.
    lines = materialize(exploded_lines(docs, id_col, text_col).filter(F.col("_h2").isNotNull())
                        .select("_row", "_doc", "_pos", "_h1", "_h2"))
    frequent = broadcast_if_small(materialize(frequent_keys(lines, min_docs)))
    gone = lines.join(frequent, ["_h1", "_h2"]).filter(
        ~F.col("_doc").eqNullSafe(F.col("_keeper")))
    drops = broadcast_if_small(materialize(gone.groupBy("_row").agg(F.collect_list("_pos").alias("_gone"))))
    rows = numbered(docs, id_col, text_col).join(drops, "_row", "left")
    split = F.split("_text", "\n", -1)
    gone_places = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    kept = F.filter(split, lambda line, i: ~F.array_contains(gone_places, i))
    return rows.select(F.col("_doc").alias(id_col), F.size(split).cast("long").alias("n_lines"),
                       F.size(gone_places).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias(text_col))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: the dedup of ``docs`` (doc_id, text) as digests."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
