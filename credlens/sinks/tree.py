"""Writing a table of texts as a tree of files, a file for each bucket of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlens.sources.tree_source import _filesystem

#: Between two documents of one file.
SEPARATOR = "\n\x1e\n"


def tree_name(doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Column:
    """``s_<source>/<doc_id div 100>.txt``; a null doc_id goes to ``null-<2 hex of the text's SHA-256>``.

    Characters of the source other than letters, digits, ``_`` and ``-`` become ``_``. A bucket
    holds at most 100 ids, and null ids are spread by their text.
    """
    spread = F.concat(F.lit("null-"), F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 2))
    bucket = F.coalesce(F.expr(f"cast({doc_id} div 100 as string)"), spread)
    folder = F.concat(F.lit("s_"), F.regexp_replace(F.coalesce(F.col(source), F.lit("")), "[^A-Za-z0-9_-]", "_"))
    return F.concat(folder, F.lit("/"), bucket, F.lit(".txt"))


def write_tree(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> int:
    """Write the texts of each ``tree_name`` bucket of ``docs`` as the UTF-8 file ``folder/name``.

    A file holds its documents by (doc_id, text), joined by ``SEPARATOR``; null text is empty.
    Tasks write their own files; a retried task writes the same bytes again. Returns the files.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(tree_name(doc_id, text=text).alias("name"), F.struct(F.col(doc_id).alias("i"), body.alias("t")).alias("d"))
    files = named.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["t"]), SEPARATOR).alias("text"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _filesystem(folder)
        made: set[str] = set()
        for frame in frames:
            for name, content in frame.itertuples(index=False):
                parent = f"{base}/{name}".rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(content.encode("utf-8"))
            yield pd.DataFrame({"n": [len(frame)]})

    return files.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
