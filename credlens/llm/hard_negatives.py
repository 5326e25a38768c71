"""Hard-negative mining with Four-Russians scoring of integer embeddings.

Each component x becomes ``floor(256 * x)``. For every anchor and every 8-dimension group, a
table of 256 subset sums is built (entry ``s`` is the sum of the anchor's components whose bit
is set in ``s``). A candidate is stored as bit planes: for each bit k of its two's-complement
components and each group, one byte of the group's k-th bits. Its exact inner product with an
anchor is then ``sum_k w_k * sum_g table_g[byte_{k,g}]`` with ``w_k = 2^k`` and the top plane
negative: one lookup per (plane, group) instead of eight multiplications, and all of them shared
by the anchors of a block.

The work is a fixed query set (the anchors) against all rows, in blocks: anchors are dealt to
blocks of at most ``anchor_block`` rows, candidates to chunks of at most ``chunk_rows`` rows,
and each (chunk, block) cell is one cogrouped task. Two passes: the first finds every anchor's
best same-label rows in each cell and keeps the first ``positives`` over all cells; the second,
with those scores known, finds each positive's first ``negatives`` different-label rows with
``80 * positive_score <= 100 * negative_score <= 100 * positive_score``. Per cell only those
few rows leave the task, and the group limits of Spark cut them again before each shuffle.

Defined results: rows with a null label, a null vector or a null or non-finite component take
no part; where vec_id is divisible by 7 the label first becomes ``(label + 1) % 10``; a null
vec_id is never an anchor and, among rows of equal score, comes after all others; vectors of
different lengths are compared over the positions both have; an anchor's own row is never its
positive, though another row with the same vec_id may be; repeated anchor rows give repeated
results; ties of score go to the smaller vec_id; an anchor without positives, or a positive
without negatives, gives no row; an empty table gives an empty result; further columns are
never read. Scores are exact: if ``dims * max|component|^2`` passes 2^59, a ValueError is raised
rather than a rounded score returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credlens.llm.shared import materialize

#: Fixed values of the contract: scale of components, anchors, relabelling, positives, negatives, score window.
SCALE, ANCHOR_EVERY, RELABEL_EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 7, 5, 5, 80, 100
#: Anchors in a block, candidate rows in a chunk, and anchors scored at once inside a task (memory).
ANCHOR_BLOCK, CHUNK_ROWS, SUB_BLOCK = 2048, 16384, 128
_COMMON = math.gcd(LOW, HIGH)
_LAST = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min
#: Row s of SUBSETS holds the 8 bits of s, lowest first.
SUBSETS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def bit_planes(q: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes: bit k of the 8 components of each group, two's complement."""
    rows, dims = q.shape
    out = np.empty((rows, bits, dims // 8), np.uint8)
    for k in range(bits):
        plane = ((q >> k) & 1).astype(np.uint8).reshape(rows, dims // 8, 8)
        out[:, k, :] = np.packbits(plane, axis=2, bitorder="little")[:, :, 0]
    return out


def subset_tables(a: np.ndarray) -> np.ndarray:
    """(anchors, groups, 256): the subset sums of each anchor's 8-dimension groups."""
    anchors, dims = a.shape
    return np.einsum("agi,si->ags", a.reshape(anchors, dims // 8, 8), SUBSETS)


def four_russians_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, rows) exact inner products from subset tables and bit planes: shift-add of lookups."""
    anchors, groups, _ = tables.shape
    rows, bits, _ = planes.shape
    total = np.zeros((anchors, rows), np.int64)
    by_group = [np.ascontiguousarray(tables[:, g, :]) for g in range(groups)]
    for k in range(bits):
        part = np.zeros((anchors, rows), np.int64)
        for g in range(groups):
            part += np.take(by_group[g], planes[:, k, g], axis=1)
        total += (-part if k == bits - 1 else part) << k
    return total


def _firsts(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place) of the first ``k`` per row by score desc, id, rid; ``_NONE`` marks no candidate."""
    width = scores.shape[1]
    if width > k:
        kth = np.partition(scores, width - k, axis=1)[:, width - k]
        chosen = (scores >= kth[:, None]) & (scores != _NONE)
    else:
        chosen = scores != _NONE
    row, col = np.nonzero(chosen)
    order = np.lexsort((rids[col], ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    keep = place < k
    return row[keep], col[keep], place[keep]


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _cell(cands: pd.DataFrame, anchors: pd.DataFrame, dims: int, bits: int, second: bool) -> pd.DataFrame:
    """One (chunk, block) cell: the best same-label rows, or the negatives of the known positives.

    Rows carry ``key``, their vec_id with null as the largest long, so that null comes last.
    """
    names = ["rid", "pidx", "cand_rid", "cand_key", "score"] if second else ["rid", "cand_rid", "cand_key", "score"]
    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
    if cands.empty or anchors.empty:
        return empty
    planes = np.frombuffer(b"".join(cands["planes"]), np.uint8).reshape(len(cands), bits, dims // 8)
    c_label = cands["label"].to_numpy(np.int64)
    c_rid = cands["rid"].to_numpy(np.int64)
    c_key = cands["key"].to_numpy(np.int64)
    out = [empty]
    for lo in range(0, len(anchors), SUB_BLOCK):
        block = anchors.iloc[lo:lo + SUB_BLOCK]
        scores = four_russians_scores(subset_tables(_matrix(block["q"], dims)), planes)
        a_label = block["label"].to_numpy(np.int64)[:, None]
        a_rid = block["rid"].to_numpy(np.int64)
        if not second:
            same = (a_label == c_label[None, :]) & (a_rid[:, None] != c_rid[None, :])
            row, col, _ = _firsts(np.where(same, scores, _NONE), c_key, c_rid, POSITIVES)
            out.append(pd.DataFrame({"rid": a_rid[row], "cand_rid": c_rid[col], "cand_key": c_key[col], "score": scores[row, col]}))
            continue
        other = a_label != c_label[None, :]
        for j in range(POSITIVES):
            has = np.array([len(p) > j for p in block["pos_score"]])
            s = np.array([p[j] if len(p) > j else 0 for p in block["pos_score"]], np.int64)[:, None]
            # LOW * s <= HIGH * t over their common factor, so that no product passes 2^63.
            window = other & has[:, None] & (LOW // _COMMON * s <= HIGH // _COMMON * scores) & (scores <= s)
            row, col, _ = _firsts(np.where(window, scores, _NONE), c_key, c_rid, NEGATIVES)
            out.append(pd.DataFrame({"rid": a_rid[row], "pidx": np.full(len(row), j + 1), "cand_rid": c_rid[col],
                                     "cand_key": c_key[col], "score": scores[row, col]}))
    return pd.concat(out, ignore_index=True)


def prepared(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(rid, vec_id, label, q): the rows that take part, relabelled, components as integers."""
    vector = F.col(f"`{vector_col}`")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    vid = F.col(f"`{id_col}`").cast("long")
    label = F.col(f"`{label_col}`").cast("long")
    rows = embeddings.filter(F.col(f"`{label_col}`").isNotNull() & vector.isNotNull() & ~bad).select(
        vid.alias("vec_id"),
        F.when(vid % RELABEL_EVERY == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))
    return materialize(rows).withColumns({"rid": F.monotonically_increasing_id(),
                                          "key": F.coalesce("vec_id", F.lit(int(_LAST)))})


def mine(embeddings: DataFrame, anchor_block: int = ANCHOR_BLOCK, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for all anchors."""
    rows = materialize(prepared(embeddings))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % ANCHOR_EVERY == 0, 1)).alias("a"),
                     F.max(F.size("q")).alias("d"),
                     F.max(F.array_max(F.transform("q", lambda x: F.abs(x)))).alias("m")).first()
    spark = embeddings.sparkSession
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not stats["n"] or not stats["a"]:
        return spark.createDataFrame([], out_schema)
    dims = max(8, 8 * math.ceil((stats["d"] or 0) / 8))
    biggest = int(stats["m"] or 0)
    if dims * biggest * biggest >= 2**59:
        raise ValueError("scores would pass 2^59; exact scores are not possible in 64 bits")
    bits = biggest.bit_length() + 1
    blocks = max(1, math.ceil(stats["a"] / anchor_block))
    chunks = max(spark.sparkContext.defaultParallelism, math.ceil(stats["n"] / chunk_rows))

    def pack(frames):
        for frame in frames:
            planes = bit_planes(_matrix(frame["q"], dims), bits)
            yield pd.DataFrame({"rid": frame["rid"], "key": frame["key"], "label": frame["label"],
                                "planes": [p.tobytes() for p in planes]})

    cands = materialize(rows.select("rid", "key", "label", "q").mapInPandas(
        pack, "rid long, key long, label long, planes binary"))
    cell_of = F.pmod(F.xxhash64("rid"), F.lit(chunks)) * blocks
    cand_cells = cands.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: cell_of + b)))
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))

    def cells(anchor_rows: DataFrame, second: bool, schema: str) -> DataFrame:
        spread = anchor_rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)),
                                                                       lambda c: c * blocks + F.col("block"))))
        return cand_cells.groupBy("cell").cogroup(spread.groupBy("cell")).applyInPandas(
            lambda c, a: _cell(c, a, dims, bits, second), schema)

    ids = rows.select(F.col("rid").alias("cand_rid"), F.col("vec_id").alias("cand_id"))
    first = cells(anchors, False, "rid long, cand_rid long, cand_key long, score long")
    best = Window.partitionBy("rid").orderBy(F.col("score").desc(), "cand_key", "cand_rid")
    positives = materialize(first.withColumn("pidx", F.row_number().over(best)).filter(F.col("pidx") <= POSITIVES)
                            .join(ids, "cand_rid").select("rid", "pidx", F.col("cand_id").alias("positive_id"),
                                                          F.col("score").alias("positive_score")))
    scored = positives.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pidx", "positive_score"))).alias("p"))
    with_pos = anchors.join(scored, "rid").select("rid", "label", "q", "block", F.col("p.positive_score").alias("pos_score"))
    second = cells(with_pos, True, "rid long, pidx long, cand_rid long, cand_key long, score long")
    order = Window.partitionBy("rid", "pidx").orderBy(F.col("score").desc(), "cand_key", "cand_rid")
    ranked = second.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    anchor_ids = anchors.select("rid", F.col("vec_id").alias("anchor_id"))
    return ranked.join(ids, "cand_rid").join(positives, ["rid", "pidx"]).join(anchor_ids, "rid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("cand_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The mined triples of ``embeddings`` (vec_id, embedding, label) with the contract's columns."""
    return mine(embeddings.select("vec_id", "embedding", "label"))
