"""Language identification in two steps: the family first, then the language within it.

Features are counts of hashed character n-grams (1 to 3 letters, word edges marked) of the whole
text, scaled to a unit vector of square roots. A softmax regression picks the family; within a
family each pair of languages has a linear support vector machine, and most votes win (ties: the
larger sum of margins, then the first in code order). A family of one language needs no machine.

Training: a bounded sample of the labelled rows, ``SAMPLE`` per language at most (those with the
smallest hash of the id), fitted on the driver from their feature vectors, which tasks compute.
The models are a matrix of ``DIMENSIONS`` columns and one row for each class or pair.

Defined results: null text and text without a letter give ``und`` with score 0; rows with null
language are not learned from; with nothing to learn from every prediction is ``und``; a null id
is treated as an empty string where it is hashed; repeated rows get the same answer; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hashed features, n-gram lengths, labelled rows per language, languages and rounds of training.
DIMENSIONS, GRAMS, SAMPLE, LANGUAGES, ROUNDS = 1 << 13, (1, 2, 3), 400, 200, 30
#: Characters that are hashed at a time.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Families by language code; a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}


def _is_letter() -> np.ndarray:
    """For each code point of the basic plane, the code of its lower-case letter, 0 if it is none."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low[0]) if ord(low[0]) < 0x10000 else c
    return table


_LETTERS = _is_letter()


def features(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams of letters; None if the text has no letter."""
    counts = np.zeros(DIMENSIONS, np.float64)
    found = False
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        high = codes >= 0x10000
        letters = np.where(high, 0, _LETTERS[np.where(high, 0, codes)])
        if high.any():
            letters[high] = [c if chr(c).isalpha() else 0 for c in codes[high].tolist()]
        if not letters.any():
            continue
        found = True
        # Runs of other characters become one mark, as at the ends.
        kept = (letters > 0) | np.r_[True, letters[:-1] > 0]
        word = np.r_[np.uint32(0), letters[kept], np.uint32(0)].astype(np.uint64)
        mixed = np.zeros(len(word), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            mixed = mixed[: len(word) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1:] + np.uint64(n)
            if n in GRAMS and len(mixed):
                place = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                counts += np.bincount((place >> np.uint64(40)).astype(np.int64) & (DIMENSIONS - 1), minlength=DIMENSIONS)
    if not found:
        return None
    root = np.sqrt(counts)
    return root / np.linalg.norm(root)


@dataclass
class FamilyModel:
    """Softmax over families; for each family its languages and their pairwise machines."""

    families: list[str]
    weights: np.ndarray
    languages: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        scores = self.weights @ np.r_[x, 1.0]
        chances = np.exp(scores - scores.max())
        chances /= chances.sum()
        best = int(chances.argmax())
        languages = self.languages[self.families[best]]
        if len(languages) == 1:
            return languages[0], float(chances[best])
        votes, margins = dict.fromkeys(languages, 0), dict.fromkeys(languages, 0.0)
        certain = dict.fromkeys(languages, 1.0)
        for a, b in combinations(languages, 2):
            margin = float(self.machines[a, b] @ np.r_[x, 1.0])
            votes[a if margin > 0 else b] += 1
            margins[a] += margin
            margins[b] -= margin
            chance = 1 / (1 + np.exp(-4 * margin))
            certain[a], certain[b] = min(certain[a], chance), min(certain[b], 1 - chance)
        winner = max(languages, key=lambda l: (votes[l], margins[l], [-ord(c) for c in l]))
        return winner, float(chances[best] * certain[winner])


def _softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Full-batch gradient descent with classes weighted alike."""
    w = np.zeros((classes, x.shape[1]))
    target = np.eye(classes)[y]
    share = (1 / np.bincount(y, minlength=classes).clip(1))[y][:, None]
    for _ in range(5 * rounds):
        scores = x @ w.T
        chances = np.exp(scores - scores.max(1, keepdims=True))
        chances /= chances.sum(1, keepdims=True)
        w -= 20.0 / classes * ((chances - target) * share).T @ x + 1e-4 * w
    return w


def _svm(x: np.ndarray, y: np.ndarray, rounds: int, cost: float = 10.0) -> np.ndarray:
    """Linear machine with hinge loss by dual coordinate descent; y is 1 or -1."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norms = (x * x).sum(1)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * (w @ x[i]) - 1) / norms[i], 0, cost) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


def fit(vectors: np.ndarray, labels: list[str], families: dict[str, str] = FAMILIES, rounds: int = ROUNDS) -> FamilyModel:
    names = sorted(set(labels))
    family = {n: families.get(n, n) for n in names}
    order = sorted(set(family.values()))
    x = np.c_[vectors.astype(np.float32, copy=False), np.ones(len(vectors), np.float32)]
    y = np.array([order.index(family[n]) for n in labels])
    model = FamilyModel(order, _softmax(x, y, len(order), rounds) if len(order) > 1 else np.zeros((1, x.shape[1])),
                        {f: [n for n in names if family[n] == f] for f in order})
    label = np.array(labels)
    for members in model.languages.values():
        for a, b in combinations(members, 2):
            pick = (label == a) | (label == b)
            model.machines[a, b] = _svm(x[pick], np.where(label[pick] == a, 1.0, -1.0), rounds)
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(lang, x) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                 if (x := features(text)) is not None]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([l for l, _ in found]), pa.array([x.astype("<f4").tobytes() for _, x in found])], ["lang", "vector"])


def learn(rows: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> FamilyModel | None:
    """Fit on (doc_id, lang, text) rows; ``sample`` bounds the rows of each language.

    At most LANGUAGES languages (those with most rows) are learned, so that what reaches the
    driver is bounded: LANGUAGES * sample vectors.
    """
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    share = F.create_map(*[v for r in counts for v in (F.lit(r["lang"]), F.lit(2.0 * sample / r["count"]))])
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    near = rows.select("lang", "text", place.alias("place"), F.col("doc_id")).filter(F.col("place") < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", F.xxhash64("text")))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= sample)
    found = sorted((r["lang"], bytes(r["vector"])) for r in chosen.select("lang", "text").mapInArrow(_vectors, "lang string, vector binary").collect())
    if not found:
        return None
    vectors = np.frombuffer(b"".join(v for _, v in found), "<f4").reshape(len(found), -1)
    return fit(vectors, [l for l, _ in found], families)


def _predict(batches: Iterator[pa.RecordBatch], model: FamilyModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(2):
            x = features(text.as_py() or "") if model else None
            found.append((UNKNOWN, 0.0) if x is None else model.predict(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([l for l, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
             sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from labelled documents that are not held out: crc32 of the id as text, modulo
    ``folds``, is not 0.
    """
    held = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held.alias("held_out"),
                       F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    model = learn(rows.filter("not held_out and lang is not null and text is not null").select("doc_id", "lang", "text"), sample, families)
    known = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, see above
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        lambda batches: _predict(batches, known.value), "doc_id bigint, held_out boolean, lang_pred string, score double")
