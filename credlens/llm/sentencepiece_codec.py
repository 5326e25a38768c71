"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over the boundaries between characters. For each it keeps the best last piece and
a pointer to where that piece starts; only boundaries within the longest piece of the end can still
be extended. As soon as the pointers of all of those lead to one earlier boundary, the ids up to
there are final and are given out, and what lies before is forgotten.

* Unigram models: the best path has the largest sum of piece scores.
* Byte-pair models: a path survives if each two neighbouring pieces are what the merges make of
  their joined text. Each boundary has one such path, and it is the library's segmentation.

Paths also converge, known beforehand, between two characters that stand side by side in no piece
(for usual models before every space). Texts are cut there first, and a worker remembers the ids of
the parts it has seen, in two generations of bounded size. Characters outside the vocabulary become
byte pieces, or the unknown piece where the model has none.

Defined results: null text is empty and has no ids; a null id is passed on; repeated rows get the
same ids; an empty table gives an empty result; further columns are not read. Models with a
normalizer other than identity, or with user-defined pieces, are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Parts that one generation of a worker's memory holds, and the longest that it holds.
MEMORY, LONGEST = 350_000, 64
#: Characters after which convergence is looked for, in longest pieces.
LOOK = 4
# Field numbers and enumerations of the model file.
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
# A string begins longer pieces, is a piece, or both.
_PREFIX, _WHOLE, _BOTH = 1, 2, 3


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, raw[at:at + size]
        at += size


def _packed(ids: Iterator[int]) -> bytes:
    return array("I", ids).tobytes()


class Model:
    """Pieces, scores and settings of a SentencePiece model file."""

    def __init__(self, raw: bytes) -> None:
        self.texts: list[str] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.kind, self.prefix, self.unknown = _UNIGRAM, True, 0
        name, trim = "", True
        for field, value in _fields(raw):
            if field == 1:
                self._piece(dict(_fields(value)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif field == 3:
                settings = dict(_fields(value))
                name, self.prefix, trim = settings.get(1, b"").decode(), settings.get(3, 1), settings.get(4, 1)
        if name not in ("", "identity") or trim or self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and byte-pair models with the identity normalizer are read")
        self.longest = max(map(len, self.ids))
        self.least = min(self.scores.values()) - 10
        prefixes = {p[:i] for p in self.ids for i in range(1, len(p))}
        self.kinds = dict.fromkeys(prefixes, _PREFIX) | {p: _BOTH if p in prefixes else _WHOLE for p in self.ids}
        self.pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.output = [t.encode() for t in self.texts]
        for byte, number in self.bytes.items():
            self.output[number] = bytes([byte])
        self.merged: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A part is a run of spaces and what follows, up to the next space, if no piece goes on over it.
        spaced = any(p[1] == SPACE != p[0] for p in self.pairs)
        breaks = "".join(c for c in "\n\r\t" if not any(c in p for p in self.pairs))
        self.parts = None if spaced else re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|[{breaks}]" if breaks else ""))

    def _piece(self, fields: dict) -> None:
        text, kind, number = fields.get(1, b"").decode(), fields.get(3, _NORMAL), len(self.texts)
        self.texts.append(text)
        if kind == _USER:
            raise ValueError("user-defined pieces are not read")
        if kind == _NORMAL:
            self.ids[text] = number
            self.scores[text] = struct.unpack("<f", fields.get(2, bytes(4)))[0]
        elif kind == _BYTE:
            self.bytes[int(text[3:5], 16)] = number
        elif kind == _UNKNOWN:
            self.unknown = number

    def merge(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, before: str, piece: str) -> bool:
        """Whether the merges leave these two pieces (or, after nothing, the one) as they are."""
        key = (before, piece)
        found = self.merged.get(key)
        if found is None:
            if len(self.merged) > MEMORY:
                self.merged.clear()
            joined = before + piece
            if before and before[-1] + piece[0] not in self.pairs:
                found = self.follows("", piece)
            else:
                found = self.merge(joined) == ([before, piece] if before else [piece])
            self.merged[key] = found
        return found

    def _spell(self, piece: str) -> list[int]:
        """Of a character outside the vocabulary."""
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if len(self.bytes) == 256 else [self.unknown]

    def search(self, text: str) -> Iterator[int]:
        """Ids of a text of any length; what is final is given out while the search goes on."""
        unigram, scores, kinds, merged, least = self.kind == _UNIGRAM, self.scores, self.kinds, self.merged, self.least
        n, longest, done = len(text), self.longest, 0
        # Of boundary done + i: the path's score or last piece (None: not reached), and the boundary before.
        value: list = [0.0 if unigram else "", *[None] * min(n, longest)]
        back = [0] * len(value)
        look = LOOK * longest
        for start in range(n):
            here = value[start - done]
            if here is None:
                continue
            stop = min(n, start + longest)
            if stop - done >= len(value):
                grow = stop - done + 1 - len(value)
                value += [None] * grow
                back += [0] * grow
            for end in range(start + 1, stop + 1):
                piece = text[start:end]
                kind = kinds.get(piece)
                if end - start == 1 and (kind is None or kind == _PREFIX):  # a character outside the vocabulary
                    at = end - done
                    if not unigram or value[at] is None or here + least > value[at]:
                        value[at], back[at] = here + least if unigram else "", start
                if kind is None:
                    break
                if kind != _PREFIX:
                    at = end - done
                    if unigram:
                        score = here + scores[piece]
                        if value[at] is None or score > value[at]:
                            value[at], back[at] = score, start
                    elif value[at] is None:
                        fits = merged.get((here, piece))
                        if self.follows(here, piece) if fits is None else fits:
                            value[at], back[at] = piece, start
                    if kind == _WHOLE:
                        break
            if start - done >= look:
                final = self._converged(value, back, range(start - longest + 1, start + 1), done)
                if final > done:
                    yield from self._path(text, back, done, final, done)
                    del value[:final - done], back[:final - done]
                    done = final
                look = start - done + longest
        yield from self._path(text, back, done, n, done)

    @staticmethod
    def _converged(value: list, back: list[int], ends: range, done: int) -> int:
        """The latest boundary through which the paths of all ends go."""
        open_ends = {b for b in ends if value[b - done] is not None}
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.remove(last)
            open_ends.add(back[last - done])
        return open_ends.pop() if open_ends else done

    def _path(self, text: str, back: list[int], start: int, end: int, done: int) -> list[int]:
        pieces = []
        while end > start:
            before = back[end - done]
            pieces.append(text[before:end])
            end = before
        found = []
        for piece in reversed(pieces):
            number = self.ids.get(piece)
            if number is not None:
                found.append(number)
            else:
                found += self._spell(piece)
        return found

    def _part(self, part: str) -> bytes:
        """Ids of a part, cut once more where no piece goes over two characters."""
        pairs, n, out, start = self.pairs, len(part), [], 0
        for i in range(1, n + 1):
            if i == n or part[i - 1:i + 1] not in pairs:
                if i - start == n:
                    return _packed(self.search(part))
                word = part[start:i]
                ids = self.known.get(word) or self.older.get(word)
                if ids is None:
                    ids = _packed(self.search(word))
                    if i - start <= LONGEST:
                        self.known[word] = ids
                out.append(ids)
                start = i
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        escaped = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.parts is None:
            return _packed(self.search(escaped))
        parts = self.parts.findall(escaped)
        for part in set(parts).difference(self.known):
            ids = self.older.get(part)
            self.known[part] = self._part(part) if ids is None else ids
        found = b"".join(map(self.known.__getitem__, parts))
        if len(self.known) > MEMORY:
            self.known, self.older = {}, {k: v for k, v in self.known.items() if len(k) <= LONGEST}
        return found

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.output.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=1)
def _worker_model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


_IDS = pa.list_(pa.int32())


def _id_lists(found: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(b) // 4 for b in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, decoded_sha256, round_trip.

    ``decoded_sha256`` is of the text that decoding the ids gives, ``round_trip`` whether that is
    the text itself. ``model`` is the path of a model file on every executor.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_model(model)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                found = [codec.encode(t) for t in texts]
                back = [codec.decode(np.frombuffer(b, "<u4").tolist()) for b in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([len(b) // 4 for b in found], pa.int64()), _id_lists(found),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == b for a, b in zip(texts, back)])],
                    ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(
        encode, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode_ids(ids: Column | str, model: str) -> Column:
    """The text of a column of ids; null stays null."""
    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        codec = _worker_model(model)
        return column.map(lambda x: None if x is None else codec.decode(list(x)))

    return decode(ids)
