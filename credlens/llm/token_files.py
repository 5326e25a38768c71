"""Token ids in files of independent zstandard frames with a trailing seek table.

Documents are range-partitioned and sorted by id; each task encodes its range and writes one
file, so file names, then frames, then documents within a frame are in ascending id order.

A file, in zstandard's seekable format:

* data frames, each zstandard-compressed by itself. Decompressed: number of documents n (u64),
  n ids (i64), n null marks (u8, 1: the id is null), n lengths (u64), then all token ids as four
  byte planes (all lowest bytes first). All numbers are little-endian.
* one skippable frame, the index: documents (u64), token ids (u64), first and last id (i64) of
  each data frame.
* the seek table, a skippable frame: compressed size, decompressed size and checksum (lowest four
  bytes of the XXH64 of the decompressed bytes) of each frame above (u32), the number of frames,
  the descriptor, the magic number.

A reader fetches the seek table and the index from the end of a file and then decompresses the
frames it wants; a wrong checksum is an error. A file appears under its name only when it is
complete, and a task that runs again writes the same bytes.

Defined results: null text is empty and has the end id only; null ids come first; rows that share
an id are ordered by their texts' hash; an empty table gives no file and an empty result; further
columns are not read. A document longer than a frame is a frame of its own.
"""

from __future__ import annotations

import math
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credlens.llm.shared import materialize, shared_folder

#: Token ids of a frame, compression level, id at the end of a document.
FRAME_IDS, LEVEL, END_ID = 1 << 18, 3, 0
#: Files whose seek tables one task reads, and frames (at most 4 * FRAME_IDS ids, 4 MB, each) that one task decompresses.
FILES_PER_TASK, FRAMES_PER_TASK = 4, 16
#: Pieces whose ids a worker keeps, and characters of text that are split at a time.
CACHE_WORDS, CHARS = 500_000, 1 << 19
# Magic numbers of the seekable format and of its skippable frames; the descriptor says that checksums follow.
_INDEX_MAGIC, _SEEK_MAGIC, _END_MAGIC, _DESCRIPTOR = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
# Fixed value: the pattern by which a byte-level tokenizer splits text before its merges.
_SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
def _ranges(pattern: str) -> str:
    """The characters up to U+FFFF that ``pattern`` matches, as the ranges of a character class."""
    parts = ("".join(map(chr, codes)) for codes in (range(0xD800), range(0xE000, 0x10000)))
    runs = (m.group() for part in parts for m in regex.finditer(f"{pattern}+", part))
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in runs)


def _basic_split() -> re.Pattern:
    """The same pattern for texts without characters beyond U+FFFF, its classes spelled out: about twice as fast."""
    letters, numbers, spaces = (_ranges(c) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
                      f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


_BASIC_SPLIT, _BEYOND = _basic_split(), re.compile("[^\0-\uffff]")


def splitter(text: str) -> re.Pattern | regex.Pattern:
    """The pattern to split ``text`` by."""
    return _SPLIT if _BEYOND.search(text) else _BASIC_SPLIT


# Fixed value: byte-level vocabularies write printable bytes as they are, the others as code points from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = dict(zip(sorted(set(range(256)).difference(_PLAIN)), map(chr, range(256, 512))))
_ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
_INDEX = np.dtype([("docs", "<u8"), ("ids", "<u8"), ("first", "<i8"), ("last", "<i8")])


#: A code point in the contexts below: after a letter, between numbers, before a space, and after an apostrophe.
_CONTEXTS = "x{c}1{c}2 {c}'{c}s {c}{c}\n"
_ASSIGNED = regex.compile(r"[^\p{Cn}\p{Cs}\p{Co}]")
#: Code points compared at a time.
_CHUNK = 8192


def disputed_code_points(path: str) -> frozenset[str]:
    """Code points that the pattern here and the library's own split put in different pieces.

    The pattern's Unicode tables may be newer than the library's, so newly assigned letters or
    digits may differ. Unassigned, surrogate and private-use code points are neither letters
    nor digits in either table and never become unassigned again, so only assigned ones are
    compared: all of them, each in several contexts, in one call of each splitter.
    """
    library = Tokenizer.from_file(path).pre_tokenizer
    if library is None:
        return frozenset()
    width = len(_CONTEXTS.format(c="c"))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and _ASSIGNED.match(chr(c))]
    disputed = set()
    for at in range(0, len(chars), _CHUNK):  # in chunks, so that the driver's memory stays small
        chunk = chars[at:at + _CHUNK]
        text = "".join(_CONTEXTS.format(c=c) for c in chunk)
        theirs = {end for _, (_, end) in library.pre_tokenize_str(text)}
        ours = {m.end() for m in _SPLIT.finditer(text)}
        disputed.update(chunk[(p - 1) // width] for p in theirs ^ ours)
    return frozenset(disputed)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Byte-level tokenizers split text by a fixed pattern before anything else and then merge each
    piece by itself, so the library merges a piece once and its ids are kept. Any other
    tokenizer, a text that holds a special token, and a text that holds a code point that the
    pattern and the library split differently (``disputed``, see ``disputed_code_points``) go
    through the library as a whole.
    """

    def __init__(self, path: str, disputed: frozenset[str] = frozenset()) -> None:
        self.disputed = disputed
        self.tokenizer = Tokenizer.from_file(path)
        library = self.tokenizer.pre_tokenizer
        self.by_piece = (self.tokenizer.normalizer is None and type(library).__name__ == "ByteLevel"
                         and not library.add_prefix_space and library.use_regex)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Pieces seen so far that hold a disputed code point; a text with one goes to the library whole.
        self.bad: set[str] = set()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, seen: set[str]) -> None:
        """Ids of pieces not known yet; what two generations have not seen is forgotten."""
        if len(self.known) + len(seen) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older, merge = self.known, self.older, self.tokenizer.model.tokenize
        new = list(seen.difference(known))
        if self.disputed:
            self.bad.update(p for p in new if not self.disputed.isdisjoint(p))
        shown = b"\xff".join([p.encode() for p in new]).decode("latin-1")  # a byte that UTF-8 does not use
        for byte, visible in _VISIBLE.items():
            shown = shown.replace(chr(byte), visible)
        for piece, written in zip(new, shown.split("\xff")):
            ids = older.get(piece)
            known[piece] = array("I", [t.id for t in merge(written)]).tobytes() if ids is None else ids

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Every character is in one piece, so a text holds a disputed code point only in a piece;
        each new piece is tested once, and a text's pieces only once some piece was bad."""
        pieces = [splitter(t).findall(t) for t in texts]
        self._learn(set(chain.from_iterable(pieces)))
        bad = self.bad
        return [self._library([t])[0] if bad and not bad.isdisjoint(p) else b"".join(map(self.known.__getitem__, p))
                for t, p in zip(texts, pieces)]

    def _long(self, text: str) -> bytes:
        """A text whose pieces are found and encoded in steps, as a list of all would be large."""
        out, found = [], (m.group() for m in splitter(text).finditer(text))
        while pieces := list(islice(found, CHARS // 8)):
            self._learn(set(pieces))
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The texts' ids, in order; texts of about CHARS characters are worked on at a time."""
        held, size = [], 0
        for text in texts:
            whole = not self.by_piece or any(s in text for s in self.special)
            whole = whole or (len(text) > CHARS and not self.disputed.isdisjoint(text))
            if whole or len(text) > CHARS:
                yield from self._pieces(held)
                held, size = [], 0
                yield self._library([text])[0] if whole else self._long(text)
                continue
            held.append(text)
            size += len(text)
            if size >= CHARS:
                yield from self._pieces(held)
                held, size = [], 0
        yield from self._pieces(held)


@lru_cache(maxsize=1)
def encoder(path: str, disputed: frozenset[str] = frozenset()) -> Encoder:
    """A worker keeps its encoder, and the pieces it knows, from task to task; it has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, disputed)


def pack_frame(doc_ids: list[int | None], bodies: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(bodies), "<u4")
    return b"".join([
        np.uint64(len(doc_ids)).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), np.array([len(b) // 4 for b in bodies], "<u8").tobytes(),
        np.ascontiguousarray(ids.view("u1").reshape(-1, 4).T).tobytes()])


def unpack_frame(raw: bytes) -> Iterator[tuple[int | None, bytes]]:
    """(document id, its token ids as bytes) of a frame."""
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    at = 8 + 8 * n
    doc_ids, null = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "u1", n, at)
    lengths = np.frombuffer(raw, "<u8", n, at + n).astype(np.int64)
    planes = np.frombuffer(raw, "u1", offset=at + 9 * n).reshape(4, -1)
    body = np.ascontiguousarray(planes.T).tobytes()
    stops = 4 * np.cumsum(lengths)
    for doc_id, missing, a, b in zip(doc_ids.tolist(), null.tolist(), (stops - 4 * lengths).tolist(), stops.tolist()):
        yield None if missing else doc_id, body[a:b]


class FrameWriter:
    """Writes data frames to a binary stream and closes it with index and seek table."""

    def __init__(self, out) -> None:
        self.out, self.entries, self.index = out, [], []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_ids: list[int | None], bodies: list[bytes]) -> None:
        raw = pack_frame(doc_ids, bodies)
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((len(doc_ids), sum(map(len, bodies)) // 4, doc_ids[0] or 0, doc_ids[-1] or 0))

    def close(self) -> None:
        index = np.array(self.index, _INDEX).tobytes()
        self.out.write(np.array([_INDEX_MAGIC, len(index)], "<u4").tobytes() + index)
        table = np.array([*self.entries, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], _ENTRY).tobytes()
        tail = np.uint32(len(self.entries) + 1).tobytes() + bytes([_DESCRIPTOR]) + np.array([_END_MAGIC], "<u4").tobytes()
        self.out.write(np.array([_SEEK_MAGIC, len(table) + len(tail)], "<u4").tobytes() + table + tail)


@dataclass
class FrameReader:
    """Random access to the frames of a file of the given size."""

    file: object
    size: int

    def __post_init__(self) -> None:
        tail = self._read(self.size - 9, 9)
        frames = int.from_bytes(tail[:4], "little")
        if int.from_bytes(tail[5:], "little") != _END_MAGIC or tail[4] != _DESCRIPTOR:
            raise ValueError("not a seekable file with checksums")
        length = frames * _ENTRY.itemsize
        entries = np.frombuffer(self._read(self.size - 9 - length, length), _ENTRY)
        self.entries, index = entries[:-1], int(entries[-1]["packed"])
        self.offsets = np.r_[0, np.cumsum(self.entries["packed"].astype(np.int64))]
        self.index = np.frombuffer(self._read(int(self.offsets[-1]), index), _INDEX, offset=8)

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        entry = self.entries[k]
        raw = zstandard.ZstdDecompressor().decompress(
            self._read(int(self.offsets[k]), int(entry["packed"])), max_output_size=int(entry["raw"]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {k}: wrong checksum")
        return raw


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, frame_ids: int,
           disputed: frozenset[str] = frozenset()) -> Iterator[pa.RecordBatch]:
    store = None
    task = TaskContext.get()
    name = f"part-{task.partitionId():06d}.ids.zst"
    doc_ids, bodies, held, total = [], [], 0, [0, 0]
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc_id, body in zip(ids, encoder(tokenizer, disputed).encode(texts)):
            if store is None:
                store, root = fs.FileSystem.from_uri(folder)
                draft = f"{root}/.{name}-{task.taskAttemptId()}"
                out = store.open_output_stream(draft)
                writer = FrameWriter(out)
            body += np.uint32(END_ID).tobytes()
            if doc_ids and held + len(body) > 4 * frame_ids:
                writer.add(doc_ids, bodies)
                doc_ids, bodies, held = [], [], 0
            doc_ids.append(doc_id)
            bodies.append(body)
            held += len(body)
            total[0] += 1
            total[1] += len(body) // 4
    if store is not None:
        writer.add(doc_ids, bodies)
        writer.close()
        out.close()
        store.move(draft, f"{root}/{name}")
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.int64())],
                                     ["name", "docs", "ids"])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write all documents to files below ``folder``; returns (name, docs, ids) of each task's file.

    ``folder`` is a URI that every executor reaches (file, HDFS, S3, GCS); ``tokenizer`` the path
    of a tokenizer file. A third of the rows may share an id: ranges are cut by id and text hash.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    order = F.col("doc_id").asc_nulls_first(), F.col("hash")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    # Derived once, on the driver; the workers get the (small) set with their function.
    disputed = disputed_code_points(tokenizer)
    write = partial(_write, folder=folder, tokenizer=tokenizer, frame_ids=frame_ids, disputed=disputed)
    return materialize(ranged.mapInArrow(write, "name string, docs bigint, ids bigint"))


def _frames(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The frames of files (name, size, place): (name, size, place, frame, base, ids, first, last)."""
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, size, place in zip(*(batch.column(i).to_pylist() for i in range(3))):
            with store.open_input_file(f"{root}/{name}") as file:
                reader = FrameReader(file, size)
            ids = reader.index["ids"].astype(np.int64)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array([size] * n, pa.int64()), pa.array([place] * n, pa.int64()), pa.array(np.arange(n)),
                 pa.array(np.cumsum(ids) - ids), pa.array(ids), pa.array(reader.index["first"]), pa.array(reader.index["last"])],
                ["name", "size", "place", "frame", "base", "ids", "first", "last"])


def _read(batches: Iterator[pa.RecordBatch], folder: str, digest: bool) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    open_name, reader = None, None
    for batch in batches:
        for name, size, frame, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if name != open_name:
                open_name, reader = name, FrameReader(store.open_input_file(f"{root}/{name}"), size)
            rows = list(unpack_frame(reader.frame(frame)))
            counts = np.array([len(b) // 4 for _, b in rows], np.int64)
            last = pa.array([zlib.crc32(b) for _, b in rows], pa.int64()) if digest else pa.array([b for _, b in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.int64()), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), last],
                ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def frame_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per frame of all files: name, size, frame, start (ids before it), ids, first, last.

    The driver lists the files, as many as the writing had tasks; their tables are read by tasks.
    """
    store, root = fs.FileSystem.from_uri(folder)
    infos = sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.base_name)
    files = [(i.base_name, i.size, k) for k, i in enumerate(x for x in infos if x.base_name.endswith(".ids.zst") and x.base_name[0] != ".")]
    # An explicit number of tasks: adaptive coalescing would merge a few small rows into one task.
    listed = spark.createDataFrame(files, "name string, size bigint, place bigint").repartition(
        max(1, math.ceil(len(files) / FILES_PER_TASK)), "place")
    frames = materialize(listed.mapInArrow(partial(_frames, folder=folder), (
        "name string, size bigint, place bigint, frame bigint, base bigint, ids bigint, first bigint, last bigint")))
    before, bases = 0, []
    for place, n in sorted(frames.groupBy("place").agg(F.sum("ids")).collect()):
        bases.append((place, before))
        before += n
    known = spark.createDataFrame(bases, "place bigint, before bigint")  # one row per file
    return frames.join(F.broadcast(known), "place").select(
        "name", "size", "frame", (F.col("before") + F.col("base")).alias("start"), "ids", "first", "last")


def read_token_files(spark: SparkSession, folder: str, doc_ids: tuple[int, int] | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``ids`` are little-endian u32 bytes.

    With ``digest`` their CRC-32, as ids_crc32, stands in for the ids.

    With ``doc_ids`` (first, last) only frames that can hold such documents are decompressed.
    """
    frames = materialize(frame_table(spark, folder))
    if doc_ids is not None:
        frames = frames.filter((F.col("first") <= doc_ids[1]) & (F.col("last") >= doc_ids[0]))
    tasks = max(1, math.ceil(frames.count() / FRAMES_PER_TASK))  # explicit, so never coalesced into one task
    rows = (frames.select("name", "size", "frame", "start").repartition(tasks, "name", "frame").sortWithinPartitions("name", "frame")
            .mapInArrow(partial(_read, folder=folder, digest=digest),
                        "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids binary")))
    return rows if doc_ids is None else rows.filter(F.col("doc_id").between(*doc_ids))


def token_digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write, read back, and return doc_id, start, n_tokens, ids_crc32 of every document."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer, **options)
    return read_token_files(spark, folder, digest=True)
