import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credlens.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, rows):
    """Documents in order; rows that share an id and differ in text are not in these tests."""
    out, before = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def test_ids_equal_the_library(library):
    encoder, rng = token_files.Encoder(PATH), random.Random(3)
    pool = [chr(c) for c in [*range(0x250), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0x2160, 0x1F600, 0x4E00, 0x85]]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice(" ab1'st.\n") for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "", "word " * 200_000]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files_of_documents(table, library):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "a<|endoftext|>b c\n\n d"), (5, "é漢🎉 don't \t x"), (6, "same"), (6, "same"), (7, "w " * 60_000)]
    rows += [(i, f"document {i} " * (i % 9)) for i in range(20, 120)]
    got = token_files.token_digests(table(rows), PATH, frame_ids=64).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(library, rows)
    assert token_files.token_digests(table([]), PATH).count() == 0


def test_only_wanted_frames_are_read(spark, table, library, tmp_path):
    folder = f"file://{tmp_path}/ids"
    token_files.write_token_files(table([(i, f"document number {i}") for i in range(300)]), folder, PATH, frame_ids=50)
    frames = token_files.frame_table(spark, folder)
    total = frames.count()
    assert total > 20 and frames.agg(F.sum("ids")).first()[0] == frames.agg(F.max(F.col("start") + F.col("ids"))).first()[0]
    some = token_files.read_token_files(spark, folder, (100, 103)).orderBy("doc_id").collect()
    assert [r.doc_id for r in some] == [100, 101, 102, 103]
    assert library.decode(np.frombuffer(some[0].ids, "<u4")[:-1].tolist()) == "document number 100"
    whole = {r.doc_id: r.start for r in token_files.read_token_files(spark, folder).collect()}
    assert all(whole[r.doc_id] == r.start for r in some)


def packed(frames):
    out = io.BytesIO()
    writer = token_files.FrameWriter(out)
    for ids, bodies in frames:
        writer.add(ids, bodies)
    writer.close()
    return out.getvalue()


def test_format():
    body = np.arange(5, dtype="<u4").tobytes()
    raw = packed([([1, None], [body, b""]), ([9], [body * 3])])
    reader = token_files.FrameReader(io.BytesIO(raw), len(raw))
    assert list(token_files.unpack_frame(reader.frame(1))) == [(9, body * 3)]
    assert list(token_files.unpack_frame(reader.frame(0))) == [(1, body), (None, b"")]
    # A decoder that knows nothing of the seek table reads the frames one after the other.
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert stream.read() == reader.frame(0) + reader.frame(1)


def test_damage_is_found():
    raw = bytearray(packed([([1], [np.arange(900, dtype="<u4").tobytes()])]))
    entries = token_files.FrameReader(io.BytesIO(bytes(raw)), len(raw)).entries
    raw[len(raw) - 9 - 2 * 12 + 8] ^= 1  # the first frame's checksum
    reader = token_files.FrameReader(io.BytesIO(bytes(raw)), len(raw))
    assert len(entries) == 1
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(0)
    with pytest.raises(ValueError, match="seekable"):
        token_files.FrameReader(io.BytesIO(bytes(raw[:-1])), len(raw) - 1)


def test_ids_equal_the_library_for_all_code_points():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from credlens.llm import token_files as tf
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    disputed = tf.disputed_code_points(path)
    assert "՘" in disputed  # a letter that the pattern's newer tables know
    encoder = tf.Encoder(path, disputed)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and tf._ASSIGNED.match(chr(c))]
    contexts = ["x{c}'s", "{c}", " {c}", "1{c}2", "{c}{c} a", "a{c}'ll", "\n{c}\t", "'{c}'", "{c}!", "Ab{c}9 "]
    texts = ["".join(ctx.format(c=c) for c in chars[i:i + 500]) for ctx in contexts for i in range(0, len(chars), 500)]
    rng = random.Random(3)
    pool = chars[::7] + list(" \n\t'sx19")
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    ours = list(encoder.encode(texts))
    theirs = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert all(np.frombuffer(o, "<u4").tolist() == t for o, t in zip(ours, theirs))


def test_read_back_over_many_tasks(spark, table, prose, tmp_path):
    import math

    from credlens.llm import token_files as tf
    from credlens.llm.shared import shared_folder
    docs = table([(i, prose(60)) for i in range(300)]).repartition(3)
    folder = f"{shared_folder(spark)}/tasks-{tmp_path.name}"
    tf.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), frame_ids=64)
    frames = tf.frame_table(spark, folder).count()
    read = tf.read_token_files(spark, folder, digest=True)
    assert frames > 2 * tf.FRAMES_PER_TASK
    assert read.rdd.getNumPartitions() == math.ceil(frames / tf.FRAMES_PER_TASK)
    assert read.select(F.spark_partition_id()).distinct().count() > 1 and read.count() == 300


def test_the_basic_pattern_splits_as_the_whole_one():
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"x{c}1{c}2 {c}'{c}s {c}{c}\n{c}  {c}'re'll\t" for c in chars)
    assert token_files.splitter(text) is token_files._BASIC_SPLIT
    assert token_files._BASIC_SPLIT.findall(text) == token_files._SPLIT.findall(text)
    rng = random.Random(9)
    mixed = "".join(rng.choice(chars) if rng.random() < 0.3 else rng.choice(" ab1'stmdrevl.\n\t") for _ in range(200_000))
    assert token_files._BASIC_SPLIT.findall(mixed) == token_files._SPLIT.findall(mixed)
    assert token_files.splitter("a 🎉") is token_files._SPLIT
