import random

import pytest

#: Columns that share names with what operators add; operators must not trip over them.
CLASH = ", ".join(f"`{c}` string" for c in (
    "id", "row", "digest", "kept", "size", "key", "print", "root", "taken", "best", "found", "start", "gram", "n", "top", "base", "rank"))
N_CLASH = CLASH.count("string")


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of (doc_id, text[, lang, source]) rows, with clashing further columns."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), 0, *["x"] * N_CLASH) for r in rows]
        return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}")
    return make


@pytest.fixture
def prose():
    rng = random.Random(11)

    def make(words):
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(words))
    return make


#: Null, empty, blank, repeated and very long texts, and a null id.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "one two"), (None, None),
       (7, "long " * 60_000), (8, "é漢🎉 " * 30)]


@pytest.fixture
def odd():
    return list(ODD)
