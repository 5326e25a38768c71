import collections
import hashlib
import random

import numpy as np
import pytest

from credlens.llm import repetition, suffix_dedup


def naive_repeats(bodies, least):
    """Maximal repeats by trying every substring."""
    places = collections.defaultdict(set)
    for i, b in enumerate(bodies):
        for a in range(len(b)):
            for e in range(a + least, len(b) + 1):
                places[b[a:e]].add((i, a))
    found = {}
    for text, at in places.items():
        before = {bodies[i][a - 1] if a else ("start", i) for i, a in at}
        after = {bodies[i][a + len(text)] if a + len(text) < len(bodies[i]) else ("end", i, a) for i, a in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            found[text] = at
    return found


def test_interval_groups_are_the_maximal_repeats():
    rng = random.Random(1)
    for trial in range(80):
        bodies = [bytes(rng.choice(b"ab" if trial % 2 else b"abc") for _ in range(rng.randint(0, 50))) for _ in range(4)]
        got = {}
        for size, places in suffix_dedup.interval_groups(bodies, 10):
            text, = {bodies[i][a:a + size] for i, a in places}
            assert text not in got
            got[text] = set(places)
        assert got == naive_repeats(bodies, 10)


def brute_removal(rows):
    counts = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        counts.update(b[k:k + 400] for k in range(len(b) - 399))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if counts[b[k:k + 400]] > 1:
                gone[k:k + 400] = True
        runs = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def corpus(prose, odd):
    passage, other = prose(75), prose(140)
    rows = [(i, f"{prose(10 + i)} {passage if i % 3 else other} {prose(60 - i)}") for i in range(40)]
    odd = [r for r in odd if r[0] != 7]
    return rows + odd + [(100, passage), (101, passage), (102, "é" * 350), (103, "a" * 1500), (104, "ab" * 300), (105, other + passage + other)]


@pytest.mark.parametrize("unit", [2048, 3])
def test_repeats_are_removed(table, corpus, unit):
    got = suffix_dedup.remove_repeats(table(corpus), unit=unit, batch_bytes=20_000).collect()
    assert sorted(map(tuple, got), key=str) == brute_removal(corpus)


def test_nothing_to_remove(table):
    assert suffix_dedup.remove_repeats(table([])).count() == 0
    row, = suffix_dedup.remove_repeats(table([(1, "short")])).collect()
    assert tuple(row) == (1, 5, 0, 0, hashlib.sha256(b"short").hexdigest())


def test_groups_have_all_occurrences(table, prose):
    passage = prose(90)
    rows = [(i, f"{prose(8)} {passage} {prose(8)}") for i in range(5)]
    found = collections.defaultdict(set)
    texts = {hashlib.sha256(t.encode()).hexdigest()[:32]: t for _, t in rows}
    for r in suffix_dedup.repeat_groups(table(rows)).collect():
        found[r.repeat, r.size].add((r.text_key, r.start))
    assert found and max(map(len, found.values())) == 5
    for (_, size), places in found.items():
        assert size >= 400 and len({texts[k].encode()[a:a + size] for k, a in places}) == 1


def brute_words(text, least):
    words = (text or "").encode().split()
    n, lead, deep, top = len(words), set(), set(), 0
    for i in range(n):
        most = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            most = max(most, k)
        if most >= 3:
            lead |= set(range(i, i + 3))
        if most >= least:
            deep |= set(range(i, i + most))
            top = max(top, most)
    return n, len(lead), len(deep), top


def test_word_repeats_equal_brute_force(table):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab" if i % 2 else "abcd") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = {r.doc_id: r for r in repetition.judge_repetition(table(rows), min_words=4).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_covered_words, r.longest_repeat) == brute_words(text, 4)


def test_rules(table, prose, odd):
    line = prose(12)
    clean = prose(300)
    rows = odd + [(20, clean), (21, "\n".join([clean, *[line] * 12, prose(100)])), (22, prose(500) + " " + clean[:1500] + " x " + clean[:1500]), (23, "a#b * c\na#b\n\n" + clean)]
    got = {(r.doc_id, i): r for i, r in enumerate(repetition.judge_repetition(table(rows)).collect())}
    by_id = {k[0]: r for k, r in got.items()}
    assert len(got) == len(rows)
    assert by_id[20].kept and not by_id[21].kept and not by_id[22].kept and by_id[23].kept
    assert by_id[22].longest_repeat > 100 and not by_id[22].base_failed
    assert (by_id[1].n_words, by_id[1].base_failed, by_id[1].kept) == (0, True, False)
    assert by_id[7].n_words == 60_000 and by_id[7].base_failed
    assert by_id[23].n_symbols == 3 and by_id[23].word_chars == 8 + len(clean.replace(" ", ""))
    df = table(rows)
    kept = repetition.keep_unrepetitive(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [20, 23]
    assert repetition.judge_repetition(table([])).count() == 0


def test_passages_are_listed(table):
    rows = [(1, "x a b c d y a b c d z"), (2, "p q r"), (3, None)]
    got = repetition.repeated_passages(table(rows), min_words=4).collect()
    assert [tuple(r) for r in got] == [(1, 1, 4, 2)]
