import collections
import hashlib
import random
from fractions import Fraction

import pytest

from credlens.llm import mixing


def brute_targets(sizes):
    """Targets of {source: size}: shares by weight, cut at twice the size, the excess shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = Fraction(3, 2) * sum(sizes.values())
    cap = {s: 2 * n for s, n in sizes.items()}
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    while excess := sum(max(0, target[s] - cap[s]) for s in order):
        open_sources = [s for s in order if target[s] < cap[s]]
        share = sum(weight[s] for s in open_sources)
        target = {s: min(target[s], Fraction(cap[s])) for s in order}
        if not share:
            break
        for s in open_sources:
            target[s] += excess * weight[s] / share
    return target


def brute_mix(rows):
    docs = [(i, src, len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]),
             int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)) for i, t, _, src in rows]
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    targets = brute_targets(sizes)
    out = []
    for s, total in sizes.items():
        times = min(2, targets[s] // total) if total else 0
        left = targets[s] - times * total
        own, at = sorted((d for d in docs if d[1] == s), key=lambda d: d[3]), 0
        while at < len(own):
            tie = [d for d in own if d[3] == own[at][3]]
            size = sum(d[2] for d in tie)
            for i, _, n, _ in tie:
                if size <= left:
                    more = n
                elif left < 0:
                    more = 0
                elif len(tie) == 1:
                    more = n if 2 * left >= n else 0
                else:
                    more = int(left * n / size)
                out.append((i, n, total, round(float(targets[s]), 6), int(times * n + more)))
            left = left - size if size <= left else Fraction(-1)
            at += len(tie)
    return sorted(out, key=str)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    return [(i, "w " * rng.choice([0, 1, 5, 40, 300]), "en", rng.choice(sources)) for i in range(n)]


CASES = [
    rows_of(1, 200, ["a", "a", "a", "a", "b", "c", None]),
    rows_of(2, 90, ["Z", "a", "é", "漢", "🎉", ""]),
    rows_of(3, 40, ["only"]) + [(5, "x y z", "en", "only")] * 30,
    [(None, "a b c", "en", None), (None, None, "en", None), (1, "", "en", "s"), (2, "long " * 50_000, "en", "t")] * 2,
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("rows_for_broadcast", [50_000, 0])
def test_mix_equals_brute_force(table, monkeypatch, case, rows_for_broadcast):
    from credlens.llm import shared
    monkeypatch.setattr(shared, "BROADCAST_ROWS", rows_for_broadcast)
    got = mixing.mix_sources(table(CASES[case])).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute_mix(CASES[case])


def test_targets_are_met_and_reruns_agree(table):
    rows = CASES[0]
    got = mixing.mix_sources(table(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(table(rows[::-1])).collect()))
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target.setdefault((r.target, r.source_size), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 150 for (t, _), v in by_target.items())
    assert mixing.mix_sources(table([])).count() == 0


def test_documents_of_the_mix(table):
    rows = CASES[2]
    df = table(rows)
    mixed = mixing.take_mix(df)
    assert mixed.columns == df.columns
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix_sources(df).collect())
    assert mixing.take_mix(table([])).count() == 0


@pytest.mark.parametrize("rows_for_broadcast", [50_000, 0])
def test_rows_that_share_the_threshold_stay_whole(table, monkeypatch, rows_for_broadcast):
    """Null ids, one long text many times, and equal rows: none is cut, and the words meet the target."""
    from credlens.llm import shared
    monkeypatch.setattr(shared, "BROADCAST_ROWS", rows_for_broadcast)
    rows = [(None, f"n{i} " + "w " * (i % 50), "en", "nulls") for i in range(200)]
    rows += [(7, "long " * 50_000 + str(i), "en", "long") for i in range(6)]
    rows += [(8, "a b c d e", "en", "same")] * 3000 + [(None, "", "en", "nulls"), (8, None, "en", "same")]
    got, sizes = mixing.take_mix(table(rows)).collect(), {}
    times = collections.Counter((r.source, r.text) for r in got)
    given = collections.Counter((s, t) for _, t, _, s in rows)
    assert set(times) <= set(given) and all(n <= 2 * given[k] for k, n in times.items())
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)
    for source, most in (("nulls", 50), ("long", 50_001), ("same", 5)):
        words = sum(len(t.split()) * n for (s, t), n in times.items() if s == source)
        assert sizes[source] and abs(words - targets[source]) <= most, source
    again = mixing.take_mix(table(rows[::-1])).collect()
    assert times == collections.Counter((r.source, r.text) for r in again)
