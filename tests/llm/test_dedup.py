import collections
import hashlib
import random

import numpy as np
import xxhash

from credlens.llm import cuckoo, simhash


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_cuckoo_index_against_a_set():
    rng, index, live = random.Random(0), cuckoo.CuckooIndex(buckets=4), {}
    for step in range(6000):
        k = key(rng.randint(0, 1500))
        if rng.random() < 0.6:
            if k not in live:
                live[k] = index.insert(k)
        else:
            assert index.delete(k) == live.pop(k, -1)
        if step % 50 == 0:
            assert len(index) == len(live)
            assert all(index.find(k) == e for k, e in live.items())
            assert index.find(key(-step - 1)) == -1
    assert index.buckets > 4  # overflow made it grow


def test_hit_is_verified():
    index = cuckoo.CuckooIndex()
    a = bytes(10) + b"a" * 22
    index.insert(a)
    assert index.find(bytes(10) + b"b" * 22) == -1  # same fingerprint and buckets, another key
    assert index.find(a) == 0


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def test_exact_duplicates(table, odd):
    rows = odd + [(i, "same") for i in range(100, 140)] + [(9, "Same"), (10, "same ")]
    got = cuckoo.exact_duplicates(table(rows), buffer=5).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)
    stays = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(stays.values()) == {1} and len(stays) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert cuckoo.exact_duplicates(table([])).count() == 0


def test_drop_copies_keeps_whole_rows(table, odd):
    df = table(odd + [(11, "one two"), (12, "other")])
    kept = cuckoo.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(
        [(2, ""), (3, " \n\t"), (11, "one two"), (7, "long " * 60_000), (8, "é漢🎉 " * 30), (12, "other")])
    again = cuckoo.drop_copies(table([(4, "one two"), (4, "one two"), (3, "one two")])).collect()
    assert [(r.doc_id, r.text) for r in again] == [(4, "one two")]
    assert cuckoo.drop_copies(table([])).count() == 0


def test_live_digests(spark):
    live = spark.createDataFrame([], "digest binary, n bigint")
    first = [(i, "insert", key(i % 30)) for i in range(60)] + [(60, "insert", None)]
    second = [(0, "delete", key(1)), (1, "delete", key(2)), (2, "delete", key(2)), (3, "delete", key(99)), (4, "insert", key(40))]
    for batch in (first, second):
        changes = spark.createDataFrame(batch, "seq bigint, op string, digest binary")
        live = spark.createDataFrame(cuckoo.update_live(live, changes, shards=3).collect(), "digest binary, n bigint")
    want = {key(i): 2 for i in range(30)} | {key(1): 1, key(40): 1}
    del want[key(2)]
    assert {bytes(r.digest): r.n for r in live.collect()} == want


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and group[j] < group[i]:
                    group[i], changed = group[j], True
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group)), key=str)


def near_copies(prose, n):
    rng, base, rows = random.Random(5), [prose(120) for _ in range(4)], []
    for i in range(n):
        words = base[i % 4].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words)))
    return rows


def test_components_equal_brute_force(table, prose, odd):
    rows = near_copies(prose, 80) + odd + [(20, prose(3)), (21, prose(2)), (22, "AbC d\x0be F"), (23, "abc D E f"), (24, " x y")]
    want = brute_components(rows)
    assert len({w[2] for w in want}) < len(rows) - 20
    for limits in ({}, {"unit": 2, "split_bits": 3}):
        got = simhash.near_duplicates(table(rows), **limits).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(table([])).count() == 0


def test_one_document_of_each_component_stays(table, prose, odd):
    rows = near_copies(prose, 40) + odd
    df = table(rows)
    kept = simhash.keep_one_each(df)
    want = brute_components(rows)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_trie_walk_against_all_pairs():
    rng = np.random.default_rng(0)
    for trial in range(30):
        prints = rng.integers(0, 2**64, 12, dtype=np.uint64)[rng.integers(0, 12, 300)]
        for _ in range(3):
            prints = prints ^ np.where(rng.random(300) < 0.6, np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64), np.uint64(0))
        prints = np.unique(prints)
        units = np.zeros(len(prints), int)
        got = simhash.link_sorted(units, units, prints, frontier=int(rng.choice([3, 1000])))
        root = list(range(len(prints)))
        for i in range(len(prints)):
            for j in range(i):
                if bin(int(prints[i] ^ prints[j])).count("1") <= 3:
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        assert got.tolist() == root


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(-5, 100), (100, 7000)], "u bigint, v bigint")
    got = {r.node: r.root for r in simhash.connect(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100: -5, 7000: -5}
