import collections
import random
import re

import numpy as np
import pyarrow as pa

from credlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(rows, top=200):
    """rows: (lang, source, text); the audit in plain Python integers."""
    rows = [(lang or "", source or "", t) for lang, source, t in rows]
    groups = sorted({(lang, s) for lang, s, _ in rows})
    per_doc = [(lang, s, terms_of(t)) for lang, s, t in rows]
    df, cnt = collections.Counter(), collections.Counter()
    for lang, s, ts in per_doc:
        df.update((lang, t) for t in set(ts))
        cnt.update((lang, s, t) for t in ts)
    out = []
    for lang in sorted({g[0] for g in groups}):
        kept = sorted(t for (la, t), n in df.items() if la == lang and n >= 3)
        v = len(kept)
        lang_count = {t: sum(n for (la, _, tt), n in cnt.items() if la == lang and tt == t) for t in kept}
        nl = sum(lang_count.values())
        sources = [s for la, s in groups if la == lang]

        def p(source):
            n = sum(cnt[(lang, source, t)] for t in kept)
            return {t: 1 + 10**9 * (cnt[(lang, source, t)] + 1) // (n + v) for t in kept}
        ps = {s: p(s) for s in sources}
        q_lang = {t: 1 + 10**9 * (lang_count[t] + 1) // (nl + v) for t in kept}
        for s in sources:
            pairs = [(o, sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (ps[s][t] - q_lang[t]) ** 2 // q_lang[t]) for t in kept if cnt[(lang, s, t)] > 0 and ps[s][t] > q_lang[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items, 1)]
    return sorted(out)


def test_radix_order_equals_lexsort():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 5, 1000, dtype=np.uint64), rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64, endpoint=True) % 7,
            rng.integers(0, 2**63, 1000, dtype=np.uint64)]
    order = divergence.radix_order(keys)
    assert (order == np.lexsort(keys[::-1], axis=0)).all()
    assert len(divergence.radix_order([np.zeros(0, np.uint64)])) == 0


def test_batch_counts_against_python():
    rng = random.Random(5)
    alphabet = ["a", "B", "z", "é", "漢", "🎉", " ", "1", "_", "\n", "Ä", "x" * 9, "y" * 17, "Q" * 40]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "a"]
    groups = np.array([i % 3 for i in range(len(texts))])
    g, terms, n, d = divergence.count_terms(groups, pa.array(texts))
    got = {(int(a), t.decode()): (int(b), int(c)) for a, t, b, c in zip(g, terms, n, d)}
    occ, docs = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        ts = terms_of(t)
        occ.update((i % 3, x) for x in ts)
        docs.update((i % 3, x) for x in set(ts))
    assert got == {k: (occ[k], docs[k]) for k in occ}


def test_audit_against_brute_force(table, odd, prose):
    rows = [(f"l{i % 2}", ["hot", "hot", "hot", "b", None][i % 5], prose(30) + " Zeta zeta ÉTÉ été") for i in range(40)]
    rows += [("l0", "lonely", None), (None, "x", "alpha beta"), (None, "x", "alpha"), (None, "y", "alpha beta gamma"),
             ("l3", "only", "one two three"), ("l4", "a", "z"), ("l4", "b", "")]
    full = [(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)] + [(i, t, "l0", "odd") for i, t in odd]
    got = divergence.divergence_report(table(full)).collect()
    assert sorted(tuple(r) for r in got) == brute([(lang, s, t) for _, t, lang, s in full])
    assert {r.part for r in got} == {"pair", "term"}


def test_top_ranks_only_and_empty(table):
    words = [f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)]
    rows = [(i, " ".join(words + (words[:250] if i < 3 else [])), "en", "s0" if i < 3 else "s1") for i in range(6)]
    got = divergence.divergence_report(table(rows)).collect()
    terms = [r for r in got if r.part == "term"]
    assert max(r.rank for r in terms) == 200 and sum(r.source == "s0" for r in terms) == 200
    assert sorted(tuple(r) for r in got) == brute([(lang, s, t) for _, t, lang, s in rows])
    assert divergence.divergence_report(table([])).count() == 0


def test_pair_sums_are_exact_in_both_arithmetics():
    rng = np.random.default_rng(7)
    k, terms = 5, 60
    dense = rng.integers(0, 4, (terms, k)) * rng.integers(0, 10**6, (terms, k))
    dense[np.arange(terms), rng.integers(0, k, terms)] += 1
    tots, vocab = dense.sum(axis=0), terms + 9
    p = [[1 + 10**9 * (int(c) + 1) // (int(t) + vocab) for c, t in zip(row, tots)] for row in dense]
    at = [np.flatnonzero(row) for row in dense]
    for exact in (True, False):
        f, u = divergence.pair_sums(at, [row[a] for row, a in zip(dense, at)], tots, vocab, exact)
        for i in range(k):
            for j in range(k):
                seen = [t for t in range(terms) if dense[t, i] or dense[t, j]]
                if i != j:
                    assert u[i, j] == len(seen)
                    assert int(f[i, j]) == sum((p[t][i] - p[t][j]) ** 2 // p[t][j] for t in seen)


def test_slices_hold_every_row_once_and_bounded_bytes():
    texts = ["a" * (7 * i % 50) for i in range(200)] + [None, "", "b" * 500, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * len(texts)), pa.array(["s"] * len(texts)), pa.array(texts)], ["lang", "source", "text"])
    slices = list(divergence._slices([batch, batch.slice(0, 0), batch.slice(3, 5)], 100))
    assert [t for s in slices for t in s.column(2).to_pylist()] == texts + texts[3:8]
    assert len(slices) > 40 and all(sum(len(t or "") for t in s.column(2).to_pylist()[1:]) <= 100 for s in slices)
