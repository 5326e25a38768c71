import math
import random

import numpy as np
import pytest

from credlens.llm import hard_negatives as hn


def brute(rows):
    """rows: (vec_id, vector, label); the mined rows in plain Python."""
    valid = []
    for rid, (vid, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vid is not None and vid % 7 == 0 else label
        valid.append((rid, vid, label, [math.floor(256 * float(x)) for x in vec]))

    def order(item):
        return (-item[0], item[1][1] is None, item[1][1] or 0, item[1][0])
    out = []
    for a in valid:
        if a[1] is None or a[1] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a[3], c[3])), c) for c in valid]
        pos = sorted((s, c) for s, c in scored if c[2] == a[2] and c[0] != a[0])
        for ps, p in sorted(pos, key=order)[:5]:
            negs = sorted([(s, c) for s, c in scored if c[2] != a[2] and 80 * ps <= 100 * s <= 100 * ps], key=order)[:5]
            out += [(a[1], p[1], rank, n[1], ps, ns) for rank, (ns, n) in enumerate(negs, 1)]
    return sorted(out, key=str)


def test_four_russians_equals_dot_products():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-300, 300, (7, 24)), rng.integers(-300, 300, (50, 24))
    bits = int(np.abs(np.concatenate([a, c])).max()).bit_length() + 1
    got = hn.four_russians_scores(hn.subset_tables(a), hn.bit_planes(c, bits))
    assert (got == a @ c.T).all()


def test_mining_against_brute_force(spark):
    rng = random.Random(7)
    base = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(6)]
    rows = []
    for i in range(700):
        v = [x + rng.uniform(-0.3, 0.3) for x in base[i % 6]]
        rows.append((i, v, rng.randint(0, 3)))
    rows += [(800, base[0], 1), (800, base[0], 1), (900, base[1], 2), (901, base[1], 2), (902, base[1], 3),
             (None, base[0], 1), (903, None, 1), (904, [0.1, None] + base[0][2:], 1), (905, [float("nan")] * 16, 1),
             (906, [float("inf")] * 16, 2), (907, base[0], None), (1000, base[2][:9], 2), (1001, [], 2), (1100, base[3], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hn.hard_negatives(df.withColumn("rank", df.label).withColumn("score", df.vec_id)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(v, None if e is None else [float(np.float32(x)) if x is not None else None for x in e], la)
                                                              for v, e, la in rows])
    assert got and {r.anchor_id for r in got} >= {0, 100, 800, 1000}


def test_empty_and_too_large(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hn.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [0.5], 1)], schema)).count() == 0  # no anchor
    with pytest.raises(ValueError):
        hn.hard_negatives(spark.createDataFrame([(0, [3e37] * 8, 1), (1, [1.0] * 8, 1)], schema)).count()
