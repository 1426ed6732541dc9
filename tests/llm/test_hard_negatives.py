"""Hard negatives against a brute force in exact integers: ties, nulls, repeated rows, huge and few components, small blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.llm import hard_negatives as hn

TOP = (1 << 63) - 1


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every, k=5, m=3, low=50, high=95):
    rows = [(i, v, y) for i, v, y in rows if sound(v) and y is not None]
    whole = lambda v: [math.floor(x * 256) if abs(x) < 2**60 else int(x) * 256 for x in v]
    rows = [(i, whole(v), y) for i, v, y in rows]
    out = []
    anchors = {(i, tuple(v), y) for i, v, y in rows if i is not None and i % every == 0}
    for i, v, y in anchors:
        s = [(max(-TOP, min(TOP, sum(a * b for a, b in zip(v, w)))), (j is None, j), j, z) for j, w, z in rows if j != i and len(w) == len(v)]
        s.sort(key=lambda t: (-t[0], t[1]))
        for p, _, j, _ in [t for t in s if t[3] == y][:k]:
            good = [t for t in s if t[3] != y and low * p <= 100 * t[0] <= high * p][:m]
            out += [(i, j, r + 1, t[2], p, t[0]) for r, t in enumerate(good)]
    return sorted(out, key=repr)


def mined(spark, rows, every, kind="double", **kw):
    df = spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows], f"vec_id long, embedding array<{kind}>, label long, id string, `a.b` int")
    return sorted((tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0, **kw).collect()), key=repr)


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, np.round(rng.standard_normal(6) / 4, 1).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(None, rows[3][1], 2), (7, rows[8][1], 1), (9, rows[9][1], rows[9][2]), (10, rows[10][1], rows[10][2]), (500, None, 1), (510, [1.0, None], 1), (520, [float("nan")] * 6, 1), (530, [float("inf")] * 6, 1), (540, rows[1][1], None), (550, [], 1), (551, [], 2), (552, [], 1), (560, [0.0] * 6, 1), (570, [0.5] * 3, 2)]
    want = brute(rows, 10)
    assert want and mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, vector_block=40, anchor_block=7) == want
    assert mined(spark, rows, 10, positives=2, negatives=1, low=20, high=99) == brute(rows, 10, 2, 1, 20, 99)


def test_huge_components(spark):
    rng = np.random.default_rng(1)
    for size in (1e6, 1e8, 1e200, 1e306):
        rows = [(i, (rng.standard_normal(4) * size).tolist(), i % 2) for i in range(60)]
        assert mined(spark, rows, 10) == brute(rows, 10)
    mixed = [(i, [x], i % 2) for i, x in enumerate([1e-3, 1e306, 5.0, -5.0, 2.0**45, 1.0])]
    assert mined(spark, mixed, 1) == brute(mixed, 1)


def test_few_rows(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(0, [1.0], 1)], 10) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.8], 2)], 10) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 3, 65536, 52224)]
    with pytest.raises(ValueError):
        mined(spark, [(0, [1.0], 1)], 10, low=0)
    named = spark.createDataFrame([("a", [1.0], "x"), ("b", [1.0], "x"), ("c", [0.75], "y")], "vec_id string, embedding array<float>, label string")
    assert [tuple(r) for r in hn.mine(named, F.col("vec_id") == "a").collect()] == [("a", "b", 1, "c", 65536, 49152)]
