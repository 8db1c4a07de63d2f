import hashlib
import math
import random

import numpy as np
import pytest

from patchloom.llm import clusters as K

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, width, clusters=16, rounds=3, scale=64):
    good = [(i, [max(-K.LARGEST, min(K.LARGEST, math.floor(scale * x))) for x in v])
            for i, v in rows if v is not None and len(v) == width
            and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = sorted(good, key=lambda r: (r[0] is None, r[0] is not None and sha(f"1:{r[0]}"), r[1]))
    centroids = [v for _, v in first[:clusters]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min((apart(v, c), k) for k, c in enumerate(centroids)) for _, v in good]
    for _ in range(rounds):
        now = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(good, now) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    now = assign()
    total = sum(d for d, _ in now)
    per = {k: sum(d for d, c in now if c == k) for k in range(len(centroids))}
    return sorted(((i, c, d, per[c], total, sha(",".join(map(str, centroids[c]))))
                   for (i, _), (d, c) in zip(good, now)), key=repr)


def result(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia,
                    r.centroid_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_brute_force(spark, spread):
    rng = random.Random(7)
    middles = [[rng.uniform(-3, 3) for _ in range(6)] for _ in range(12)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([x + rng.gauss(0, spread) for x in rng.choice(middles)])) for i in range(500)]
    rows += [(900 + i, rows[3][1]) for i in range(40)] + [rows[5], rows[5], (5, rows[6][1])]
    rows += [(1000, None), (1001, [1.0, None] * 3), (1002, [math.nan] * 6), (1003, [math.inf] * 6),
             (1004, []), (1005, [1.0] * 7), (None, f32([0.5] * 6)), (1006, f32([1e30, -1e30] + [0] * 4))]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr(
        "*", "1 AS cluster", "2 AS v", "3 AS d", "4 AS distance").repartition(5)
    got = K.cluster(table, width=6)
    assert result(got) == brute(rows, 6)
    if spread < 0.1:  # near centroids, most distances need no check
        assert sum(r.checks for r in got.collect()) < 0.5 * 16 * got.count()


def test_bounds_stay_below(spark):
    rng = np.random.default_rng(1)
    for size in (3, 1 << 12, 1 << 27):
        v, c = (rng.integers(-size, size, (n, 8)) for n in (300, 16))
        c[5], v[7], v[8] = c[4], c[4], 0
        pivots = K.spread_pivots(c, 5)
        low = K.lower_bounds(*(K.to_pivots(x, pivots) for x in (v, c, pivots)))
        exact = np.stack([K.squared(v, x) for x in c], 1)
        assert (low <= exact).all() and (low > 0.2 * exact).any()
        cluster, best, _ = K.nearest(v, K.to_pivots(v, pivots), c, pivots)
        assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()


def test_small_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert K.cluster(make([]), width=2).count() == 0
    assert K.cluster(make([(1, None)]), width=2).count() == 0
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert result(K.cluster(make(same), width=2)) == brute(same, 2)
    two = [(1, [0.0, 0.0]), (2, [1.0, 1.0])]
    assert result(K.cluster(make(two), width=2)) == brute(two, 2)
