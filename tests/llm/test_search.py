import math
import random

import pytest

from patchloom.llm.search import top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=5, step=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(
                x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in good:
        if i % step == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != q)
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("per_block", [7, 8192])
def test_equals_brute_force(spark, per_block):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.0, 1.0, -0.5, rng.uniform(-1, 1)]) for _ in range(6)])
            for i in range(0, 400)]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    rows += [(1000, None), (1001, [1.0, None]), (1050, [math.nan, 1.0]), (1100, [math.inf]),
             (None, [1.0]), (1150, []), (1200, [1.0, 2.0]), (7, rows[7][1]), (7, rows[7][1]),
             (50, rows[50][1]), (-100, rows[3][1])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr(
        "*", "1 AS score", "2 AS c", "3 AS v")
    got = top_k(table, per_block=per_block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows)


def test_small_tables(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0
    two = spark.createDataFrame([(0, [1.0], 0), (3, [-1.0], 0)], SCHEMA)
    assert [tuple(r) for r in top_k(two).collect()] == [(0, 1, 3, -65536)]


def test_copies_of_query_blocks_do_not_pass_the_driver(spark):
    rows = [(i, [float(i % 7), float(i % 11)], 0) for i in range(200)]
    top = top_k(spark.createDataFrame(rows, SCHEMA), per_block=10)
    assert len(top.collect()) == 20
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("filled", [0.05, 0.24, 0.5, 1.0])
def test_scores_of_short_and_long_postings(spark, filled):
    rng = random.Random(int(100 * filled))
    rows = [(i, [rng.choice((-0.75, 0.5, 1.0)) if rng.random() < filled else 0.0 for _ in range(8)])
            for i in range(150)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = top_k(table, per_block=40).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows)
