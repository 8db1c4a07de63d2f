import re

import numpy as np
import pytest

from patchloom.llm import jaccard as J
from patchloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t, size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


CASES = [(3, 90, {}), (5, 80, {}), (3, 90, {"BLOCK_DOCS": 4, "FAMILY_DOCS": 8, "SKETCH_BITS": 12}),
         (3, 50, {"FAMILY_DOCS": 2, "POSTINGS_PER_BUCKET": 500})]


@pytest.mark.parametrize("size,percent,limits", CASES)
def test_equals_brute_force(spark, make_docs, prose, odd_rows, monkeypatch, size, percent, limits):
    for name, value in limits.items():
        monkeypatch.setattr(J, name, value)
    rows = prose + [r[:2] for r in odd_rows] + [(2000, prose[0][1].upper()), (2001, "One\tTWO")]
    got = J.link(make_docs(rows).selectExpr("*", "1 AS n", "2 AS `group`"), size, percent).collect()
    want = brute(rows, size, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_one_of_each_component_stays(spark, make_docs, prose, odd_rows):
    rows = prose + [r[:2] for r in odd_rows]
    docs = make_docs(rows)
    kept = J.keep_first(docs, 5, 80)
    want = sorted([i for i, (_, c) in brute(rows, 5, 80).items() if i == c] + [8], key=repr)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(None) == 2
    first = brute(rows, 5, 80)
    assert sorted(set(ids) - {None}) == sorted(i for i in first if first[i][1] == i)
    assert want
    assert J.link(make_docs([])).count() == 0


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    counts = np.zeros(1 << 8, np.uint32)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(
            0, 1 << 63, rng.integers(0, 4), dtype=np.uint64)]))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            p, q = (J.in_order(x, counts)[:J.prefix_length(len(x))] for x in (a, b))
            assert len(np.intersect1d(p, q))
            n = np.array([len(a), len(b)])
            assert J.possible(n, np.ones(2, int), [J.signature(a), J.signature(b)], 90).all()


def test_intersections_by_both_ways():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, 40).astype(np.uint64)) for _ in range(50)]
    got = J.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j]))
               for i in range(50) for j in range(50) if i != j)


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 5), (9, 5), (9, 9), (None, 3)] + [
        (500, k) for k in range(501, 540)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (1, 5, 9)} == {1}
    assert {got[i] for i in range(500, 540)} == {500} and 3 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_few_links_take_few_tasks(spark):
    """Rounds over a short chain came to thousands of tasks when many partitions were shuffled to."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-links", "")
        links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
        assert {(r.node, r.component) for r in components(links).collect()} == {
            (i, 0) for i in range(41)}
        seen = sc.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup("few-links") for s in seen.getJobInfo(j).stageIds}
        assert 0 < sum(seen.getStageInfo(s).numTasks for s in stages if seen.getStageInfo(s)) < 100
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_with_more_links_than_a_task_takes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [
        (i, i + 1) for i in range(1000, 1040)] + [(None, 1), (2, None)]
    table = spark.createDataFrame(links + links[:50], "a bigint, b bigint")
    got = lambda: sorted((r.node, r.component) for r in components(table).collect())
    whole = got()
    root = {n: n for a, b in links if a != b and a is not None and b is not None for n in (a, b)}
    for _ in root:
        for a, b in links:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert whole == sorted(root.items())
    # 0: rounds to the end; 150: rounds first, then one task.
    for most in (0, 150):
        monkeypatch.setattr("patchloom.llm.components.LINKS_PER_TASK", most)
        assert got() == whole
