import pytest
from pyspark.sql import functions as F

from patchloom.llm import mixing as M


def water(sizes):
    """Targets by sharing again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in order if x not in capped)
                 for s in order if s not in capped}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 5000, None: 10, "ä": 7, "Z": 300},
    {"a": 0, "b": 0}, {"a": 0, "b": 9}, {"x": 1}, {f"s{i}": 3 ** i for i in range(9)}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.targets(table).collect()}
    assert got == pytest.approx(water(sizes))


def docs_of(make_docs):
    rows = []
    for s, n in (("a", 400), ("b", 60), ("c", 60), (None, 30)):
        rows += [(len(rows) + i, "w " * (i % 23 + 1), "en", s) for i in range(n)]
    return make_docs(rows)


def test_taken_words_come_near_targets(spark, make_docs, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", 16)
    docs = docs_of(make_docs)
    got = M.mix(docs)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"),
                                       F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= r.m
    assert got.filter("taken > 3 * size").count() == 0
    assert got.filter("size > 0 AND taken < epochs * size").count() == 0
    again = M.mix(docs.repartition(7))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_heavier_documents_are_taken_more_often(spark, make_docs):
    docs = make_docs([(i, "one word", "en", "a") for i in range(1000)]
                     + [(5000 + i, "one word", "en", "b") for i in range(1000)])
    weights = spark.range(0, 1000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 4.0, 1.0) AS weight")
    part = M.mix(docs, weights).filter("source = 'a' AND part")
    even = part.filter("doc_id % 2 = 0").count()
    assert 0.6 * part.count() < even < 0.75 * part.count()


def test_copies(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).selectExpr("*", "1 AS size", "2 AS taken", "3 AS _times")
    out = M.repeated(docs)
    assert out.columns == docs.columns
    assert M.repeated(make_docs([])).count() == 0 and M.mix(make_docs([])).count() == 0
    docs = docs_of(make_docs)
    times = {r.doc_id: r.n for r in M.repeated(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {r.doc_id: r.taken // r["size"] for r in M.mix(docs).collect() if r.taken}
    assert times == want


@pytest.mark.parametrize("weights", [[1.0], [0.05], [2.0, 0.5, 1.0], [1e-6, 1e6, 3.0]])
def test_buckets_are_even(spark, monkeypatch, weights):
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", 500)
    powers = F.array(*[F.struct(F.round(4 * F.log2(F.lit(w))).cast("int").alias("power"),
                                F.lit(20_000 // len(weights)).alias("n")) for w in weights])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("id") % len(weights) + 1).cast("int"))
    keyed = spark.range(20_000 // len(weights) * len(weights)).withColumns({
        "powers": powers, "n_docs": F.lit(20_000 // len(weights) * len(weights))}).withColumn(
        "key", -F.log(M.uniform(F.col("id"))) / weight)
    counts = keyed.groupBy(F.floor(M.key_share(F.col("key")) * 40).alias("b")).count().collect()
    assert max(r["count"] for r in counts) < 1_000 and len(counts) >= 20


def test_equal_ids_of_unequal_sizes_agree(spark, make_docs):
    rows = [(1, "w " * n, "en", "a") for n in (5, 3, 9, 1)] + [(i, "v " * 7, "en", "b") for i in range(2, 60)]
    def taken(order):
        got = M.mix(make_docs(order).repartition(3)).collect()
        return sorted((r.doc_id, r.size, r.taken) for r in got)
    assert taken(rows) == taken(rows[::-1]) == taken(rows[2:] + rows[:2])
