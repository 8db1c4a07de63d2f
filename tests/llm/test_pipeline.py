import corpus_pipeline as P
from __spark_entry__ import queries
from patchloom.llm import jaccard, packing, quality, secrets


def test_stages_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == len(P.STAGES) - 1 or docs.columns == columns
        seen[name] = (before, docs)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["quality rules"]
    assert ids(after) == ids(quality.rate(before).filter("kept"))
    before, after = seen["n-gram jaccard join"]
    assert ids(after) == ids(jaccard.link(before, 5, 80).filter("doc_id = component_id"))
    before, after = seen["secret scans"]
    assert ids(after) == ids(before) and secrets.scan(after).filter("spans <> ''").count() == 0
    before, after = seen["source mix"]
    assert ids(after) <= ids(before)
    before, after = seen["best-fit packing"]
    whole = packing.pieces(before).groupBy().sum("length").first()[0]
    assert after.groupBy().sum("length").first()[0] == whole


def test_registered():
    names = set(queries())
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
