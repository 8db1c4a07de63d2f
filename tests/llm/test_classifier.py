import random
import zlib

import numpy as np
import pytest

from patchloom.llm import classifier as K


@pytest.fixture(scope="module")
def sample(spark, make_docs):
    rng = random.Random(4)
    syllables = ["ba", "ne", "ti", "ro", "su", "mel", "kor", "van"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(500):
        n = rng.randint(5, 120)
        if i % 4:
            text = " ".join(word() for _ in range(n))
        elif i % 8:
            text = " ".join(w + "$$$" for w in (word() for _ in range(n)))
        else:
            text = " ".join(w for w in (word() for _ in range(n // 8 + 2)) for _ in range(9))
        rows.append((i, text))
        labels.append((i, int(i % 4 > 0), 0))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark, sample):
    docs, labels = sample
    got = {r.doc_id: r for r in K.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.predicted, int(i % 4 > 0)) for i, r in got.items() if r.held_out]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(spark, sample):
    docs, labels = sample
    turned = labels.selectExpr(
        "doc_id", "IF(crc32(encode(string(doc_id), 'UTF-8')) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = (K.fit(docs, x, rows=60) for x in (labels, turned))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_features_do_not_depend_on_batches():
    texts = [b"", b"one two two", b" \n ", "é ü".encode(), b"x" * 3000, b"a b " * 500]
    alone = []
    for t in texts:
        found = [K.features(*piece)[0] for piece in K.pieces([t])]
        alone.append(sorted(np.concatenate(found).tolist()))
    together = [[] for _ in texts]
    for data, owner in K.pieces(texts):
        slots, ends = K.features(data, owner)
        for s, d in zip(slots.tolist(), owner[ends].tolist()):
            together[d].append(s)
    assert alone == [sorted(t) for t in together]


def test_scores_do_not_depend_on_other_rows(spark, make_docs, monkeypatch):
    model = (np.random.default_rng(1).normal(size=1 << K.TABLE_BITS).astype(np.float32), 0.1)
    monkeypatch.setattr(K, "CHUNK", 500)
    rows = [(i, t) for i, t in enumerate(["hello", "other words", "", None, "ab " * 400, "x" * 1200,
                                          "hello", "a b c d e " * 40])]
    together = {r.doc_id: r.score for r in K.score(make_docs(rows).coalesce(1), model).collect()}
    for i, t in rows:
        assert K.score(make_docs([(i, t)]), model).first().score == together[i]
    assert together[0] == together[6]


def test_repeated_ids_in_training_count_once(spark, sample):
    docs, labels = sample
    one = K.fit(docs, labels, rows=40)
    more = K.fit(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels), rows=40)
    assert np.array_equal(one[0], more[0]) and one[1] == more[1]


def test_odd_rows(spark, sample, make_docs, odd_rows):
    model = K.fit(*sample, rows=50)
    docs = make_docs(odd_rows).selectExpr("*", "1 AS score", "2 AS predicted")
    got = K.score(docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert K.score(make_docs([]), model).count() == 0
    none = sample[1].limit(0)
    assert {r.score for r in K.classify(make_docs([(1, "x")]), none).collect()} == {0.5}
