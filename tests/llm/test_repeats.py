import hashlib

import numpy as np
import pytest

from patchloom.llm import repeats as R


def brute(rows, length):
    seen, out = {}, []
    for doc_id, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if doc_id is not None:
                seen[w] = min(seen.get(w, doc_id), doc_id)
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if doc_id is not None and seen[b[i:i + length]] < doc_id:
                gone[i:i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2, 10, 4096])
def test_equals_brute_force(spark, make_docs, prose, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT_DOCS", hot)
    rows = prose + [r[:2] for r in odd_rows]
    got = R.repeat_digests(make_docs(rows), block_bytes=60_000).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 50)


def test_spans_and_kept_bytes(spark, make_docs):
    part = "".join(chr(97 + i * 7 % 26) for i in range(60))
    rows = [(1, part), (2, "é" + part + "!"), (3, part[:49])]
    got = {r.doc_id: r for r in R.remove_repeats(make_docs(rows)).collect()}
    assert (got[2].starts, got[2].ends, bytes(got[2].kept)) == ([2], [62], "é!".encode())
    assert bytes(got[1].kept).decode() == part and bytes(got[3].kept).decode() == part[:49]


def test_no_documents_and_extra_columns(spark, make_docs):
    assert R.repeat_digests(make_docs([])).count() == 0
    docs = make_docs([(1, "x" * 80), (2, "x" * 80)]).selectExpr("*", "1 AS block", "2 AS kept")
    assert sorted(r.n_removed for r in R.repeat_digests(docs).collect()) == [0, 80]


def test_longest_previous_factors_against_all_pairs():
    length = 20
    texts = [b"abcabcabcabcabcabcabcabcabc", b"x" * 45, b"xabcabcabcabcabcabcabcabcabcy",
             b"x" * 30 + b"\0" * 25, b"\0" * 24, b"q" * 20]
    owners = [4, 2, 1, 3, 5, 6]
    ends = np.cumsum([len(t) for t in texts])
    places = [(n, i) for n, t in enumerate(texts) for i in range(len(t) - length + 1)]
    starts = np.array([ends[n] - len(texts[n]) + i for n, i in places])
    docs = np.array([owners[n] for n, _ in places])
    suffixes = R.SuffixArray(np.frombuffer(b"".join(texts), np.uint8), ends, starts, length)
    got = R.longest_previous_factors(suffixes, docs, length) >= length
    windows = [texts[n][i:i + length] for n, i in places]
    assert got.tolist() == [any(w == v and e < d for v, e in zip(windows, docs))
                            for w, d in zip(windows, docs)]
    assert got.any() and not got.all()
