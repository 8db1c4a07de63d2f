import math
import random
import re
import zlib
from collections import Counter

import pytest

from patchloom.llm import suffix_tree as T


def brute(rows, depth=2, least=8, smooth=T.SMOOTH, divergence=T.DIVERGENCE):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None] for _, t, *_ in rows]
    counts, gains, windows = Counter(), Counter(), lambda d, i, k: tuple(d[i - k:i])
    for (i, *_), d in zip(rows, tokens):
        if not held(i):
            for j, w in enumerate(d):
                for k in range(min(depth, j) + 1):
                    counts[windows(d, j, k) + (w,)] += 1
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)

    def p(context, w):
        if not context:
            return (counts[(w,)] + .5) / (n + .5 * (v + 1))
        return (counts[context + (w,)] + smooth * p(context[1:], w)) / (counts[context] + smooth)

    for g, c in counts.items():
        s = g[:-1]
        if s and counts[s] >= least:
            shorter = p(s[1:], g[-1])
            loo = (c - 1 + smooth * shorter) / (counts[s] - 1 + smooth)
            gains[s] += round(c * math.log(loo / shorter) * T.UNIT)
    tree = {s for s, x in gains.items() if x > divergence * T.UNIT}
    out = []
    for (i, *_), d in zip(rows, tokens):
        total = base = 0.0
        for j, w in enumerate(d):
            base += math.log10(p((), w))
            state = next((windows(d, j, k) for k in range(min(depth, j), 0, -1)
                          if windows(d, j, k) in tree), ())
            total += math.log10(p(state, w))
        out.append((i, held(i), len(d), sum(counts[(w,)] > 0 for w in d), n, base, total))
    return sorted(out, key=repr), tree


def result(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                   for r in df.collect()), key=repr)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def phrases():
    """Texts from a second-order source, so that contexts of one and two words tell something."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(24)]
    onward = {(a, b): rng.choices(words, k=3) for a in words for b in words[:8]}
    onward |= {(a, b): words[i:i + 3] for a in words for i, b in enumerate(words[8:16])}
    rows = []
    for i in range(400):
        text = rng.choices(words, k=2)
        for _ in range(rng.randint(0, 60)):
            text.append(rng.choice(onward.get(tuple(text[-2:]), words)))
        rows.append((i, " ".join(t.upper() if rng.random() < .1 else t for t in text)))
    return rows


@pytest.mark.parametrize("depth, block_bytes, piece_bytes", [(2, 8_000_000, 2_000_000),
                                                             (2, 700, 60), (1, 2_000, 500), (3, 900, 80)])
def test_equals_brute_force(spark, make_docs, phrases, depth, block_bytes, piece_bytes):
    want, tree = brute(phrases, depth, smooth=2.0)
    assert {len(s) for s in tree} >= {1, min(depth, 2)}
    got = T.score(make_docs(phrases).repartition(4), depth=depth, smooth=2.0, block_bytes=block_bytes,
                  piece_bytes=piece_bytes)
    same(result(got), want)


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).selectExpr("*", "1 AS block", "2 AS score", "3 AS train", "4 AS k")
    same(result(T.score(docs, block_bytes=50_000, piece_bytes=10_000)), brute(odd_rows)[0])


def test_small_tables(spark, make_docs):
    assert T.score(make_docs([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    for rows in ([(held, "all held out")], [(held, None)], [(None, "")]):
        same(result(T.score(make_docs(rows))), brute(rows)[0])


def test_held_out_gain(spark, make_docs, phrases):
    rows = [r for r in result(T.score(make_docs(phrases))) if r[1]]
    assert sum(r[6] for r in rows) > sum(r[5] for r in rows)
