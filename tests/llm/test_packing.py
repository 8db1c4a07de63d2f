import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from patchloom.llm import packing as K


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers_file():
    rng = random.Random(1)
    parts = [" ", "  ", "   ", "\n", "\t", "\xa0", "a", "bc", "é", "1", "22", "!", ".", "'s", "ß",
             "<|endoftext|>", "日本", "\r\n", "\x85", "　", "\x1c", "🎈", "Hello", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(8000)]
    ours = K.ChunkTokenizer(K.vocabulary_path(), public_tokenizers.PATTERN).batch(texts)
    want = reference().encode_batch(texts, add_special_tokens=False)
    assert all(w.ids == o.tolist() for w, o in zip(want, ours))


def one_by_one(counts, capacity):
    """Sequences that best fit, longest first, opens when it places piece by piece."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = bisect.bisect_left(room, length)
            free = room.pop(k) if k < len(room) else capacity
            bisect.insort(room, free - length)
    return len(room)


def test_plan_fills_every_rank_once_and_stays_in_capacity():
    rng = random.Random(2)
    counts = Counter(rng.choice([1, 3, 7, 50, 64]) if rng.random() < 0.5 else rng.randint(1, 64)
                     for _ in range(5000))
    taken, filled = {}, Counter()
    places = {}
    for length, first_rank, n, first, per, offset in K.plan_slots(counts, 64):
        for i in range(n):
            rank = first_rank + i
            assert (length, rank) not in taken
            taken[length, rank] = True
            seq, at = first + i // per, offset + i % per * length
            assert at == filled[seq] or (seq, at) not in places
            places[seq, at] = length
            filled[seq] += length
    assert Counter(k for k, _ in taken) == counts and max(filled.values()) <= 64
    for seq in filled:
        at = 0
        for place in sorted(p for s, p in places if s == seq):
            assert place == at
            at += places[seq, place]
    assert len(filled) == one_by_one(counts, 64)


def test_pieces_round_trip(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = K.pack(docs, with_ids=True).collect()
    ref = reference()
    want = Counter()
    for r in docs.collect():
        ids = ref.encode(r.text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(head, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    for parts in by.values():
        at = 0
        for offset, length, ids in sorted(parts):
            assert offset == at and len(ids) == length
            at += length
        assert at <= 1024
    joined = {r.sequence_id: r.ids for r in K.sequences(K.pack(docs, with_ids=True)).collect()}
    assert sum(map(len, joined.values())) == sum(r.length for r in rows)


def test_no_documents(spark, make_docs):
    assert K.pack(make_docs([])).count() == 0


def test_added_tokens_are_one_id(spark, make_docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # default settings
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "bc", "<|endoftext|>", "<|endoftext|", "日本", "'s", "1"]
    texts = ["a <|endoftext|> b", *("".join(rng.choices(parts, k=rng.randint(0, 12)))
                                    for _ in range(500))]
    rows = K.pieces(make_docs(list(enumerate(texts))), with_ids=True).collect()
    want = t.encode_batch(texts, add_special_tokens=False)
    assert {r.doc_id: r.ids for r in rows} == {k: w.ids + [2] for k, w in enumerate(want)}
    assert [64, 220, 50256, 275, 2] in [r.ids for r in rows]
