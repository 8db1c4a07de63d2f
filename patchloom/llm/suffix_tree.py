"""Language-model scores from a probabilistic suffix tree of words.

A node of the tree is a context of up to ``depth`` words; it stands for the distribution of the word
that follows. Distributions are smoothed towards the context one word shorter, down to smoothed word
frequencies. A context is kept if it is frequent and its leave-one-out divergence from the shorter
one is large: the log-likelihood that it gains on its own occurrences, each predicted from the others.
A word is scored by the longest kept suffix of what stands before it.

The tree grows with the corpus, so nobody ever holds it whole. Documents are hashed into blocks once.
Each round, blocks send their distinct word sequences with counts to buckets by key, and buckets
answer with totals to the blocks that asked; sums for divergences travel the same way. A sequence in
any number of documents is one entry per block, so no key is hot. Sequences are asked about only if
their context turned out frequent in the round before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm import hashing as H
from patchloom.llm.repeats import from_planes, in_buckets, packed, planes, unpacked

DEPTH = 2                    # words of the longest context
LEAST = 8                    # training occurrences of a context that may be kept
SMOOTH = 100.0               # weight of the shorter context's distribution, in occurrences
DIVERGENCE = 2.0             # least gain of a kept context, in nats over all its occurrences
HELD_OUT, REMAINDER = 5, 1   # rows whose crc32(doc_id) leaves this remainder are not trained on
BLOCK_BYTES = 12_000_000
PIECE_BYTES = 2_000_000      # a longer text is cut at white space
BUCKET_KEYS = 1_500_000
LEAST_BUCKETS = 12
END = np.uint64(0x2545F4914F6CDD1D)   # the token after a document's last word
UNIT = 1024.0                # divergences are summed as whole parts of a nat, in any order
COUNTS, GAINS = 0, 1
LEAST_BITS, SPARE_BITS = 40, 11  # a sequence of words has a key of log2(tokens) + SPARE_BITS bits,
                             # so that at any size one in a thousand meets another; a word has 64
RAW_PLANES = 4               # low bytes of key differences are noise and not worth compressing


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % HELD_OUT == REMAINDER,
                      F.lit(False))


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte place by byte place."""
    places = planes(np.diff(keys, prepend=np.uint64(0)), 8)
    high = zlib.compress(places[RAW_PLANES:].tobytes(), 1)
    return packed(places[:RAW_PLANES], np.frombuffer(high, np.uint8))


def from_steps(blob: bytes) -> np.ndarray:
    low, high = unpacked(blob, np.uint8, np.uint8)
    high = np.frombuffer(zlib.decompress(high), np.uint8)
    return np.cumsum(from_planes(np.concatenate([low, high]), 8), dtype=np.uint64)


class Model:
    """Parameters of the tree, and sizes of the corpus once they are known."""

    def __init__(self, depth: int, least: int, smooth: float, divergence: float,
                 all_tokens: int) -> None:
        self.depth, self.least, self.smooth, self.divergence = depth, least, smooth, divergence
        self.n_buckets = max(LEAST_BUCKETS, math.ceil(0.85 * all_tokens / BUCKET_KEYS))
        self.drop_bits = 64 - min(64, max(LEAST_BITS, all_tokens.bit_length() + SPARE_BITS))
        self.n_tokens = self.n_types = 0  # of training, known after the first round


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys sorted, number of each key's), in less memory than the general function."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], number


# --- blocks of hashed documents -----------------------------------------------


def pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes; words stay whole."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and not H.IS_SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def hashed(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text, made over many texts at a time."""
    out, group, filled = [], [], 0

    def flush() -> None:
        words, starts = H.word_hashes(np.frombuffer(b" ".join(group), np.uint8))
        begins = np.cumsum([0] + [len(t) + 1 for t in group])
        cut = np.searchsorted(starts, begins)
        out.extend(words[a:b] for a, b in zip(cut[:-1], cut[1:]))

    for text in texts:
        group.append(text)
        filled += len(text)
        if filled >= PIECE_BYTES:
            flush()
            group, filled = [], 0
    if group:
        flush()
    return out


def blocks(docs: DataFrame, depth: int, block_bytes: int, piece_bytes: int) -> DataFrame:
    """block, tokens, body: hashed documents, several to a block. A document in pieces carries the
    last words of a piece on to the next, where they are context only."""
    rows = docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        held, filled, number, row, before = [], 0, base, base, np.zeros(0, np.uint64)

        def flush() -> pd.DataFrame:
            nonlocal held, filled, number, before
            parts, lead, size = [], [], []
            for words, (_, _, _, first, last) in zip(hashed([h[0] for h in held]),
                                                     (h[1] for h in held)):
                carried = before if not first else before[:0]
                tokens = np.concatenate([carried, words, np.full(int(last), END)])
                before = np.concatenate([carried, words])[-depth:] if depth else before[:0]
                parts.append(tokens)
                lead.append(len(carried))
                size.append(len(tokens))
            vocabulary, ids = distinct(np.concatenate(parts))
            width = max(1, (int(len(vocabulary) - 1).bit_length() + 7) // 8)
            meta = np.array([[h[1][0], h[1][1] or 0, h[1][1] is not None, h[1][2]] for h in held],
                            np.int64)
            small = zlib.compress(packed(meta, np.array(lead, np.int32), np.array(size, np.int32),
                                         np.array([width])), 1)
            body = packed(*[np.frombuffer(x, np.uint8) for x in (
                small, steps(vocabulary), zlib.compress(planes(ids, width).tobytes(), 1))])
            out = pd.DataFrame({"block": [number], "tokens": [len(ids)], "body": [body]})
            held, filled, number = [], 0, number + 1
            return out

        for batch in batches:
            known = batch["doc_id"].notna().tolist()
            for has, doc_id, text, train in zip(known, batch["doc_id"].tolist(), batch["text"],
                                                batch["train"]):
                cut = list(pieces((text or "").encode("utf-8", "surrogatepass"), piece_bytes))
                for k, part in enumerate(cut):
                    meta = (row, int(doc_id) if has else None, bool(train), k == 0,
                            k == len(cut) - 1)
                    held.append((part, meta))
                    filled += len(part)
                    if filled >= block_bytes:
                        yield flush()
                row += 1
        if held:
            yield flush()

    return rows.mapInPandas(run, "block bigint, tokens bigint, body binary")


class Block:
    """A block's tokens, and for each length of sequences the totals that buckets have told."""

    def __init__(self, body: bytes, drop_bits: int) -> None:
        self.drop = np.uint64(drop_bits)
        small, words, ids = unpacked(body, np.uint8, np.uint8, np.uint8)
        meta, self.lead, self.size, width = unpacked(
            zlib.decompress(small), np.int64, np.int32, np.int32, np.int64)
        self.meta, self.vocabulary = meta.reshape(-1, 4), from_steps(words.tobytes())
        self.ids = from_planes(np.frombuffer(zlib.decompress(ids), np.uint8),
                               int(width[0])).astype(np.int32)
        self.piece = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.offset = np.arange(len(self.ids), dtype=np.int32)
        self.offset -= begin[self.piece]
        self.counted = self.offset >= self.lead[self.piece]
        self.train = self.counted & (self.meta[:, 3] > 0)[self.piece]
        self.grams = [None, self.vocabulary[self.ids]]
        self.totals = [None]

    def sequences(self, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, distinct keys, key number of each place) of the k-word sequences that end at
        these places, inside a document and, from three words on, after a frequent context."""
        if k == 1:
            return np.arange(len(self.ids), dtype=np.int32), self.vocabulary, self.ids
        if len(self.grams) == k:
            longer = self.grams[k - 1][:-1] * np.uint64(3)
            longer += self.grams[1][1:]
            longer = H.mixed(longer)
            longer >>= self.drop
            longer <<= self.drop
            self.grams.append(np.concatenate([np.zeros(min(1, len(self.ids)), np.uint64), longer]))
        may = self.offset >= k - 1
        if k > 2:
            may &= self.context(k - 1) >= least
        places = np.flatnonzero(may).astype(np.int32)
        return places, *distinct(self.grams[k][places])

    def told(self, totals: np.ndarray, places: np.ndarray, number: np.ndarray) -> None:
        """Take the totals of the next length of sequences."""
        wide = np.int64 if totals.max(initial=0) >> 31 else np.int32
        at = np.zeros(len(self.ids), wide)
        at[places] = totals.astype(wide)[number]
        self.totals.append(at)
        k = len(self.totals) - 1
        if k > 3:  # only the last two lengths and words are looked at again
            self.grams[k - 2] = None

    def context(self, k: int) -> np.ndarray:
        """The total of the k words before each place, 0 where there are none in the document."""
        out = np.zeros_like(self.totals[k])
        out[1:] = self.totals[k][:-1]
        out[self.offset < k] = 0
        return out


def words_only(totals: np.ndarray, n_tokens: int, n_types: int) -> np.ndarray:
    return (totals + 0.5) / (n_tokens + 0.5 * (n_types + 1))


def smoothed(count: np.ndarray, context: np.ndarray, shorter: np.ndarray,
             smooth: float) -> np.ndarray:
    return (count + smooth * shorter) / (context + smooth)


# --- what travels -------------------------------------------------------------


def sent(block: int, kind: int, k: int, keys: np.ndarray, values: np.ndarray,
         model: Model) -> list[tuple]:
    """Rows (bucket, block, kind, k, blob) of sorted keys with whole numbers."""
    bucket = in_buckets(keys, model.n_buckets)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]).astype(int)
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b > a:
            packs = zlib.compress(planes(values[a:b].view(np.uint64), 8).tobytes(), 1)
            shown = keys[a:b] if k == 1 else keys[a:b] >> np.uint64(model.drop_bits)
            rows.append((int(bucket[a]), block, kind, k, packed(*[
                np.frombuffer(x, np.uint8) for x in (steps(shown), packs)])))
    return rows


def received(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, packs = unpacked(blob, np.uint8, np.uint8)
    values = from_planes(np.frombuffer(zlib.decompress(packs), np.uint8), 8)
    return from_steps(keys.tobytes()), values.view(np.int64)


SENT = "bucket int, block bigint, kind int, k int, blob binary"
TOLD = ("block bigint, kind int, k int, bucket int, answer binary, types bigint, tokens bigint")


def answered(frame: pd.DataFrame, model: Model) -> pd.DataFrame:
    """A bucket's answers: totals, and one block of those with training occurrences as each key's
    owner; or which contexts are kept."""
    out = []
    for (kind, k), rows in frame.groupby(["kind", "k"]):
        rows = rows.sort_values("block")
        parts = [received(b) for b in rows["blob"]]
        keys, values = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        begins = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        run = np.cumsum(begins) - 1
        total = np.add.reduceat(values[order], np.flatnonzero(begins))
        each = np.empty(len(keys), np.int64)
        each[order] = total[run]
        owner = np.zeros(len(keys), bool)
        if kind == COUNTS:
            filled = np.flatnonzero(values[order] > 0)
            first = np.concatenate([[True], run[filled][1:] != run[filled][:-1]])[:len(filled)]
            owner[order[filled[first]]] = True
        ends = np.cumsum([len(p[0]) for p in parts])
        for j, block in enumerate(rows["block"]):
            mine = slice(ends[j] - len(parts[j][0]), ends[j])
            if kind == COUNTS:
                width = max(1, (int(each[mine].max()).bit_length() + 7) // 8)
                answer = packed(np.array([width]), planes(each[mine].view(np.uint64), width),
                                np.packbits(owner[mine]))
            else:
                answer = packed(np.packbits(each[mine] > model.divergence * UNIT))
            words = kind == COUNTS and k == 1 and j == 0
            out.append((block, kind, k, rows["bucket"].iloc[0], zlib.compress(answer, 1),
                        int((total > 0).sum()) if words else 0, int(total.sum()) if words else 0))
    return pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])


class Answers:
    """What a block was told, in the order of its sorted keys: buckets are ranges of keys."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.parts = {}
        for (kind, k), rows in frame.groupby(["kind", "k"]):
            self.parts[kind, k] = [zlib.decompress(a) for a in rows.sort_values("bucket")["answer"]]

    def counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the block's k-word sequences, and whether the block owns them."""
        totals, owners = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for blob in self.parts.get((COUNTS, k), []):
            width, values, bits = unpacked(blob, np.int64, np.uint8, np.uint8)
            totals.append(from_planes(values, int(width[0])).view(np.int64))
            owners.append(np.unpackbits(bits, count=len(totals[-1])).astype(bool))
        return np.concatenate(totals), np.concatenate(owners)

    def kept(self, k: int, keys: np.ndarray, n_buckets: int) -> np.ndarray:
        """Which of these contexts of the block are in the tree."""
        bucket = in_buckets(keys, n_buckets)
        sizes = np.unique(bucket, return_counts=True)[1]
        bits = [np.unpackbits(unpacked(blob, np.uint8)[0], count=n) for blob, n in
                zip(self.parts.get((GAINS, k), []), sizes)]
        return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)


# --- rounds -------------------------------------------------------------------


def counts_of(b: Block, k: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    places, keys, number = b.sequences(k, model.least)
    return keys, np.bincount(number[b.train[places]], minlength=len(keys)).astype(np.int64)


def contexts_of(b: Block, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct k-word contexts of these places, number of each place's)."""
    if k == 1:
        used = np.zeros(len(b.vocabulary), bool)
        used[b.ids[places - 1]] = True
        return b.vocabulary[used], (np.cumsum(used) - 1)[b.ids[places - 1]]
    return distinct(b.grams[k][places - 1])


def climbed(b: Block, told: Answers, model: Model, upto: int):
    """For k = 1 .. upto: (k, probability after k - 1 words of context, places where the k-word
    context is frequent, their sequences' numbers, totals and owners, probability there). The
    probabilities are the same array each time, changed in between."""
    places, keys, number = b.sequences(1, model.least)
    totals, _ = told.counts(1)
    b.told(totals, places, number)
    p = words_only(b.totals[1], model.n_tokens, model.n_types)
    for k in range(1, upto + 1):
        places, keys, number = b.sequences(k + 1, model.least)
        totals, owners = told.counts(k + 1)
        b.told(totals, places, number)
        context = b.context(k)
        frequent = context[places] >= model.least
        at = places[frequent]
        longer = smoothed(b.totals[k + 1][at], context[at], p[at], model.smooth)
        yield k, p, at, number[frequent], totals, owners, longer
        p[at] = longer


def gains_of(b: Block, k: int, p: np.ndarray, at: np.ndarray, number: np.ndarray,
             totals: np.ndarray, owners: np.ndarray, model: Model
             ) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of k words in the block, and what the sequences that the block owns add to their
    divergence: count times log of leave-one-out probability over that of the shorter context."""
    keys, context = contexts_of(b, k, at)
    sums = np.zeros(len(keys), np.int64)
    once = np.full(len(totals), -1)
    once[number] = np.arange(len(number))
    once = once[(once >= 0) & owners]
    count, around = totals[number[once]], b.context(k)[at[once]].astype(np.int64)
    shorter = p[at[once]]
    gain = count * np.log(smoothed(count - 1, around - 1, shorter, model.smooth) / shorter)
    np.add.at(sums, context[once], np.rint(gain * UNIT).astype(np.int64))
    return keys, sums


def send(block: int, body: bytes, frame: pd.DataFrame, model: Model, turn: int) -> pd.DataFrame:
    """What a block sends in a round: counts of one and two words first, then divergences of k-word
    contexts beside counts of sequences two words longer."""
    b, rows = Block(body, model.drop_bits), []
    if turn == 0:
        for k in (1, 2):
            rows += sent(block, COUNTS, k, *counts_of(b, k, model), model)
    else:
        for k, p, at, number, totals, owners, _ in climbed(b, Answers(frame), model, turn):
            if k == turn:
                rows += sent(block, GAINS, k, *gains_of(b, k, p, at, number, totals, owners, model),
                             model)
        if turn < model.depth:
            rows += sent(block, COUNTS, turn + 2, *counts_of(b, turn + 2, model), model)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])


def scored(body: bytes, frame: pd.DataFrame, model: Model) -> pd.DataFrame:
    """Figures of each piece of a block."""
    b, told = Block(body, model.drop_bits), Answers(frame)
    piece, n = b.piece[b.counted], len(b.size)
    log = lambda x: np.bincount(piece, np.log10(x[b.counted]), n)
    state = None
    for k, p, at, _, _, _, longer in climbed(b, told, model, model.depth):
        if state is None:
            base, state = log(p), p.copy()
        keys, context = contexts_of(b, k, at)
        kept = told.kept(k, keys, model.n_buckets)[context]
        state[at[kept]] = longer[kept]
    if state is None:  # no contexts at all
        totals, _ = told.counts(1)
        b.told(totals, np.arange(len(b.ids)), b.ids)
        state = words_only(b.totals[1], model.n_tokens, model.n_types)
        base = log(state)
    count = lambda x: np.bincount(piece, x[b.counted], n).astype(np.int64)
    ids = pd.array(b.meta[:, 1], "Int64")
    ids[b.meta[:, 2] == 0] = pd.NA
    return pd.DataFrame({
        "row": b.meta[:, 0], "doc_id": ids, "n_tokens": np.bincount(piece, minlength=n),
        "n_known": count(b.totals[1] > 0), "base_score": base, "score": log(state)})


def in_place(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key and written, so that later groups by this key leave it where it is
    and only move what they are joined with. A written table keeps how it is dealt out only if its
    plan is not adaptive, so that is off for this one step."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    parts, before = int(conf.get("spark.sql.shuffle.partitions")), conf.get(name)
    conf.set(name, "false")
    try:
        return C.written(df.repartition(parts, key))
    finally:
        conf.set(name, before)


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, smooth: float = SMOOTH,
          divergence: float = DIVERGENCE, block_bytes: int = BLOCK_BYTES,
          piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    Null and empty texts are one end token. Rows without a doc_id are trained on, not held out;
    repeated rows count and are scored one by one. Words are told apart by 64-bit hashes, longer
    sequences by as many bits as their number asks for (SPARE_BITS). Without training rows every word has the probability that smoothing
    leaves. No documents give no rows."""
    kept = in_place(blocks(docs, depth, block_bytes, piece_bytes), "block")
    model = Model(depth, least, smooth, divergence, kept.agg(F.sum("tokens")).first()[0] or 0)

    def ask(turn: int, told: DataFrame | None) -> DataFrame:
        now = model

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for block, body in zip(batch["block"], batch["body"]):
                    yield send(block, body, None, now, 0)

        def later(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return send(int(left["block"].iloc[0]), left["body"].iloc[0], right, now, turn)

        rows = kept.mapInPandas(first, SENT) if told is None else kept.groupBy("block").cogroup(
            told.groupBy("block")).applyInPandas(lambda a, b: later(a, b), SENT)
        return in_place(rows.groupBy("bucket").applyInPandas(
            lambda f: answered(f, now), TOLD), "block")

    told = ask(0, None)
    sums = told.agg(F.sum("types"), F.sum("tokens")).first()
    model.n_types, model.n_tokens = sums[0] or 0, sums[1] or 0
    for turn in range(1, depth + 1):
        told = told.unionByName(ask(turn, told))
    schema = ("row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, "
              "score double")
    found = kept.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        lambda a, b: scored(a["body"].iloc[0], b, model), schema)
    return found.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in (
        "n_tokens", "n_known", "base_score", "score")]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
