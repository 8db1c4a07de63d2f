"""Quality scores from supervised subword embeddings.

A document is the average of learned vectors of its hashed words, byte n-grams of words and word
pairs; a softmax layer on top gives class probabilities; both are trained by stochastic gradient
descent in numpy. Training takes a bounded sample of labelled rows and runs in the driver on their
hashed features. Scoring multiplies vectors and output weights once, so that a document's score is a
mean over a table with one number per feature, and runs over all rows in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm import hashing as H

TABLE_BITS = 17              # hashed features
DIMENSIONS = 16
GRAMS = (3, 4, 5)            # byte n-grams inside words, with a mark at both ends
SAMPLE_ROWS = 3_000          # most labelled rows used for training
EPOCHS = 5
RATE = 0.5
BATCH_DOCS = 8
SEED = 11
THRESHOLD = 0.3
HELD_OUT = 5                 # rows whose crc32(doc_id) is divisible by it are never trained on
EDGE = 32                    # byte that marks a word's ends
REPEATED = np.uint64(0xA24BAED4963EE407)
CHUNK = 1 << 19


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % HELD_OUT == 0, F.lit(False))


def features(data: np.ndarray, owner: np.ndarray, table_bits: int = TABLE_BITS
             ) -> tuple[np.ndarray, np.ndarray]:
    """(slot, end) of all features of a byte array; ``end`` is the byte after a feature, which
    tells its document by ``owner``. White space runs count as one edge mark; words of two documents
    are no pair."""
    space = H.IS_SPACE[data]
    kept = ~space | ~np.concatenate([[False], space[:-1]])
    places = np.flatnonzero(kept)
    text = np.where(space[places], EDGE, data[places]).astype(np.uint64)
    parts, ends = [], []
    drop = np.uint64(64 - table_bits)
    rolled = text
    for size in range(2, max(GRAMS) + 1):
        if len(text) < size:
            break
        rolled = rolled[:len(text) - size + 1] * np.uint64(0x100000001B3) + text[size - 1:]
        if size in GRAMS:
            inner = np.ones(len(rolled), bool)  # edges only at the ends of a gram
            for k in range(1, size - 1):
                inner &= text[k:k + len(rolled)] != EDGE
            mixed = (rolled[inner] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            parts.append((mixed ^ (mixed >> np.uint64(32))) * H.BASE >> drop)
            ends.append(places[np.flatnonzero(inner) + size - 1])
    words, starts = H.word_hashes(data)
    if len(words):
        parts.append(words >> drop)
        ends.append(starts)
        # A pair of equal words is one feature, whatever the word.
        pairs = H.mixed(words[1:] * np.uint64(3) + words[:-1])
        pairs = np.where(words[1:] == words[:-1], REPEATED, pairs) >> drop
        own = owner[starts[1:]] == owner[starts[:-1]]
        parts.append(pairs[own])
        ends.append(starts[1:][own])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(parts).astype(np.int64), np.concatenate(ends)


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, document of each byte) of texts joined by white space, about a chunk at a time. A
    longer text comes alone, cut at white space, or at the chunk's end if it has none."""
    buffer, owner, filled = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(buffer), np.uint8), np.repeat(*np.array(owner, np.int64).T)

    for k, text in enumerate(texts):
        if len(text) <= CHUNK:
            buffer.append(b" " + text + b" ")
            owner.append((k, len(buffer[-1])))
            filled += len(buffer[-1])
            if filled >= CHUNK:
                yield joined()
                buffer, owner, filled = [], [], 0
            continue
        at = 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            if end < len(text):
                end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1 or end
                end = end if end > at else min(len(text), at + CHUNK)
            part = np.frombuffer(b" " + text[at:end] + b" ", np.uint8)
            yield part, np.full(len(part), k, np.int64)
            at = end
    if buffer:
        yield joined()


def encoded(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


# --- training -----------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label, slots, counts): features of at most ``rows`` labelled documents that are not
    held out, in the order of a hash of their ids. Of rows that repeat an id, the least text counts."""
    wanted = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(
        ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(
        F.md5(F.col("doc_id").cast("string"))).limit(rows)
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id", "label").agg(
        F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in encoded(batch["text"]):
                found = [features(*piece)[0] for piece in pieces([text])]
                slots, counts = np.unique(np.concatenate(found), return_counts=True)
                out.append((slots.astype("<i4").tobytes(), counts.astype("<i4").tobytes()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"].astype("int32"),
                                "slots": [s for s, _ in out], "counts": [c for _, c in out]})

    return texts.mapInPandas(run, "doc_id bigint, label int, slots binary, counts binary")


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], table_bits: int = TABLE_BITS,
          dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE,
          seed: int = SEED) -> tuple[np.ndarray, float]:
    """(score per feature, bias) from (label, slots, counts) rows.

    Vectors start small and random, output weights at 0, and the rate falls to 0 over all steps, as
    usual for such models. Each step averages the gradients of a few documents. Classes weigh the
    same in sum, up to a factor of 3."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = ((rng.random((1 << table_bits, dimensions), dtype=np.float32) - 0.5) / dimensions)
    output, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    rows = [(y, s, (c / c.sum()).astype(np.float32)) for y, s, c in rows if len(s)]
    share = np.bincount([y for y, _, _ in rows], minlength=2)
    weight = np.clip(len(rows) / (2 * np.maximum(share, 1)), 1 / 3, 3)
    steps, done = epochs * max(1, -(-len(rows) // BATCH_DOCS)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH_DOCS):
            now = rate * (1 - done / steps)
            done += 1
            batch = [rows[k] for k in order[start:start + BATCH_DOCS]]
            hidden = np.array([c @ vectors[s] for _, s, c in batch])
            logits = hidden @ output.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = np.array([b[0] for b in batch])
            p[np.arange(len(batch)), y] -= 1
            p *= weight[y][:, None].astype(np.float32) / len(batch)
            back = p @ output
            output -= now * p.T @ hidden * 20
            bias -= now * p.sum(0)
            for (_, s, c), g in zip(batch, back):
                # Mean features get small steps; the factor makes up for the length of texts.
                vectors[s] -= (now * 20 * np.sqrt(len(s))) * c[:, None] * g[None, :]
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality",
        rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """A model from at most ``rows`` labelled documents; without any, one that gives 0.5."""
    found = training_rows(docs, labels, label, rows)
    sample = [(r["label"], np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["counts"], "<i4"))
              for r in sorted(found.toLocalIterator(), key=lambda r: r["doc_id"])]
    return train(sample)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per document.

    The score is the probability of label 1 from the text alone. Null and empty texts have no
    features: their score is the model's bias. Rows without a doc_id are scored and not held out;
    repeated rows are scored one by one. No documents give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bias = shared.value
        for batch in batches:
            total, count = np.zeros(len(batch)), np.zeros(len(batch))
            for data, owner in pieces(encoded(batch["text"])):
                slots, ends = features(data, owner)
                doc = owner[ends]
                total += np.bincount(doc, table[slots], minlength=len(batch))
                count += np.bincount(doc, minlength=len(batch))
            logit = total / np.maximum(count, 1) + bias
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array,
                                "score": 1 / (1 + np.exp(-np.clip(logit, -500, 500)))})

    scored = docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality",
             rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, labels, label, rows), threshold)
