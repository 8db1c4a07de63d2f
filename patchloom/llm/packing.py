"""Best-fit packing of token pieces into sequences, planned on a histogram of lengths.

Documents are tokenized once, in batches; only piece descriptions leave the workers. The plan is
made on the counts of at most ``capacity`` lengths, so the driver's work and the plan's size do not
depend on the number of documents. Pieces then take the planned slots by their rank among pieces of
their length; ranks come from small buckets and a table of their sizes.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm import common as C

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
ROWS_PER_BUCKET = 4_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the workers find the rank file of a public vocabulary."""
    import public_tokenizers
    return public_tokenizers.path(f"{name}.tiktoken")


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Content -> id of the added tokens in the ``tokenizers`` file beside the rank file, if any."""
    path = ranks_path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that look at what is around them")
    return {t["content"]: t["id"] for t in tokens}


class ChunkTokenizer:
    """Byte-level BPE with a cache of chunks.

    The split pattern never joins characters across a space, unless white space stands both before
    and after it, so a text may be cut before each other space, and each chunk, mostly one word,
    tokenized once. Texts are cut at ``added`` tokens first, each of which is one id; without them,
    what looks like one is ordinary text. Ids equal those of the ``tokenizers`` file of the same
    vocabulary (held against it in tests); tiktoken reads the same ranks and is several times as
    fast."""

    SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
    INSIDE = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        import base64

        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.added = added or {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(
            self.added, key=len, reverse=True))) + ")").split

    class Cache(dict):
        """Chunk after a space -> its place in the flat list of ids."""

        def __init__(self, encode):
            self.encode, self.flat, self.starts = encode, [], [0]

        def __missing__(self, chunk):
            self.flat += self.encode(" " + chunk)
            self.starts.append(len(self.flat))
            self[chunk] = len(self.starts) - 2
            return self[chunk]

    def whole(self, text: str) -> bool:
        """Has the text a space between white space?"""
        return any(c + " " in text for c in self.SPACES) and bool(self.INSIDE.search(text))

    def parts(self, text: str) -> list[int]:
        """The ids of a text with added tokens."""
        return [i for k, part in enumerate(self.split(text))
                for i in ([self.added[part]] if k % 2 else self.encode(part))]

    def batch(self, texts) -> Iterator[np.ndarray]:
        """The ids of each text. The cache lives for one batch."""
        cache, found = self.Cache(self.encode), []
        for text in texts:
            if any(token in text for token in self.added):
                found.append((self.parts(text), None))
                continue
            if self.whole(text):
                found.append((self.encode(text), None))
                continue
            chunks = text.split(" ")
            found.append((self.encode(chunks[0]), np.fromiter(
                map(cache.__getitem__, chunks[1:]), dtype=np.int64, count=len(chunks) - 1)))
        flat, starts = np.array(cache.flat, dtype="<u4"), np.array(cache.starts)
        for head, places in found:
            head = np.array(head, dtype="<u4")
            if places is None or not len(places):
                yield head
                continue
            sizes = starts[places + 1] - starts[places]
            ends = np.cumsum(sizes)
            index = np.repeat(starts[places] - (ends - sizes), sizes) + np.arange(ends[-1])
            yield np.concatenate([head, flat[index]])


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
           ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of each document: the ids
    of its whole text and then ``end_id``. Null and empty texts are one piece of length 1."""
    path = ranks_path or vocabulary_path()
    added = added_tokens(path)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (
        ", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        tokenize = ChunkTokenizer(path, public_tokenizers.PATTERN, added)
        for batch in batches:
            out = []
            texts = batch["text"].fillna("")
            for doc_id, ids in zip(batch["doc_id"].astype("Int64").array, tokenize.batch(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    own = ids[start:start + length]
                    row = (None if doc_id is pd.NA else doc_id, k, start, length,
                           zlib.crc32(own.tobytes()))
                    out.append(row + (own.astype("int32").tolist(),) if with_ids else row)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(cut, schema)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best fit, longest first, over counts: (length, first_rank, n, first_sequence, per_sequence,
    offset). Pieces of a length with ranks first_rank.. fill ``per_sequence`` places each of
    consecutive sequences, from ``offset`` on.

    Open sequences are groups of (first id, number) by the room they have. A length takes the
    group with the least room that fits, and fills each of its sequences with as many pieces as
    go in, which is what best fit does piece by piece."""
    room: dict[int, list[tuple[int, int]]] = {}
    slots, next_sequence = [], 0

    def fill(length, rank, left, free, first, number):
        """Fill up to ``number`` sequences; (new rank, new left, sequences used)."""
        per = free // length
        used = 0
        for n, each in ((min(number, left // per), per), (1, left % per)):
            if n and each and left and used < number:
                slots.append((length, rank, n * each, first + used, each, capacity - free))
                if free - each * length:
                    room.setdefault(free - each * length, []).append((first + used, n))
                rank, left, used = rank + n * each, left - n * each, used + n
        return rank, left, used

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for free in sorted(r for r in room if r >= length):
            groups = room.pop(free)
            while groups and left:
                first, number = groups.pop()
                rank, left, used = fill(length, rank, left, free, first, number)
                if used < number:
                    groups.append((first + used, number - used))
            if groups:
                room.setdefault(free, []).extend(groups)
            if not left:
                break
        if left:
            number = math.ceil(left / (capacity // length))
            fill(length, rank, left, capacity, next_sequence, number)
            next_sequence += number
    return slots


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` (from 0) among rows of equal ``key``; ``rows`` must be a written table, so
    that its row ids stay the same. A key with most rows is spread over buckets."""
    n_buckets = max(1, math.ceil(rows.count() / ROWS_PER_BUCKET))
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_bucket", F.pmod(F.xxhash64("_id"), F.lit(n_buckets).cast("bigint")))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n")).select(
        key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy("_id")) - 1
    return rows.withColumn("_inside", inside).join(offsets, [key, "_bucket"]).withColumn(
        "rank", F.col("_offset") + F.col("_inside")).drop("_id", "_bucket", "_inside", "_offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
         ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset: pieces of a sequence lie there without gaps.

    Repeated rows are documents of their own; columns besides doc_id and text are not read. No
    documents give no rows. Which of several pieces of equal length takes which slot is fixed by
    the written pieces' order."""
    spark = docs.sparkSession
    rows = C.written(pieces(docs, capacity, end_id, ranks_path, with_ids))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(
        F.count("*").alias("n")).collect()}  # one row per length, at most ``capacity``
    plan = spark.createDataFrame(
        [(s[0], s[1], s[1] + s[2], s[3], s[4], s[5]) for s in plan_slots(counts, capacity)],
        "length bigint, lo bigint, hi bigint, first bigint, per bigint, base bigint")
    place = F.col("rank") - F.col("lo")
    return ranked(rows, "length").join(F.broadcast(plan), ["length"]).filter(
        (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("first") + F.expr("(rank - lo) DIV per")).alias("sequence_id"),
        (F.col("base") + place % F.col("per") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces packed with ids; a sequence holds at most its capacity."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(
        F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
