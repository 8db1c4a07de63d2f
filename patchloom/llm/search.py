"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

Vectors become sparse rows of whole numbers; a dimension is a term. Candidates are cut into blocks
of bounded size, each with its postings by dimension. Query blocks meet every candidate block by an
equal-key join on block numbers; in a pair, each dimension scatters its weighted postings into dense
score rows, the best k of each row are selected, and the blocks' lists are merged per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm import common as C

SCALE = 256
K = 5
QUERY_STEP = 50
CANDIDATES_PER_BLOCK = 8_192
QUERIES_PER_BLOCK = 512
SCORES_AT_ONCE = 1 << 22        # score cells of a pair held at a time


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that is null or holds
    null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(
        F.lit(float(scale)) * x.cast("double")).cast("bigint")))


def blocks(rows: DataFrame, per_block: int, number: str) -> tuple[DataFrame, int]:
    """(number, ids, dims, starts, values): sparse rows (vec_id, v) in blocks of about
    ``per_block``, by the written row's own number, so that equal ids do not crowd one block. A
    block is columns of postings: values of dimension d are values[starts[d]:starts[d + 1]]."""
    n = max(1, math.ceil(rows.count() / per_block))
    dealt = rows.withColumn("_k", F.pmod(
        F.xxhash64(F.monotonically_increasing_id()), F.lit(n).cast("bigint")).cast("int"))

    def columns(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(v) for v in frame["v"]])
        dim = np.concatenate([np.arange(s) for s in sizes] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        value = np.concatenate([np.asarray(v, np.int64) for v in frame["v"]] or [dim])
        kept = np.flatnonzero(value)
        order = kept[np.argsort(dim[kept], kind="stable")]
        width = int(sizes.max(initial=0))
        starts = np.searchsorted(dim[order], np.arange(width + 1))
        return pd.DataFrame({
            number: [frame["_k"].iloc[0]], "ids": [frame["vec_id"].to_numpy("<i8").tobytes()],
            "at": [row[order].astype("<i4").tobytes()],
            "starts": [starts.astype("<i8").tobytes()],
            "weights": [value[order].astype("<i8").tobytes()]})

    schema = f"{number} int, ids binary, at binary, starts binary, weights binary"
    return dealt.groupBy("_k").applyInPandas(lambda f: columns(f), schema), n


def scores(q: dict, c: dict, lo: int, hi: int) -> np.ndarray:
    """Dense scores of queries lo..hi against a candidate block, one dimension after another."""
    out = np.zeros((hi - lo, len(c["ids"])), np.int64)
    line, part = np.empty((2, out.shape[1]), np.int64)
    for d in range(min(len(q["starts"]), len(c["starts"])) - 1):
        who = slice(q["starts"][d], q["starts"][d + 1])
        at, weight = q["at"][who], q["weights"][who]
        mine = (at >= lo) & (at < hi)
        if not mine.any():
            continue
        where = slice(c["starts"][d], c["starts"][d + 1])
        cells = c["at"][where]
        # Each row occurs once per dimension, so a fancy-indexed sum loses nothing.
        if 4 * len(cells) < out.shape[1]:
            out[np.ix_(at[mine] - lo, cells)] += weight[mine][:, None] * c["weights"][where][None, :]
            continue
        # Long postings are laid out as one line of weights that stays in the cache.
        line[:] = 0
        line[cells] = c["weights"][where]
        for i, w in zip(at[mine] - lo, weight[mine]):
            out[i] += np.multiply(line, w, out=part)
    return out


def best(row: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best of a score row, ties to smaller ids, without the query itself."""
    allowed = np.flatnonzero(ids != own)
    if len(allowed) > k:
        least = np.partition(row[allowed], len(allowed) - k)[len(allowed) - k]
        above = allowed[row[allowed] > least]
        equal = allowed[row[allowed] == least]
        if len(equal) > k:
            equal = equal[np.argpartition(ids[equal], k - 1)[:k]]
        allowed = np.concatenate([above, equal])
    return allowed[np.lexsort((ids[allowed], -row[allowed]))][:k]


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, scale: int = SCALE,
          per_block: int = CANDIDATES_PER_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates.

    Queries are vectors whose vec_id is divisible by ``query_step``, candidates all others than
    those with the query's own id. Vectors that are null or hold null or non-finite components,
    and rows without a vec_id, take no part; an empty vector scores 0. Shorter vectors count as
    filled up with zeros. Repeated rows are candidates of their own, and a repeated query has one
    result. Scores are 64-bit: components of up to 2^24 and 2^14 of them are safe. No vectors give
    no rows."""
    rows = C.written(vectors.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v"))
                     .filter("vec_id IS NOT NULL AND v IS NOT NULL"))
    queries = C.written(rows.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(
        F.min("v").alias("v")))
    c_blocks, n_c = blocks(rows, per_block, "c")
    q_blocks, _ = blocks(queries, QUERIES_PER_BLOCK, "q")
    # Estimates do not see that each query block leaves n_c times, so by size this side would be
    # broadcast, all of its copies through the driver.
    met = q_blocks.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))).select(
        "c", *[F.col(x).alias(f"q_{x}") for x in ("ids", "at", "starts", "weights")]).hint(
        "merge").join(c_blocks, "c")
    kinds = {"ids": "<i8", "at": "<i4", "starts": "<i8", "weights": "<i8"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.to_dict("records"):
                q = {x: np.frombuffer(pair[f"q_{x}"], t) for x, t in kinds.items()}
                c = {x: np.frombuffer(pair[x], t) for x, t in kinds.items()}
                found, step = [], max(1, SCORES_AT_ONCE // max(1, len(c["ids"])))
                for lo in range(0, len(q["ids"]), step):
                    hi = min(lo + step, len(q["ids"]))
                    dense = scores(q, c, lo, hi)
                    for i, own in enumerate(q["ids"][lo:hi]):
                        places = best(dense[i], c["ids"], own, k)
                        found.append((np.full(len(places), own), c["ids"][places],
                                      dense[i][places]))
                yield pd.DataFrame({name: np.concatenate([f[j] for f in found]) for j, name in
                                    enumerate(("query_id", "vec_id", "score"))})

    lists = met.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
