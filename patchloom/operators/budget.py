"""Packing file contexts into prompts of limited size."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import paths as P
from patchloom.functions import text as T

# Functions that run in Python workers travel by value: workers need numpy and
# pandas, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT = 4096       # file positions per segment of a change
BUCKETS = 64         # groups that segments, and changes, are dealt to per step

SEGMENT_KEY = ["change_id", "p", "segment"]
CHUNK_SCHEMA = "change_id bigint, seq bigint, chunk_no bigint"


def available_tokens(max_prompt: int = C.MAX_PROMPT_TOKENS, system: int = C.SYSTEM_TOKENS) -> int:
    return max_prompt - system


def file_priority(contexts: DataFrame) -> DataFrame:
    """Adds ``tokens`` and ``priority``. Packing order is priority from high to
    low, then ``seq``."""
    start = F.col("priority") if "priority" in contexts.columns else F.lit(0)
    return contexts.withColumns({
        "tokens": T.context_tokens(F.col("context_text")),
        "priority": P.packing_priority(F.col("path"), start)})


def _next_break(ends: np.ndarray, start: int, used: int, limit: int) -> int:
    """Position of the first file that does not fit, from ``start`` with ``used``
    tokens taken; ``ends`` are running token sums."""
    before = ends[start - 1] if start else 0
    return int(np.searchsorted(ends, limit - used + before, side="right"))


def _runs(rows: pd.DataFrame, keys: list[str]):
    """(key, first, end) of runs of equal keys in sorted rows."""
    if not len(rows):
        return
    values = rows[keys].to_numpy()
    cut = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
    for a, b in zip([0, *cut], [*cut, len(rows)]):
        yield tuple(int(v) for v in values[a]), a, b


def _segment_effect(tokens: np.ndarray, limit: int) -> tuple:
    """A segment as a step function of the tokens taken on entry: for each way it
    can first break, how many chunks it starts and what it leaves taken. Chains
    from neighbouring breaks soon meet, so few distinct steps are left."""
    ends, n = np.cumsum(tokens), len(tokens)
    starts, left = np.zeros(n + 1, "int64"), np.zeros(n + 1, "int64")
    for k in range(n - 1, -1, -1):
        # tokens[k] alone may exceed the limit; it still fills its chunk alone
        nxt = max(_next_break(ends, k, 0, limit), k + 1)
        if nxt >= n:
            starts[k], left[k] = 1, ends[-1] - (ends[k - 1] if k else 0)
        else:
            starts[k], left[k] = 1 + starts[nxt], left[nxt]
    steps = []  # (entry tokens from which on, chunks started, tokens left)
    for k in range(n - 1, -1, -1):
        floor = limit - ends[k] + 1  # first break at k or before from here on
        if not steps or steps[-1][1:] != (starts[k], left[k]):
            steps.append((int(max(floor, 0)), int(starts[k]), int(left[k])))
    return (int(ends[-1]), int(tokens[0]), *[[s[i] for s in steps] for i in range(3)])


def _effects(limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*SEGMENT_KEY, "seq"])
        tokens = rows["tokens"].to_numpy()
        return pd.DataFrame(
            [(*key, *_segment_effect(tokens[a:b], limit)) for key, a, b in _runs(rows, SEGMENT_KEY)],
            columns=[*SEGMENT_KEY, "total", "first_tokens", "floors", "starts", "lefts"])
    return run


def _chain(limit: int):
    """Tokens taken and chunk number on entry to each segment of a change, in
    order; works on one short row per segment."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, change = [], None
        for r in rows.sort_values(SEGMENT_KEY).itertuples(index=False):
            if r.change_id != change:
                change, used, chunk, fresh = r.change_id, 0, 0, True
            out.append((r.change_id, r.p, r.segment, used, chunk, fresh))
            hit = int(np.searchsorted(np.asarray(r.floors), used, side="right")) - 1
            if used + r.total <= limit:
                used += r.total
            else:
                # Floors grow, so the last one not above ``used`` is the first break.
                opened = int(r.starts[hit])
                # The very first file opens chunk 0 even if it does not fit.
                chunk += opened - (1 if fresh and r.first_tokens > limit else 0)
                used = int(r.lefts[hit])
            fresh = False
        return pd.DataFrame(out, columns=[*SEGMENT_KEY, "used", "chunk", "fresh"])
    return run


def _number(limit: int):
    def run(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*SEGMENT_KEY, "seq"])
        entry = {tuple(int(v) for v in e[:3]): e[3:] for e in entries[
            [*SEGMENT_KEY, "used", "chunk", "fresh"]].itertuples(index=False, name=None)}
        tokens, numbers = rows["tokens"].to_numpy(), np.empty(len(rows), "int64")
        for key, a, b in _runs(rows, SEGMENT_KEY):
            ends, (used, chunk, fresh), at = np.cumsum(tokens[a:b]), entry[key], 0
            while at < b - a:
                stop = _next_break(ends, at, used, limit)
                if stop <= at:  # the file at hand does not fit: it starts a chunk
                    chunk += 0 if fresh and at == 0 else 1
                    stop = max(_next_break(ends, at, 0, limit), at + 1)
                numbers[a + at:a + stop] = chunk
                at, used = stop, limit + 1  # whatever comes next did not fit
        return pd.DataFrame({"change_id": rows["change_id"].to_numpy(),
                             "seq": rows["seq"].to_numpy(), "chunk_no": numbers})
    return run


def chunk_numbers(files: DataFrame, limit: int, segment: int = SEGMENT,
                  buckets: int = BUCKETS) -> DataFrame:
    """(change_id, seq, chunk_no) from change_id, seq, tokens, priority.

    Next-fit is a fold, but a segment of a change can be worked out without what came before it,
    as a step function. Segments of all changes are worked out side by side; only the functions,
    one short row per segment, are chained per change; then the segments are numbered side by
    side. Changes of any size take this way. A group holds a share of all segments, not one."""
    keyed = files.select(
        "change_id", (-F.col("priority")).alias("p"),
        F.floor(F.col("seq") / segment).cast("bigint").alias("segment"), "seq", "tokens",
        F.pmod(F.xxhash64("change_id", -F.col("priority"), F.floor(F.col("seq") / segment)),
               F.lit(buckets)).alias("bucket"))
    effects = keyed.groupBy("bucket").applyInPandas(
        _effects(limit),
        "change_id bigint, p bigint, segment bigint, total bigint, first_tokens bigint, "
        "floors array<bigint>, starts array<bigint>, lefts array<bigint>")
    entries = effects.groupBy(F.pmod(F.xxhash64("change_id"), F.lit(buckets))).applyInPandas(
        _chain(limit), "change_id bigint, p bigint, segment bigint, used bigint, chunk bigint, "
        "fresh boolean").withColumn("bucket", F.pmod(
            F.xxhash64("change_id", "p", "segment"), F.lit(buckets)))
    return keyed.groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInPandas(
        _number(limit), CHUNK_SCHEMA)


def pack_chunks(contexts: DataFrame, max_prompt: int = C.MAX_PROMPT_TOKENS,
                system: int = C.SYSTEM_TOKENS, segment: int = SEGMENT) -> DataFrame:
    """Next-fit packing in priority order; a file over the budget has a chunk of
    its own. Only ids and numbers are shuffled, never the texts."""
    sized = file_priority(contexts).select("change_id", "seq", "path", "tokens", "priority")
    chunks = chunk_numbers(sized, available_tokens(max_prompt, system), segment)
    return sized.join(chunks, ["change_id", "seq"])


def truncate_context(text: Column, max_chars: Column) -> Column:
    """Cut to a length: back to a line end past 80 %, then to the first marker
    whose last place is past 60 %, and a notice. Shorter texts stay whole."""
    def at_line_end(cut):
        return T.let(T.last_index(cut, "\n"), lambda i: F.when(
            i > max_chars * 0.8, F.substr(cut, F.lit(1), i)).otherwise(cut))

    def after(cut, marker):
        return T.let(T.last_index(cut, marker), lambda i: F.when(
            i > max_chars * 0.6, F.substr(cut, F.lit(1), i + len(marker))))

    def at_marker(cut):
        return F.concat(F.coalesce(*[after(cut, m) for m in C.TRUNCATION_MARKERS], cut),
                        F.lit(C.TRUNCATION_NOTICE))
    start = F.substr(text, F.lit(1), max_chars.cast("int"))
    return F.when(F.length(text) <= max_chars, text).otherwise(
        T.let(T.let(start, at_line_end), at_marker))


def prompt_chunks(contexts: DataFrame, max_prompt: int = C.MAX_PROMPT_TOKENS,
                  system: int = C.SYSTEM_TOKENS) -> DataFrame:
    """Each file's text cut to the chunk's characters divided by its files."""
    packed = pack_chunks(contexts, max_prompt, system)
    sizes = packed.groupBy("change_id", "chunk_no").agg(F.count("*").alias("files_in_chunk"))
    chars = available_tokens(max_prompt, system) * 7 // 2
    rows = packed.join(sizes, ["change_id", "chunk_no"]).join(
        contexts.select("change_id", "seq", "context_text"), ["change_id", "seq"])
    return rows.select(
        "change_id", "seq", "path", "chunk_no",
        truncate_context(F.col("context_text"), F.floor(F.lit(chars) / F.col("files_in_chunk")))
        .alias("context_text"))
