"""Repeated byte strings across documents, by suffix order and longest previous factors.

A string of ``length`` bytes is removed where it also starts in a document with a smaller id. No
task sees all texts: windows are sampled by content, so that equal windows pick the same anchor.

1. Documents are dealt to blocks of bounded size. In each window of ``length`` bytes the ANCHOR-byte
   string with the least hash is its anchor; windows with one anchor are a segment. Each block sends
   its anchors' hashes, each once with the smallest id, to buckets.
2. Anchors that only one document has are done with. For the others, blocks send their distinct
   segments, again once each, to buckets of the anchor.
3. A bucket keeps one of equal segments, compared byte by byte, and builds the suffix array of the
   rest by prefix doubling. The previous and the next smaller document in suffix order give each
   window's longest previous factor; it has an earlier match if that reaches ``length``. Blocks get
   back which windows of each segment have one.
4. Blocks mark the bytes.

A string that a third of all documents hold reaches a bucket once per block. Its variants, if very
many documents hold an anchor, are dealt window by window. Inside a block equal segments are found by
64-bit hashes, as are a bucket's answers, without a look at the bytes. Suffixes are sorted, and factors
measured, only as far as ``length`` bytes and somewhat beyond.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm import hashing as H

LENGTH = 50
ANCHOR = 24
BLOCK_BYTES = 8_000_000
CHUNK = 1 << 15              # bytes worked on at a time: arrays of them stay in the cache
PLACE_BITS = 20              # places inside a chunk
KEY_BITS = 48                # of an anchor's hash; two anchors with one key only cost some work
HOT_DOCS = 4_096             # documents with one anchor, beyond which windows are dealt singly
# A window dealt singly; one that several documents of its block hold, of which the block is told
# in any case.
SINGLE, SHARED_SINGLE = 1, 2
BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)


# --- anchors and segments of a block ------------------------------------------


def chunks(texts: list[bytes], length: int) -> Iterator[tuple]:
    """(buffer, document, start, size, base) of pieces that fill about a chunk. A longer text is
    cut into pieces that overlap by ``length`` - 1, so that each window is in one piece."""
    buffer, rows, filled = [], [], 0

    def flush():
        data = np.frombuffer(b"".join(buffer), np.uint8)
        return (data, *np.array(rows, np.int64).reshape(-1, 4).T)

    for k, text in enumerate(texts):
        for base in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[base:base + CHUNK + length - 1]
            if len(piece) < length:
                continue
            if filled + len(piece) > 2 * CHUNK - 1 - 2 * length and rows:
                yield flush()
                buffer, rows, filled = [], [], 0
            rows.append((k, filled, len(piece), base))
            buffer.append(piece)
            filled += len(piece)
    if rows:
        yield flush()


def window_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` values, by doubling."""
    n, span, out, have = len(values), 1, None, 0
    power, level = H.BASE, values
    while span <= size:
        if size & span:
            if out is None:
                out, have = level, span
            else:
                # ``level`` covers the next ``span`` values after those in ``out``.
                shift = np.uint64(pow(int(H.BASE), span, 1 << 64))
                m = n - have - span + 1
                out = out[:m] * shift + level[have:have + m]
                have += span
        if 2 * span <= size:
            level = level[:-span] * power + level[span:]
            power = power * power
        span *= 2
    return H.mixed(out)


def segments(data, start, size, length: int, anchor: int):
    """(first window, number of windows, anchor hash, piece) per segment of a chunk."""
    with np.errstate(over="ignore"):
        hashes = window_hash(BYTES[data], anchor)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - anchor + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(data) - length + 1
    least = np.minimum(least[:n], least[width - span:width - span + n])
    at = (least & mask).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    inside[start] += 1
    inside[start + size - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    own = at[windows]
    cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1])
                                         | (windows[1:] != windows[:-1] + 1)]))
    first = windows[cut]
    number = np.diff(np.concatenate([cut, [len(windows)]]))
    # The least of several hashes is small; scrambled once more, keys are even over buckets.
    return first, number, H.mixed(hashes[own[cut]]), np.searchsorted(start, first, "right") - 1


def content_keys(data, first, size) -> np.ndarray:
    """A 64-bit key of the bytes [first, first + size), from running sums."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * H.powers(H.BASE, len(data)), out=sums[1:])
    body = (sums[first + size] - sums[first]) * H.powers(H.BASE_INVERSE, len(data))[first]
    return H.mixed(body + H.mixed(size.astype(np.uint64)))


def gathered(data, first, size) -> np.ndarray:
    """The bytes of several spans, one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def in_buckets(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket by the high bits of a key: sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def least_of(keys: np.ndarray, values: np.ndarray):
    """(distinct keys sorted, smallest value, largest value, distinct values, place of a smallest)."""
    order = np.lexsort((values, keys))
    k, v = keys[order], values[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    cut = np.flatnonzero(new)
    last = np.concatenate([cut[1:], [len(k)]]) - 1 if len(k) else cut
    other = np.concatenate([[1], (k[1:] != k[:-1]) | (v[1:] != v[:-1])]) if len(k) else cut
    return k[cut], v[cut], v[last], np.add.reduceat(other, cut) if len(k) else cut, order[cut]


def packed(*arrays) -> bytes:
    """Arrays one after another, each with its length in bytes before it."""
    return b"".join(x for a in arrays for x in (
        np.int64(a.nbytes).tobytes(), np.ascontiguousarray(a).tobytes()))


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(blob, np.int64, 1, at)[0])
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def planes(x: np.ndarray, n_bytes: int) -> np.ndarray:
    """The low bytes of 64-bit values, byte place by byte place, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T)


def from_planes(x: np.ndarray, n_bytes: int) -> np.ndarray:
    out = np.zeros((len(x) // n_bytes, 8), np.uint8)
    out[:, :n_bytes] = x.reshape(n_bytes, -1).T
    return out.view("<u8").ravel()


def rows_by(number: np.ndarray, name: str, make) -> pd.DataFrame:
    """A row (name, blob) per run of equal numbers; ``make`` packs a slice."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]).astype(int)
    runs = [(a, b) for a, b in zip(cut[:-1], cut[1:]) if b > a]
    return pd.DataFrame({name: [int(number[a]) for a, _ in runs],
                         "blob": [make(slice(a, b)) for a, b in runs]})


def block_texts(frame: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    return frame["doc_id"].to_numpy(np.int64), list(frame["bytes"])


# --- the four steps -----------------------------------------------------------


def send_anchors(frame: pd.DataFrame, length: int, anchor: int, n_buckets: int) -> pd.DataFrame:
    ids, texts = block_texts(frame)
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for data, doc, start, size, _ in chunks(texts, length):
        _, _, h, piece = segments(data, start, size, length, anchor)
        hashes.append(h)
        docs.append(ids[doc[piece]])
    keys, low, high, many, _ = least_of(
        np.concatenate(hashes) >> np.uint64(64 - KEY_BITS), np.concatenate(docs))
    block, base = int(frame["block"].iloc[0]), int(low.min(initial=np.iinfo(np.int64).max))
    offset = (low - base).astype(np.uint64)
    width = max(1, (int(offset.max(initial=0)).bit_length() + 7) // 8)
    kind = np.array([width, base, block], np.int64)
    # Keys go as differences of sorted values, ids as differences to the block's smallest.
    return rows_by(in_buckets(keys << np.uint64(64 - KEY_BITS), n_buckets), "bucket",
                   lambda s: packed(kind, planes(np.diff(keys[s], prepend=np.uint64(0)), KEY_BITS // 8),
                                    planes(offset[s], width),
                                    np.minimum(many[s], 65535).astype(np.uint16)))


def find_shared(frame: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for blob in frame["blob"]:
        kind = unpacked(blob, np.int64)[0]
        _, steps, offset, many = unpacked(blob, np.int64, np.uint8, np.uint8, np.uint16)
        keys = np.cumsum(from_planes(steps, KEY_BITS // 8))
        parts.append((keys, from_planes(offset, kind[0]).view(np.int64) + kind[1],
                      many.astype(np.int64), np.full(len(keys), kind[2])))
    keys, low, many, block = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, low, many, block = keys[order], low[order], many[order], block[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([cut, [len(keys)]]))
    shared = (np.maximum.reduceat(low, cut) > np.minimum.reduceat(low, cut)) | (
        np.maximum.reduceat(many, cut) > 1)
    hot = np.add.reduceat(many, cut) > HOT_DOCS
    wanted = np.repeat(shared, sizes)
    keys, block, hot = keys[wanted], block[wanted], np.repeat(hot, sizes)[wanted]
    order = np.argsort(block, kind="stable")
    keys, block, hot = keys[order], block[order], hot[order]
    return rows_by(block, "block", lambda s: packed(keys[s], hot[s].astype(np.uint8)))


def send_segments(frame: pd.DataFrame, shared: pd.DataFrame, length: int, anchor: int,
                  n_buckets: int) -> pd.DataFrame:
    if not len(shared) or not len(frame):
        return pd.DataFrame({"bucket": pd.array([], "int64"), "blob": []})
    wanted, hot = (np.concatenate(x) for x in zip(*[
        unpacked(b, np.uint64, np.uint8) for b in shared["blob"]]))
    order = np.argsort(wanted)
    wanted, hot = wanted[order], hot[order]
    ids, texts = block_texts(frame)
    found = []
    for data, doc, start, size, _ in chunks(texts, length):
        first, number, h, piece = segments(data, start, size, length, anchor)
        short = h >> np.uint64(64 - KEY_BITS)
        place = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
        hit = wanted[place] == short
        single = hit & (hot[place] > 0)
        for own, whole in ((hit & ~single, True), (single, False)):
            f, n, key, p = first[own], number[own], h[own], piece[own]
            if not len(f):
                continue
            if not whole:
                f = gathered(np.arange(len(data)), f, n)
                p, n = np.repeat(p, n), np.ones(len(f), np.int64)
            spans = n + length - 1
            content = content_keys(data, f, spans)
            route = H.mixed(key) if whole else H.mixed(content)
            # Within the chunk each content stays once, with its smallest document.
            _, low, high, _, at = least_of(content, ids[doc[p]])
            alone = np.full(len(at), 0 if whole else SINGLE, np.uint8)
            alone[(alone > 0) & (high > low)] = SHARED_SINGLE
            found.append((content[at], low, spans[at], route[at], alone,
                          gathered(data, f[at], spans[at])))
    if not found:
        return pd.DataFrame({"bucket": pd.array([], "int64"), "blob": []})
    content, low, spans, route, alone, text = (np.concatenate(x) for x in zip(*found))
    begins = np.cumsum(spans) - spans
    keys, low, high, _, at = least_of(content, low)
    shared_here = (high > low) | np.isin(keys, content[alone == SHARED_SINGLE])
    alone[at[(alone[at] > 0) & shared_here]] = SHARED_SINGLE
    at, low = at[order := np.argsort(route[at], kind="stable")], low[order]
    block = np.array([int(frame["block"].iloc[0])], np.int64)
    pack = zstandard.ZstdCompressor(level=3)
    content, spans, begins, route, alone = (
        x[at] for x in (content, spans, begins, route, alone))
    return rows_by(in_buckets(route, n_buckets), "bucket", lambda s: packed(
        block, content[s], low[s], spans[s].astype(np.int32), alone[s], np.frombuffer(
            pack.compress(gathered(text, begins[s], spans[s]).tobytes()), np.uint8)))


def words_at(text: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number in byte order; those beyond ``left`` are 0."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
    words = np.ndarray((len(text) + 1,), ">u8", padded, strides=(1,))[at].astype(np.uint64)
    short = np.flatnonzero(left < 8)
    bits = (8 * (8 - np.maximum(left[short], 0))).astype(np.uint64)
    words[short] = np.where(bits < 64, words[short] >> (bits % 64) << (bits % 64), 0)
    return words


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense ranks from 1 on, order) of keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), np.uint32)
    ranks[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ranks, order


class SuffixArray:
    """Suffixes that begin at ``starts``, in order, of texts that lie one after another and end at
    ``ends``; by prefix doubling. ``levels[k]`` ranks all suffixes by their first 8 * 2^k bytes.
    As only ``length`` bytes are asked for, the last doubling is the first to reach them, and
    suffixes that agree so far keep any order."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int):
        self.text, self.starts = text, starts
        place = np.arange(len(text))
        self.left = np.repeat(ends, np.diff(ends, prepend=0)) - place
        self.levels = [ranked(words_at(text, place, self.left))[0]]
        size = 8
        while 2 * size < length:
            self.levels.append(ranked(self.doubled(size, place))[0])
            size *= 2
        self.order = np.argsort(self.doubled(size, starts))

    def doubled(self, size: int, at: np.ndarray) -> np.ndarray:
        """Keys by twice ``size`` bytes; nothing ranks before anything."""
        ranks = self.levels[-1]
        more = ranks[np.minimum(at + size, len(ranks) - 1)].astype(np.uint64)
        more[self.left[at] <= size] = 0
        return (ranks[at].astype(np.uint64) << np.uint64(32)) | more

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of pairs of suffixes, as far as the levels and
        seven more bytes tell: at least the asked length if that many agree."""
        a, b = self.starts[a], self.starts[b]
        room = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        last = len(self.text) - 1
        for k in [len(self.levels) - 1, *range(len(self.levels) - 1, -1, -1)]:
            x, y = np.minimum(a + out, last), np.minimum(b + out, last)
            out += np.where((out < room) & (self.levels[k][x] == self.levels[k][y]), 8 << k, 0)
        x = words_at(self.text, np.minimum(a + out, last), np.full(len(a), 8))
        y = words_at(self.text, np.minimum(b + out, last), np.full(len(a), 8))
        differ = x ^ y
        for n in (4, 2, 1):
            equal = differ >> np.uint64(64 - 8 * n) == 0
            out += np.where(equal, n, 0)
            differ = np.where(equal, differ << np.uint64(8 * n), differ)
        return np.minimum(out, room)


def previous_smaller(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the nearest earlier, smaller value not before ``first``, or -1. Between a value and
    the place that it points to all are as large, so it may take over that place's pointer."""
    place = np.arange(len(values))
    to = np.where(place > first, place - 1, -1)
    active = np.flatnonzero(to >= 0)
    while len(active):
        active = active[values[to[active]] >= values[active]]
        to[active] = to[to[active]]
        active = active[to[active] >= 0]
    return to


def longest_previous_factors(suffixes: SuffixArray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the length of its longest match that starts in a smaller document, as far as
    ``common`` tells; 0 if that is below ``length``.

    In suffix order the best match among smaller documents is the previous or the next smaller one.
    Both are looked for only while neighbours agree in ``length`` bytes."""
    order = suffixes.order
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    joined = suffixes.common(order[1:], order[:-1]) >= length
    member = np.flatnonzero(np.concatenate([[False], joined]) | np.concatenate([joined, [False]]))
    if not len(member):
        return out
    own, values = order[member], docs[order[member]]
    begins = ~np.concatenate([[False], joined])[member]
    place = np.arange(len(member))
    first = np.maximum.accumulate(np.where(begins, place, 0))
    ends = np.concatenate([begins[1:], [True]])
    last = np.minimum.accumulate(np.where(ends, place, len(place))[::-1])[::-1]
    before = previous_smaller(values, first)
    after = previous_smaller(values[::-1], (len(place) - 1 - last)[::-1])[::-1]
    after = np.where(after >= 0, len(place) - 1 - after, -1)
    for other in (before, after):
        has = np.flatnonzero(other >= 0)
        match = suffixes.common(own[has], own[other[has]])
        out[own[has]] = np.maximum(out[own[has]], match)
    return out


def distinct_segments(content, low, text, begins, spans) -> tuple[np.ndarray, np.ndarray]:
    """(a segment of each text, by its smallest document; which of these each segment equals).
    Segments of one key are compared byte by byte; one that differs stands for itself."""
    order = np.lexsort((low, content))
    new = np.concatenate([[True], content[order][1:] != content[order][:-1]])
    model = np.empty(len(order), np.int64)
    model[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    copies = np.flatnonzero(model != np.arange(len(model)))
    same = spans[copies] == spans[model[copies]]
    for done in range(0, int(spans.max()), 8):
        left = spans[copies] - done
        same &= (left <= 0) | (
            words_at(text, np.minimum(begins[copies] + done, len(text)), left)
            == words_at(text, np.minimum(begins[model[copies]] + done, len(text)), left))
    model[copies[~same]] = copies[~same]
    kept = np.flatnonzero(model == np.arange(len(model)))
    kept = kept[np.argsort(low[kept], kind="stable")]
    number = np.empty(len(model), np.int64)
    number[kept] = np.arange(len(kept))
    return kept, number[model]


def find_earlier(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    parts = []
    for blob in frame["blob"]:
        block, content, low, spans, alone, text = unpacked(
            blob, np.int64, np.uint64, np.int64, np.int32, np.uint8, np.uint8)
        parts.append((np.full(len(content), block[0]), content, low, spans.astype(np.int64), alone,
                      np.frombuffer(zstandard.ZstdDecompressor().decompress(text.tobytes()), np.uint8)))
    block, content, low, spans, alone, text = (np.concatenate(x) for x in zip(*parts))
    del parts
    kept, model = distinct_segments(content, low, text, np.cumsum(spans) - spans, spans)
    text = gathered(text, (np.cumsum(spans) - spans)[kept], spans[kept])
    ends = np.cumsum(spans[kept])
    windows = spans[kept] - length + 1
    begins = np.cumsum(windows) - windows
    starts = np.repeat(ends - spans[kept] - begins, windows) + np.arange(windows.sum())
    docs = np.repeat(low[kept], windows)
    factors = longest_previous_factors(SuffixArray(text, ends, starts, length), docs, length)
    earlier = factors >= length
    # A copy in a document larger than its model's has an earlier match throughout.
    copied = low > low[kept][model]
    number = spans - length + 1
    some = copied | (alone == SHARED_SINGLE)
    some |= np.logical_or.reduceat(earlier, begins)[model]
    chosen = np.flatnonzero(some)
    chosen = chosen[np.argsort(block[chosen], kind="stable")]

    def make(s):
        own = chosen[s]
        flags = gathered(earlier, begins[model[own]], number[own]) | np.repeat(copied[own], number[own])
        return packed(content[own], number[own].astype(np.int32), alone[own], np.packbits(flags))
    return rows_by(block[chosen], "block", make)


def mark(frame: pd.DataFrame, found: pd.DataFrame, length: int, anchor: int) -> pd.DataFrame:
    """Per document: doc_id, n_bytes, starts and ends of its removed runs, and the bytes kept."""
    parts = []
    for blob in found["blob"]:
        content, number, alone, bits = unpacked(blob, np.uint64, np.int32, np.uint8, np.uint8)
        parts.append((content, number.astype(np.int64), alone, np.unpackbits(bits)[:number.sum()]))
    keys, number, alone, flags = ((np.concatenate(x) for x in zip(*parts)) if parts else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)))
    offset = np.cumsum(number) - number
    order = np.argsort(keys, kind="stable")
    keys, offset, singles = keys[order], offset[order], np.sort(keys[alone > 0])
    ids, texts = block_texts(frame)
    # One array of steps for all texts, each with a place more than its bytes.
    places = np.cumsum([0] + [len(t) + 1 for t in texts])
    steps, made = np.zeros(places[-1], np.int32), []
    for data, doc, start, size, base in chunks(texts, length):
        first, n, _, piece = segments(data, start, size, length, anchor)
        shift = places[doc] + base - start
        made.append((first + shift[piece], n, doc[piece],
                     content_keys(data, first, n + length - 1)))
        if len(singles):
            at = gathered(np.arange(len(data)), first, n)
            content = content_keys(data, at, np.full(len(at), length))
            own = np.isin(content, singles)
            at, p = at[own], np.repeat(piece, n)[own]
            made.append((at + shift[p], np.ones(len(at), np.int64), doc[p], content[own]))
    if made:
        begin, n, doc, content = (np.concatenate(x) for x in zip(*made))
        known, low, *_ = least_of(content, ids[doc])
        later = ids[doc] > low[np.searchsorted(known, content)]
        first, end = begin[later], (begin + n)[later] + length - 1
        if len(keys):
            place = np.minimum(np.searchsorted(keys, content), len(keys) - 1)
            told = (keys[place] == content) & ~later
            at = gathered(np.arange(len(steps)), begin[told], n[told])[
                gathered(flags, offset[place[told]], n[told]) > 0]
            first, end = np.concatenate([first, at]), np.concatenate([end, at + length])
        steps += np.bincount(first, minlength=len(steps)).astype(np.int32)
        steps -= np.bincount(end, minlength=len(steps)).astype(np.int32)
    rows = []
    for doc_id, text, place in zip(ids, texts, places):
        gone = np.cumsum(steps[place:place + len(text)]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edge) else text
        rows.append((doc_id, len(text), edge[0::2], edge[1::2], kept))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "starts", "ends", "kept"])


def _planned(docs: DataFrame, length: int, anchor: int, finish, schema: str,
             block_bytes: int) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    blocks = docs.filter("doc_id IS NOT NULL").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n).cast("bigint")).alias("block"), "doc_id",
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    to_block, to_bucket = "block bigint, blob binary", "bucket bigint, blob binary"
    anchors = blocks.groupBy("block").applyInPandas(
        lambda f: send_anchors(f, length, anchor, n), to_bucket)
    shared = anchors.groupBy("bucket").applyInPandas(lambda f: find_shared(f), to_block)
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(
        lambda a, b: send_segments(a, b, length, anchor, n), to_bucket)
    earlier = sent.groupBy("bucket").applyInPandas(lambda f: find_earlier(f, length), to_block)
    return blocks.groupBy("block").cogroup(earlier.groupBy("block")).applyInPandas(
        lambda a, b: finish(mark(a, b, length, anchor)), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, starts, ends (arrays of the removed runs, end exclusive) and kept (the other
    bytes, which may cut a character) per document.

    Texts are UTF-8 bytes. A byte is removed if a string of ``length`` bytes that covers it also
    starts in a document with a smaller doc_id, as the input stands; strings never cross documents.
    Null texts are empty. Rows without a doc_id have no smaller one and are none: they come back
    whole. Rows that repeat a doc_id are compared with smaller ids only, not with each other.
    No documents give no rows."""
    schema = "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"
    none = docs.filter("doc_id IS NULL").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("ends"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    return _planned(docs, length, anchor, lambda f: f, schema, block_bytes).unionByName(none)


def repeat_digests(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: ``remove_repeats`` in figures, with the
    bytes hashed where they are."""
    def finish(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": f["doc_id"], "n_bytes": f["n_bytes"],
            "n_removed": f["n_bytes"] - f["kept"].map(len), "n_spans": f["starts"].map(len),
            "kept_sha256": f["kept"].map(lambda b: hashlib.sha256(b).hexdigest())})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    text = F.coalesce("text", F.lit(""))
    none = docs.filter("doc_id IS NULL").select(
        "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))
    return _planned(docs, length, anchor, finish, schema, block_bytes).unionByName(none)
