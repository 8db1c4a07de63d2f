"""Documents linked by the Jaccard similarity of their word shingles: a grouped prefix join.

1. One pass gives each document's set size and a 128-bit hash of its set, and counts shingles into
   a sketch of fixed size. Documents with equal sets are one class from here on.
2. Sets are put in one order for all, rare shingles first by the sketch. Two sets that are similar
   enough share a shingle in short prefixes of that order. Documents with equal prefix and size
   form one group.
3. Groups meet at the shingles of their prefixes. Pairs that size, place or parity signatures rule
   out are dropped; what remains are candidate families, and their groups are expanded to
   documents again.
4. Families are verified on whole sets in bounded blocks of documents. A block returns a spanning
   forest of its true links, not all of them, and components are found over those.

Every order of shingles gives the same links, so the sketch only decides how much work there is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm import hashing as H
from patchloom.llm.components import components

SHINGLE = 3
PERCENT = 90
SKETCH_BITS = 21           # counters of the frequency sketch: 8 MB, whatever the input
SKETCH_PARTS = 64
BLOCK_DOCS = 1_024         # documents of one side of a block
FAMILY_DOCS = 2 * BLOCK_DOCS
FAMILY_SHINGLES = 3_000_000
POSTINGS_PER_BUCKET = 150_000
MEETINGS_PER_BUCKET = 2_000
LEAST_BITS, MOST_BITS = 64, 1 << 16
POSTING = np.dtype([("token", "<u8"), ("group", "<i8"), ("n", "<i4"), ("pos", "<i4"),
                    ("docs", "<i4")])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, independent of order."""
    sums = np.array([np.add.reduce(H.mixed(shingles)),
                     np.add.reduce(H.mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64)
    return tuple(int(s) for s in signed(sums))


# --- 1: sizes, classes, frequencies -------------------------------------------


def measured(docs: DataFrame, size: int = SHINGLE, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n, h1, h2 per document, and rows (part, counts) of each task's sketch, in which
    equal sets count once."""
    schema = "doc_id bigint, n bigint, h1 bigint, h2 bigint, part int, counts binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, seen = np.zeros(1 << bits, np.uint32), set()
        for batch in batches:
            rows, new, waiting = [], [], 0
            for text in batch["text"]:
                shingles = H.shingle_set(text, size)
                key = set_hash(shingles)
                rows.append((len(shingles), *key))
                if key not in seen:
                    seen.add(key)
                    new.append(shingles & np.uint64((1 << bits) - 1))
                    waiting += len(shingles)
                if waiting > 2_000_000:
                    sketch += np.bincount(np.concatenate(new).view(np.int64),
                                          minlength=1 << bits).astype(np.uint32)
                    new, waiting = [], 0
            if new:
                sketch += np.bincount(np.concatenate(new).view(np.int64),
                                      minlength=1 << bits).astype(np.uint32)
            out = pd.DataFrame(rows, columns=["n", "h1", "h2"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            out["part"], out["counts"] = pd.array([None] * len(out), "Int32"), None
            yield out
        if seen:
            parts = np.split(sketch, SKETCH_PARTS)
            none = pd.array([None] * SKETCH_PARTS, "Int64")
            yield pd.DataFrame({"doc_id": none, "n": none, "h1": none, "h2": none,
                                "part": pd.array(range(SKETCH_PARTS), "Int32"),
                                "counts": [zlib.compress(p.tobytes(), 1) for p in parts]})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def frequencies(rows: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """The tasks' sketches summed: a fixed 2^bits counters, brought to the driver in parts."""
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << bits) // SKETCH_PARTS, np.uint64)
        for blob in frame["counts"]:
            total += np.frombuffer(zlib.decompress(blob), np.uint32)
        total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pd.DataFrame({"part": [frame["part"].iloc[0]],
                             "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "part int, counts binary"
    sketches = rows.filter("part IS NOT NULL").select("part", "counts")
    # Two steps, so that no task adds more than some hundred sketches of a part.
    halves = sketches.groupBy("part", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("s")).applyInPandas(
        lambda f: add(f), schema)
    parts = halves.groupBy("part").applyInPandas(lambda f: add(f), schema).collect()
    out = np.zeros(1 << bits, np.uint32)
    width = (1 << bits) // SKETCH_PARTS
    for r in parts:
        out[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(
            zlib.decompress(r["counts"]), np.uint32)
    return out


# --- 2: prefixes and groups ---------------------------------------------------


def in_order(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rare first: by the power of two of the estimated frequency, then by hash."""
    rough = np.log2(counts[(shingles & np.uint64(len(counts) - 1)).view(np.int64)] + 1.0)
    return shingles[np.lexsort((shingles, rough.astype(np.int8)))]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def signature_bits(n: int) -> int:
    """Half a bit per shingle at least, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, (n - 1) // 2).bit_length()))


def signature(shingles: np.ndarray) -> bytes:
    """For each of some bits the parity of the set's shingles that hash to it. Two signatures differ
    in no more bits than their sets in shingles."""
    bits = signature_bits(len(shingles))
    slots = (H.mixed(shingles) & np.uint64(bits - 1)).view(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits) & 1).tobytes()


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, n, h1, h2, the prefix (8 bytes per shingle) and the parity signature of each
    document with words."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = "doc_id bigint, n bigint, h1 bigint, h2 bigint, prefix binary, signature binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                shingles = H.shingle_set(text, size)
                n = len(shingles)
                if n:
                    rows.append((doc_id, n, *set_hash(shingles), in_order(
                        shingles, shared.value)[:prefix_length(n, percent)].tobytes(), signature(shingles)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "h1", "h2", "prefix", "signature"])

    return docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).mapInPandas(
        run, schema)


# --- 3: candidate families ----------------------------------------------------


def postings(groups: DataFrame, counts: np.ndarray, n_buckets: int) -> DataFrame:
    """(bucket, blob): a row per input batch and bucket with the prefix entries of that bucket.

    A shingle expected in more than BLOCK_DOCS sets is dealt to salts, and each entry goes to all
    pairs of salts with its own, so that any two entries still meet and no list is longer than two
    blocks, give or take the sketch's error."""
    shared = groups.sparkSession.sparkContext.broadcast(counts)
    noise = int(counts.sum(dtype=np.uint64) // len(counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [np.frombuffer(b, np.uint64) for b in batch["prefix"]]
            if not lists:
                continue
            sizes = np.array([len(x) for x in lists])
            flat = np.zeros(sizes.sum(), POSTING)
            flat["token"] = np.concatenate(lists)
            for name in ("group", "n", "docs"):
                flat[name] = np.repeat(batch[name].to_numpy(), sizes)
            flat["pos"] = np.concatenate([np.arange(s) for s in sizes])
            likely = shared.value[(flat["token"] & np.uint64(len(shared.value) - 1)).view(
                np.int64)].astype(np.int64) - noise
            salts = np.maximum(1, -(-likely // BLOCK_DOCS))
            hot = salts > 1
            parts = [flat[~hot]]
            for s in np.unique(salts[hot]):
                own = flat[salts == s]
                salt = (H.mixed(own["group"].view(np.uint64)) % np.uint64(s)).astype(np.int64)
                for other in range(s):
                    copy = own.copy()
                    pair = np.minimum(salt, other) * s + np.maximum(salt, other) + 1
                    copy["token"] = H.mixed(own["token"] + H.mixed(pair.astype(np.uint64)))
                    parts.append(copy)
            flat = np.concatenate(parts)
            bucket = (H.mixed(flat["token"]) % np.uint64(n_buckets)).astype(np.int64)
            flat, bucket = flat[order := np.argsort(bucket, kind="stable")], bucket[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            yield pd.DataFrame({
                "bucket": bucket[np.concatenate([[0], cut]).astype(int)],
                "blob": [x.tobytes() for x in np.split(flat, cut)]})

    return groups.select("group", "n", "docs", "prefix").mapInPandas(run, "bucket bigint, blob binary")


def feasible(run: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of two lists of entries at one shingle can still be similar: by size, and by
    how much of both sets lies beyond the shared place."""
    a, b = run[:, None], other[None, :]
    small, large = np.minimum(a["n"], b["n"]).astype(np.int64), np.maximum(a["n"], b["n"])
    most = np.minimum(a["n"] - a["pos"], b["n"] - b["pos"]).astype(np.int64)
    return (100 * small >= percent * large) & (
        (100 + percent) * most >= percent * (small + large)) & (a["group"] != b["group"])


def meetings(bucketed: DataFrame, percent: int) -> DataFrame:
    """(meeting, groups): lists of groups that meet at a shingle with some feasible pair, each list
    once per bucket. Longer runs are cut into blocks, of which all pairs are listed."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        entries = np.concatenate([np.frombuffer(b, POSTING) for b in frame["blob"]])
        entries = np.sort(entries, order=["token", "n", "group"])
        cut = np.concatenate([[0], np.flatnonzero(np.diff(entries["token"])) + 1, [len(entries)]])
        found = {}
        for i in np.flatnonzero(np.diff(cut) > 1):
            whole = entries[cut[i]:cut[i + 1]]
            steps = np.cumsum(whole["docs"]) // BLOCK_DOCS
            blocks = np.split(whole, np.flatnonzero(np.diff(steps)) + 1)
            for j, one in enumerate(blocks):
                for other in blocks[j:]:
                    if 100 * int(one["n"][-1]) < percent * int(other["n"][0]):
                        break
                    fits = feasible(one, other, percent)
                    groups = np.union1d(one["group"][fits.any(1)], other["group"][fits.any(0)])
                    if len(groups) > 1:
                        found[groups.tobytes()] = groups
        ids = [int(signed(np.array([set_hash(g.view(np.uint64))[0]]))[0]) for g in found.values()]
        return pd.DataFrame({"meeting": ids, "groups": [g.tolist() for g in found.values()]})

    return bucketed.groupBy("bucket").applyInPandas(
        lambda f: run(f), "meeting bigint, groups array<bigint>")


def possible(n: np.ndarray, docs: np.ndarray, signatures: list[bytes], percent: int) -> np.ndarray:
    """Which of several groups can be similar to another one, by size and signature: sets of
    similarity t differ in at most (1 - t) / (1 + t) of the sum of their sizes. Signatures of
    unequal length are compared at the shorter one, to which the longer folds. A group of several
    documents has as many sets, so only its size tells."""
    fits = np.zeros(len(n), bool)
    many = docs > 1
    if many.any():
        small, large = np.minimum(n[many][:, None], n), np.maximum(n[many][:, None], n)
        ok = 100 * small >= percent * large
        ok[np.arange(len(ok)), np.flatnonzero(many)] = False
        fits[many] |= ok.any(1)
        fits |= ok.any(0)
    sizes = np.where(many, 0, [8 * len(x) for x in signatures])
    for bits in np.unique(sizes[sizes > 0]):
        own, longer = np.flatnonzero(sizes == bits), np.flatnonzero(sizes == 2 * bits)
        at, k = np.concatenate([own, longer]), len(own)
        if len(at) < 2:
            continue
        raw = lambda places: np.frombuffer(b"".join(signatures[j] for j in places), np.uint8)
        rows = raw(own).reshape(k, bits // 8)
        if len(longer):
            halves = raw(longer).reshape(len(longer), 2, bits // 8)
            rows = np.concatenate([rows, halves[:, 0] ^ halves[:, 1]])
        differ = np.zeros((k, len(at)), np.float32)
        for start in range(0, bits // 8, 256):
            part = np.unpackbits(rows[:, start:start + 256], axis=1).astype(np.float32)
            ones = part.sum(1)
            differ += ones[:k, None] + ones[None, :] - 2 * (part[:k] @ part.T)
        small, large = np.minimum(n[own][:, None], n[at]), np.maximum(n[own][:, None], n[at])
        ok = ((100 + percent) * differ <= (100 - percent) * (small + large)) & (
            100 * small >= percent * large)
        ok[np.arange(k), np.arange(k)] = False
        fits[own] |= ok.any(1)
        fits[at] |= ok.any(0)
    return fits


def pruned(lists: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``lists`` without the groups that signatures keep from every other of their list."""
    n_buckets = max(1, math.ceil(lists.count() / MEETINGS_PER_BUCKET))
    rows = lists.select("meeting", F.explode("groups").alias("group")).join(
        groups.select("group", "n", "docs", "signature"), "group").withColumn(
        "bucket", F.pmod(F.xxhash64("meeting"), F.lit(n_buckets)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("meeting")
        meeting, n = frame["meeting"].to_numpy(), frame["n"].to_numpy()
        group, signatures = frame["group"].to_numpy(), list(frame["signature"])
        docs = frame["docs"].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(meeting)) + 1, [len(meeting)]])
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            fits = possible(n[a:b], docs[a:b], signatures[a:b], percent)
            if fits.any():
                out.append((meeting[a], group[a:b][fits].tolist()))
        return pd.DataFrame(out, columns=["meeting", "groups"])

    return rows.groupBy("bucket").applyInPandas(
        lambda f: run(f), "meeting bigint, groups array<bigint>")


# --- 4: verification ----------------------------------------------------------


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Shingles in many sets are multiplied as dense columns,
    the others counted pair by pair."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1]).astype(np.int64)
    df = np.diff(np.concatenate([start, [len(flat)]]))
    out = np.zeros((m, m), np.float32)
    for d in np.unique(df[(df > 1) & (df <= 24)]):
        rows = owner[start[df == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        for part in np.array_split(rows, max(1, rows.size * d // 4_000_000)):
            flat_pairs = (part[:, i].astype(np.int64) * m + part[:, j]).ravel()
            keys, times = np.unique(flat_pairs, return_counts=True)
            out.ravel()[keys] += times
    many = np.flatnonzero(df > 24)
    for part in np.array_split(many, max(1, -(-len(many) // 1024))):
        if len(part):
            dense = np.zeros((m, len(part)), np.float32)
            for c, k in enumerate(part):
                dense[owner[start[k]:start[k] + df[k]], c] = 1
            out += np.triu(dense @ dense.T, 1)
    return out + out.T


def forest(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest (component's smallest id, id) of the true links among the sets."""
    n = np.array([len(s) for s in sets], np.int64)
    common = shared_counts(sets).astype(np.int64)
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        low = np.where(linked, label[None, :], len(sets)).min(1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    smallest = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    return [(int(smallest[k]), int(i)) for k, i in zip(label, ids) if smallest[k] != i]


def verified(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links found in each family of ``members`` (family, doc_id). Texts travel, not sets:
    they are smaller."""
    wanted = members.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").dropDuplicates()

    n_buckets = max(1, math.ceil(members.count() / BLOCK_DOCS))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, own in frame.groupby("family", sort=False):
            sets = [H.shingle_set(t, size) for t in own["text"]]
            links += forest(sets, own["doc_id"].to_numpy(), percent)
        return pd.DataFrame(links, columns=["a", "b"])

    # Many families per bucket; each is bounded, and so is what a bucket holds.
    return members.join(texts, "doc_id").withColumn(
        "bucket", F.pmod(F.xxhash64("family"), F.lit(n_buckets))).groupBy("bucket").applyInPandas(
        lambda f: run(f), "a bigint, b bigint")


def family_members(lists: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(family, doc_id) such that each feasible pair is in some family of bounded size.

    Meetings are first joined to families by shared groups. A family of bounded size is verified
    as a whole, each document once; a larger one at its meetings, which are bounded themselves."""
    first = F.get("groups", F.lit(0))
    links = lists.select(first.alias("a"), F.explode("groups").alias("b")).filter("a <> b")
    family = components(links).withColumnRenamed("node", "group")
    own = groups.filter("docs > 1").select("group", F.col("group").alias("component")).join(
        family.select("group"), "group", "left_anti")
    family = C.written(family.unionByName(own).join(
        groups.select("group", "docs", "n"), "group"))
    sizes = family.groupBy("component").agg(
        F.sum("docs").alias("size"), F.sum(F.col("docs") * F.col("n")).alias("mass"))
    big = C.written(sizes.filter((F.col("size") > FAMILY_DOCS) | (
        (F.col("mass") > FAMILY_SHINGLES) & (F.col("size") > 2))).select("component"))
    small = family.join(big, "component", "left_anti").select(
        F.col("component").alias("family"), "group")
    at = family.join(big, "component", "left_semi")
    # A meeting's id is a hash; one salted away from group ids cannot be taken for a family.
    meets = lists.select("meeting", F.explode("groups").alias("group")).join(
        at.select("group"), "group", "left_semi").select(
        F.xxhash64(F.lit("meeting"), "meeting").alias("family"), "group")
    alone = at.filter("docs > 1").select(
        F.xxhash64(F.lit("group"), "group").alias("family"), "group")
    return small.unionByName(meets).unionByName(alone).join(members, "group").select(
        "family", "doc_id")


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id per document.

    Words are runs of characters other than space and 9 to 13, with A-Z lower-cased; a document's
    set holds its ``size``-word shingles, or all its words as one if they are fewer. Two documents
    link when 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id reachable.
    Null, empty and blank texts have no shingles and link with nothing. Rows without a doc_id keep
    their row, with a null component. Repeated rows are rows of one document; where texts differ
    under one id that is the smallest of two classes, the class that comes first is compared. No
    documents give no rows. Sets are compared by 64-bit hashes of their shingles."""
    seen = C.written(measured(docs, size))
    counts = frequencies(seen)
    rows = seen.filter("part IS NULL").select("doc_id", "n", "h1", "h2")
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = C.written(rows.filter(usable).groupBy("n", "h1", "h2").agg(
        F.min("doc_id").alias("doc_id")))
    # Classes to groups of equal prefix and size; a group over BLOCK_DOCS is dealt to several.
    heads = classes.groupBy("doc_id").agg(F.min(F.struct("n", "h1", "h2")).alias("s")).select(
        "doc_id", "s.*")
    found = C.written(prefixes(docs, counts, size, percent).join(
        heads, ["doc_id", "n", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"]).withColumn(
        "p", F.xxhash64("prefix")))
    numbers = found.groupBy("n", "p").agg(F.count("*").alias("c")).filter(f"c > {BLOCK_DOCS // 4}")
    dealt = found.join(numbers, ["n", "p"], "left").withColumn("salt", F.pmod(
        F.xxhash64("doc_id"), F.coalesce(F.ceil(4 * F.col("c") / BLOCK_DOCS), F.lit(1))))
    heads = dealt.groupBy("n", "p", "salt").agg(
        F.min("doc_id").alias("group"), F.count("*").alias("docs"))
    members = C.written(dealt.select("doc_id", "n", "p", "salt").join(
        heads, ["n", "p", "salt"]).select("doc_id", "group", "n", "docs"))
    groups = found.select("doc_id", "prefix").join(members.filter("doc_id = group"), "doc_id").select(
        "group", "n", "docs", "prefix")
    total = found.agg(F.sum(F.length("prefix")) / 8).first()[0] or 0
    n_buckets = max(1, math.ceil(total / POSTINGS_PER_BUCKET))
    met = C.written(meetings(postings(groups, counts, n_buckets), percent).dropDuplicates(
        ["meeting"]))
    heads = members.filter("doc_id = group").select("group", "docs", "n")
    lists = C.written(pruned(met, heads.join(found.select(
        F.col("doc_id").alias("group"), "signature"), "group"), percent))
    families = C.written(family_members(lists, heads, members.select("doc_id", "group")))
    labels = components(C.written(verified(families, docs, size, percent)))
    named = C.written(classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "n", "h1", "h2", F.coalesce("component", "doc_id").alias("component_id")))
    return rows.filter(usable).join(named, ["n", "h1", "h2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.filter(~usable).select("doc_id", F.col("n").alias("n_shingles"),
                                    F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; of rows with
    that doc_id all stay. Documents without words or without id stay."""
    heads = link(docs, size, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(heads, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
