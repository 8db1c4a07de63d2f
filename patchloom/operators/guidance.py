"""Repository guidance: excerpts, vectors, incremental replacement, retrieval."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from patchloom import constants as C
from patchloom.functions import ids
from patchloom.functions import paths as P
from patchloom.functions import text as T
from patchloom.operators import filters as L

# Functions that run in Python workers travel by value: workers need numpy, pandas
# and Arrow, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK = 1_000    # queries of a repository scored at a time
EMBED_ROWS = 500       # rows embedded together
DECISIONS = "array<struct<id string, title string, decision string, applies_to array<string>>>"
SPAN = "array<struct<first:int,last:int,heading:string>>"
REFERENCE = ["source_id", "kind", "path", "revision", "locator", "excerpt"]


def sorted_scopes(scopes: Column) -> Column:
    return F.array_sort(F.array_distinct(scopes))


def _manifest_entries(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries of all manifests with their text and ``error``: the manifest is unreadable, holds no
    or too many entries, or the entry's path is not valid, or the commit has no such file."""
    entries = F.from_json(
        "manifest", "struct<sources array<struct<path string, applies_to array<string>>>>").sources
    none = F.array().cast("array<string>")
    size = F.size("e")
    rows = manifests.select(
        F.lower("repo_id").alias("repo_id"), "revision", entries.alias("e")).select(
        "repo_id", "revision", F.when(F.coalesce(size, F.lit(-1)) < 1, "manifest").when(
            size > C.MANIFEST_SOURCES, "manifest_size").alias("whole"),
        F.explode_outer("e").alias("s"))
    paths = rows.select("repo_id", "revision", "whole", F.col("s.path").alias("path"),
                        sorted_scopes(F.coalesce("s.applies_to", none)).alias("applies_to"))
    found = paths.join(blobs.select("revision", "path", "content"), ["revision", "path"], "left")
    bad_path = ~F.coalesce(P.is_valid_path(F.col("path")), F.lit(False))
    return found.withColumn("error", F.coalesce(
        "whole", F.when(bad_path, "path").when(F.col("content").isNull(), "file")))


def manifest_errors(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """(repo_id, revision, path, error) of what is wrong with refused manifests."""
    return _manifest_entries(manifests, blobs).filter(F.col("error").isNotNull()).select(
        "repo_id", "revision", "path", "error").distinct()


def manifest_sources(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """Manifest entries with their file text at one commit.

    manifests: repo_id, revision, manifest (JSON); blobs: revision, path, content. A manifest with
    an error is refused whole, so that a snapshot never shrinks unseen; ``manifest_errors`` says
    why."""
    bad = manifest_errors(manifests, blobs).select("repo_id", "revision").distinct()
    return _manifest_entries(manifests, blobs).filter(F.col("error").isNull()).join(
        bad, ["repo_id", "revision"], "left_anti").select(
        "repo_id", "revision", "path", "applies_to", "content")


# --- excerpts ----------------------------------------------------------------


def _spans(lines: Column) -> Column:
    """Line ranges and headings of the chunks of one Markdown text: a fold over
    its lines. Only finished ranges are appended, so the state stays small."""
    def fact(x, i):
        # Most lines are neither heading nor fence; one cheap test tells.
        marked = x.rlike(r"^ {0,3}[#`~]")
        fence = F.when(marked, F.regexp_extract(x, C.FENCE, 1)).otherwise("")
        return F.struct(
            (i + 1).cast("int").alias("no"), F.length(x).cast("int").alias("len"),
            (marked & x.rlike(C.HEADING)).alias("is_heading"),
            F.when(marked, F.substring(F.regexp_extract(x, C.HEADING, 1), 1, C.HEADING_CHARS))
            .otherwise("").alias("heading"),
            fence.alias("fence"),
            (marked & T.is_blank(F.regexp_replace(x, C.FENCE, ""))).alias("bare"))
    facts = F.transform(lines, fact)

    def step(a, x):
        heads = x.is_heading & (a.fence == "")
        flush = (a.n > 0) & (heads | (a.length + x.len > C.CHUNK_CHARS))
        kept_n = F.when(flush, F.lit(0)).otherwise(a.n)
        kept_length = F.when(flush, F.lit(0)).otherwise(a.length)
        closes = F.startswith(x.fence, a.fence) & x.bare
        return F.struct(
            F.when(kept_n == 0, x.no).otherwise(a.first).alias("first"),
            (kept_n + 1).cast("int").alias("n"),
            (kept_length + x.len + 1).cast("int").alias("length"),
            F.when(heads, x.heading).otherwise(a.heading).alias("heading"),
            F.when(x.fence == "", a.fence).when(a.fence == "", x.fence)
            .when(closes, "").otherwise(a.fence).alias("fence"),
            F.when(flush, F.concat(a.out, F.array(F.struct(
                a.first.alias("first"), (x.no - 1).cast("int").alias("last"),
                a.heading.alias("heading"))))).otherwise(a.out).alias("out"))

    zero = F.struct(
        F.lit(1).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("length"),
        F.lit("").alias("heading"), F.lit("").alias("fence"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(facts, zero, step, lambda a: F.when(
        a.n > 0, F.concat(a.out, F.array(F.struct(
            a.first.alias("first"), F.size(lines).cast("int").alias("last"),
            a.heading.alias("heading"))))).otherwise(a.out))


def _with_lines(sources: DataFrame) -> DataFrame:
    return sources.withColumn("lines", T.lines_of(F.col("content")))


def _long_line() -> Column:
    return F.exists("lines", lambda x: F.length(x) > C.CHUNK_CHARS)


def markdown_chunks(sources: DataFrame) -> DataFrame:
    """(repo_id, revision, path, applies_to, chunk_no, locator, text) of Markdown
    sources; one with a line over 1,500 characters gives nothing here and is an
    error in ``snapshot_errors``."""
    md = _with_lines(sources.filter(F.endswith("path", F.lit(".md")))).filter(~_long_line())
    spans = md.select("*", F.posexplode(_spans(F.col("lines"))).alias("no", "s"))
    body = T.join_lines(F.slice(F.col("lines"), F.col("s.first"),
                                F.col("s.last") - F.col("s.first") + 1))
    return spans.select(
        "repo_id", "revision", "path", "applies_to", F.col("no").cast("bigint").alias("chunk_no"),
        F.concat(F.lit("L"), F.col("s.first").cast("string"), F.lit("-L"),
                 F.col("s.last").cast("string")).alias("locator"),
        F.concat(F.col("s.heading"), F.lit("\n"), body).alias("text"))


def _items(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(
        "repo_id",
        ids.reference_id(F.col("repo_id"), F.col("path"), F.lit(kind), F.col("locator"))
        .alias("source_id"),
        F.lit(kind).alias("kind"), "path", "revision", "locator", "excerpt", "scopes")


def markdown_items(sources: DataFrame) -> DataFrame:
    """Trimmed non-blank chunks as items with their source's scopes."""
    return _items(markdown_chunks(sources).filter(~T.is_blank(F.col("text"))).select(
        "repo_id", "revision", "path", "locator", T.strip(F.col("text")).alias("excerpt"),
        sorted_scopes(F.col("applies_to")).alias("scopes")), "markdown")


def _parsed_decisions(sources: DataFrame) -> DataFrame:
    return sources.filter(F.endswith("path", F.lit(".json"))).withColumn(
        "decisions", F.from_json("content", DECISIONS))


def decision_rows(sources: DataFrame) -> DataFrame:
    """One row per decision of a JSON source, with ``duplicate`` set where an id
    repeats inside its source."""
    parsed = _parsed_decisions(sources)
    ids_of = F.transform("decisions", lambda d: d.id)
    return parsed.select(
        "repo_id", "revision", "path", "applies_to", ids_of.alias("ids"),
        F.posexplode("decisions").alias("no", "d")
    ).select(
        "repo_id", "revision", "path", "applies_to", F.col("no").cast("bigint").alias("seq"),
        "d.id", "d.title", "d.decision", F.col("d.applies_to").alias("own_scopes"),
        (F.array_position(F.col("ids"), F.col("d.id")) <= F.col("no")).alias("duplicate"))


def decision_items(sources: DataFrame) -> DataFrame:
    """Title and decision cut to 1,800 characters; own scopes, else the source's."""
    own = F.coalesce("own_scopes", F.array().cast("array<string>"))
    return _items(decision_rows(sources).select(
        "repo_id", "revision", "path", F.col("id").alias("locator"),
        F.substring(F.concat("title", F.lit("\n"), "decision"), 1, C.DECISION_CHARS)
        .alias("excerpt"),
        sorted_scopes(F.when(F.size(own) > 0, own).otherwise(F.col("applies_to")))
        .alias("scopes")), "decision")


def _bad_decisions(decisions: Column) -> Column:
    """Unreadable JSON, a field out of bounds or an id given twice."""
    bad_field = lambda d: (
        ~F.coalesce(d.id.rlike(C.DECISION_ID), F.lit(False))
        | ~F.coalesce(F.length(d.title).between(1, 160), F.lit(False))
        | ~F.coalesce(F.length(d.decision).between(1, C.DECISION_CHARS), F.lit(False))
        | F.coalesce(F.size(d.applies_to) > 16, F.lit(False))
        | F.coalesce(F.exists(d.applies_to, lambda s: ~P.is_valid_path(s)), F.lit(False)))
    d_ids = F.transform(decisions, lambda d: d.id)
    return decisions.isNull() | F.exists(decisions, bad_field) | (
        F.size(F.array_distinct(d_ids)) < F.size(d_ids))


def _source_items(sources: DataFrame) -> DataFrame:
    """Items of all sources in one pass over their texts, with ``_error``; a
    broken source gives one row that only says so."""
    md = F.endswith("path", F.lit(".md"))
    read = sources.select(
        "repo_id", "revision", "path", sorted_scopes(F.col("applies_to")).alias("own"),
        F.when(md, "markdown").otherwise("decision").alias("kind"),
        F.when(md, T.lines_of(F.col("content"))).alias("lines"),
        F.when(~md, F.from_json("content", DECISIONS)).alias("decisions"))
    is_md = F.col("kind") == "markdown"
    judged = read.withColumn("_error", F.when(is_md, _long_line()).otherwise(
        _bad_decisions(F.col("decisions")))).withColumn(
        "spans", F.when(is_md & ~F.col("_error"), _spans(F.col("lines"))))

    def item(locator, excerpt, scopes):
        return F.struct(locator.alias("locator"), excerpt.alias("excerpt"), scopes.alias("scopes"))

    def of_span(s):
        body = T.join_lines(F.slice(F.col("lines"), s["first"], s["last"] - s["first"] + 1))
        return item(
            F.concat(F.lit("L"), s["first"].cast("string"), F.lit("-L"), s["last"].cast("string")),
            T.strip(F.concat(s.heading, F.lit("\n"), body)), F.col("own"))

    def of_decision(d):
        own = F.coalesce(d.applies_to, F.array().cast("array<string>"))
        return item(d.id, F.substring(F.concat(d.title, F.lit("\n"), d.decision), 1,
                                      C.DECISION_CHARS),
                    F.when(F.size(own) > 0, sorted_scopes(own)).otherwise(F.col("own")))
    broken = F.array(item(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("own")))
    items = F.when(F.col("_error"), broken).when(is_md, F.filter(
        F.transform("spans", of_span), lambda i: i.excerpt != "")).otherwise(
        F.transform("decisions", of_decision))
    rows = judged.select("repo_id", "revision", "path", "kind", "_error", F.inline(items))
    return rows.select(
        "repo_id",
        ids.reference_id(F.col("repo_id"), F.col("path"), F.col("kind"), F.col("locator"))
        .alias("source_id"), "kind", "path", "revision", "locator", "excerpt", "scopes", "_error")


def source_errors(sources: DataFrame) -> DataFrame:
    """(repo_id, path, error): bounds that sources break by themselves, a path given twice, and more
    sources than a snapshot may hold (path null). Texts are not read beyond their length."""
    alone = sources.select("repo_id", "path", F.explode(L.broken_bounds(L.source_bounds())).alias("error"))
    counts = sources.groupBy("repo_id", "path").agg(F.count("*").alias("n"))
    doubled = counts.filter("n > 1").select("repo_id", "path", F.lit("duplicate_path").alias("error"))
    many = counts.groupBy("repo_id").agg(F.sum("n").alias("n")).filter(
        F.col("n") > C.MANIFEST_SOURCES).select(
        "repo_id", F.lit(None).cast("string").alias("path"), F.lit("source_count").alias("error"))
    return alone.unionByName(doubled).unionByName(many)


def snapshot_errors(sources: DataFrame) -> DataFrame:
    """Why snapshots are refused: (repo_id, path, error) of ``source_errors``, of sources with a line
    over the limit, unreadable decisions or a repeated decision id (``content``), and of snapshots
    with more than 100 items (``item_count``)."""
    judged = _judged_items(sources).filter("_refused")
    content = judged.filter("_error").select("repo_id", "path", F.lit("content").alias("error"))
    none = F.lit(None).cast("string")
    count = judged.groupBy("repo_id").agg(F.count("*").alias("n"), F.bool_or("_error").alias("e")).filter(
        (F.col("n") > C.SNAPSHOT_ITEMS) & ~F.col("e")).select(
        "repo_id", none.alias("path"), F.lit("item_count").alias("error"))
    return source_errors(sources).unionByName(content).unionByName(count).distinct()


def _judged_items(sources: DataFrame) -> DataFrame:
    """Items with ``_refused``: their repository has a broken source or more than
    100 items.

    Each task keeps 101 rows per repository before the shuffle, errors first, so
    a repository with any number of excerpts costs no more than that; 101 rows are
    enough to know it is refused, and an accepted one loses none."""
    by_repo = Window.partitionBy("repo_id")
    first = _source_items(sources).withColumn("_n", F.row_number().over(
        by_repo.orderBy(F.desc("_error"), "source_id"))).filter(
        F.col("_n") <= C.SNAPSHOT_ITEMS + 1)
    return first.withColumn("_refused", (F.count("*").over(by_repo) > C.SNAPSHOT_ITEMS)
                            | F.bool_or("_error").over(by_repo))


def index_items(sources: DataFrame) -> DataFrame:
    """Items of all snapshots. A snapshot with an error or more than 100 items is refused whole;
    ``snapshot_errors`` says why."""
    return _judged_items(sources).filter(~F.col("_refused")).drop("_n", "_refused", "_error").join(
        source_errors(sources).select("repo_id").distinct(), "repo_id", "left_anti")


def refused_snapshots(sources: DataFrame) -> DataFrame:
    """Repositories whose snapshot ``index_items`` leaves out: (repo_id)."""
    return _judged_items(sources).filter("_refused").select("repo_id").unionByName(
        source_errors(sources).select("repo_id")).distinct()


# --- vectors -----------------------------------------------------------------


def embed_terms(text: Column, dimensions: int = C.DIMENSIONS) -> Column:
    """Words hashed to slots and counted, as a dense vector; a text without words
    gives slot 0 = 1. Slots come from the first 32 bits of MD5.

    Sorted slots are turned into run lengths, and the gaps between runs into
    zeros, so the work is linear in words plus dimensions."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    slots = F.sort_array(F.transform(words, lambda w: (F.conv(
        F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")))
    filled = F.when(F.size(slots) == 0, F.array(F.lit(0))).otherwise(slots)

    def run_ends(s):  # (value, index) where a run of equal slots ends
        return F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                        lambda e: F.coalesce(F.get(s, e.i + 1) != e.x, F.lit(True)))

    def dense(ends):
        zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)

        def run(e, k):
            count = F.when(k == 0, e.i + 1).otherwise(e.i - F.get(ends, k - 1).i)
            gap = F.when(k == 0, e.x).otherwise(e.x - F.get(ends, k - 1).x - 1)
            return F.concat(zeros(gap), F.array(count.cast("float")))
        return F.concat(F.flatten(F.transform(ends, run)),
                        zeros(dimensions - 1 - F.element_at(ends, -1).x))
    return T.let(T.let(filled, run_ends), dense)


def _embedded(batches: Iterator[pa.RecordBatch], vectors: Callable[[pa.Array], pa.Array]
              ) -> Iterator[pa.RecordBatch]:
    """Batches with ``embedding`` of ``text``, at most EMBED_ROWS rows at a time: dense vectors are
    far larger than their texts, so no whole batch of them is held."""
    for batch in batches:
        for start in range(0, batch.num_rows, EMBED_ROWS):
            part = batch.slice(start, EMBED_ROWS)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, vectors(part.column("text"))], [*part.schema.names, "embedding"])


def term_embedder(digest: str = "md5", dimensions: int = C.DIMENSIONS):
    """An embedder over hashed terms: adds ``embedding`` of ``text``.

    Any DataFrame function of this shape is an embedder, such as one around an outside model. This
    one takes EMBED_ROWS rows at a time: words are cut by Arrow, each distinct word of them is hashed
    once, and all are counted together. BLAKE2b ("blake2b"), which the stored vectors of the
    review service use, is no Spark function. With "md5" it equals ``embed_terms``."""
    size = {"digest_size": 4} if digest == "blake2b" else {}

    def slot(word: str) -> int:
        return int.from_bytes(hashlib.new(digest, word.encode(), **size).digest()[:4], "big") % dimensions

    def vectors(texts: pa.Array) -> pa.Array:
        spaced = pc.replace_substring_regex(
            pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string()), "[^a-z0-9]+", " ")
        words = pc.split_pattern(pc.ascii_trim_whitespace(spaced), " ")
        rows = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
        coded = words.flatten().dictionary_encode()
        slots = np.array([slot(w) if w else 0 for w in coded.dictionary.to_pylist()], np.int64)
        counts = np.bincount(rows * dimensions + slots[coded.indices.to_numpy()],
                             minlength=len(texts) * dimensions).astype("float32")
        ends = np.arange(len(texts) + 1, dtype="int32") * dimensions
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(counts), mask=pc.is_null(texts))

    def embedded(rows: DataFrame) -> DataFrame:
        rows = rows.drop("embedding")
        return rows.mapInArrow(lambda batches: _embedded(batches, vectors), StructType(
            [*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))]))

    return embedded


def fixture_embedder(rows: DataFrame) -> DataFrame:
    """The default embedder."""
    return term_embedder()(rows)


def vector_ok(vector: Column, dimensions: int = C.DIMENSIONS) -> Column:
    """Right length, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def check_vectors(rows: DataFrame, dimensions: int = C.DIMENSIONS) -> DataFrame:
    return rows.withColumn("valid", vector_ok(F.col("embedding"), dimensions))


# --- replacement -------------------------------------------------------------


def snapshot_diff(items: DataFrame, store: DataFrame, snapshots: DataFrame,
                  embedder: str = C.EMBEDDER_NAME) -> DataFrame:
    """What to do with each item: unchanged, reuse (its vector), embed or delete.

    snapshots: repo_id of every repository being replaced, also an empty one;
    other repositories do not appear."""
    new = items.select("repo_id", F.struct(*REFERENCE, "scopes").alias("new"), "source_id")
    old_fields = F.struct(*REFERENCE, "scopes")
    old = store.join(snapshots.select("repo_id").distinct(), "repo_id", "left_semi").select(
        "repo_id", "source_id", old_fields.alias("old"), "embedder", "embedding")
    same_embedder = F.col("embedder") == embedder
    action = (
        F.when(F.col("new").isNull(), "delete")
        .when(F.col("old").isNull(), "embed")
        .when(same_embedder & (F.col("new") == F.col("old")), "unchanged")
        .when(same_embedder & (F.col("new.excerpt") == F.col("old.excerpt")), "reuse")
        .otherwise("embed"))
    return new.join(old, ["repo_id", "source_id"], "full").withColumn("action", action)


def replace_snapshot(items: DataFrame, store: DataFrame, snapshots: DataFrame,
                     embed: Callable[[DataFrame], DataFrame] = fixture_embedder,
                     embedder: str = C.EMBEDDER_NAME) -> DataFrame:
    """The replaced repositories' rows after the snapshot; only items marked
    ``embed`` go through the embedder."""
    steps = snapshot_diff(items, store, snapshots, embedder).filter(F.col("action") != "delete")
    kept = steps.filter(F.col("action") != "embed").select("repo_id", "new.*", "embedding")
    fresh = embed(steps.filter(F.col("action") == "embed").select(
        "repo_id", "new.*", F.concat("new.path", F.lit("\n"), "new.excerpt").alias("text")))
    columns = ["repo_id", *REFERENCE, "scopes", "embedding"]
    return kept.select(columns).unionByName(fresh.select(columns)).withColumn(
        "embedder", F.lit(embedder))


# --- retrieval ---------------------------------------------------------------


def _matrix(vectors: pa.Array, size: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors of this size that have a direction."""
    places = np.flatnonzero(lengths == size)
    flat = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
    rows = flat.astype("float64").reshape(-1, size)
    with np.errstate(invalid="ignore", over="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    good = np.isfinite(norms) & (norms > 0)
    return places[good], rows[good] / norms[good, None]


def _same_key(left: pa.Array, right: pa.Array) -> np.ndarray:
    """(left, right): whether two lists of keys have one in common."""
    sizes = [pc.list_value_length(x).fill_null(0).to_numpy() for x in (left, right)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    keys = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode().indices.to_numpy()
    a, b = keys[:len(rows[0])], keys[len(rows[0]):]
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], a, "left")
    n = np.searchsorted(b[order], a, "right") - first
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    out = np.zeros((len(left), len(right)), bool)
    out[np.repeat(rows[0], n), rows[1][order][at]] = True
    return out


def _ranked(queries: pa.Table, items: pa.Table, k: int, least: float) -> tuple[np.ndarray, ...]:
    """(query, item, similarity, rank) of the k best allowed items of each query in a block."""
    lengths = lambda v: np.array([-1 if n is None else n for n in pc.list_value_length(v).to_pylist()])
    one = lambda t, c: t.column(c).combine_chunks()
    qv, sv = one(queries, "_qv"), one(items, "_sv")
    q_len, s_len = lengths(qv), lengths(sv)
    may = _same_key(one(queries, "_keys"), one(items, "_keys"))
    similarity = np.full(may.shape, -np.inf)
    for size in np.intersect1d(q_len[q_len > 0], s_len[s_len > 0]):
        (a, left), (b, right) = _matrix(qv, size, q_len), _matrix(sv, size, s_len)
        similarity[np.ix_(a, b)] = np.round(left @ right.T, 6)
    similarity[~may] = -np.inf
    # Items come sorted by id, so a stable order breaks ties by it.
    order = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(similarity, order, 1)
    q, rank = np.nonzero((best >= least) & np.isfinite(best))
    return q, order[q, rank], best[q, rank], rank + 1


def _scope_keys(path: Column) -> Column:
    """The keys under which items that cover a path are filed: any, the path, all above it."""
    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(
        F.lit("="), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.concat(F.array(F.lit("*")), above)


def _item_keys(scopes: Column) -> Column:
    """The keys of an item: any without scopes, else its scopes that lie below no other of its own, so
    that a path meets an item once at most."""
    some = F.array_distinct(F.array_compact(scopes))
    outer = F.filter(some, lambda s: ~F.exists(
        some, lambda o: (o != s) & F.startswith(s, F.concat(o, F.lit("/")))))
    return F.when(F.size(scopes) == 0, F.array(F.lit("*"))).otherwise(
        F.transform(outer, lambda s: F.concat(F.lit("="), s)))


def scope_match(queries: DataFrame, store: DataFrame) -> DataFrame:
    """Pairs of a query and stored items of its repository and embedder whose scopes cover its path.

    Both sides are filed under scopes, a query under every folder above its path, and joined on
    equal keys. A repository with very many queries is split by adaptive skew handling."""
    asked = queries.withColumn("_key", F.explode(_scope_keys(F.col("query_path"))))
    filed = store.withColumn("_key", F.explode(_item_keys(F.col("scopes"))))
    return asked.join(filed, ["repo_id", "embedder", "_key"]).drop("_key")


def cosine_topk(queries: DataFrame, store: DataFrame, k: int = C.DEFAULT_K,
                min_similarity: float = C.MIN_SIMILARITY, block: int = QUERY_BLOCK,
                load: DataFrame | None = None) -> DataFrame:
    """The k nearest items per query within scope and threshold: (query_id, repo_id, source_id,
    query_path, similarity, rank).

    queries: query_id (unique), repo_id, query_path, embedder, embedding; store: repo_id, source_id,
    embedder, scopes, embedding. A block of about ``block`` queries of a repository meets the
    repository's items, at most 100 by the snapshot's bound, as two matrices, and their scopes as
    keys (see ``scope_match``): an item is sent once per block and not once per pair, and a
    repository with very many queries has many blocks. ``load`` (repo_id, queries) says how many
    queries to expect of each repository, where that is known without making them; else they are
    counted first. Similarity is rounded to 6 places before ranking, so ties go by id."""
    repo = ["repo_id", "embedder"]
    if load is None:
        load = queries.groupBy("repo_id").agg(F.count("*").alias("queries"))
    blocks = load.select("repo_id", F.greatest(F.lit(1), F.ceil(F.col("queries") / block)).cast(
        "int").alias("_blocks"))
    asked = queries.select("query_id", *repo, "query_path", F.col("embedding").alias("_qv"),
                           _scope_keys(F.col("query_path")).alias("_keys")).join(
        blocks, "repo_id").withColumn("_block", F.pmod(
            F.xxhash64("query_id"), F.col("_blocks").cast("bigint")).cast("int")).drop("_blocks")
    items = store.select(*repo, "source_id", F.col("embedding").alias("_sv"),
                         _item_keys(F.col("scopes")).alias("_keys")).join(blocks, "repo_id").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    keys = [*repo, "_block"]
    kept = [f for f in asked.schema if f.name in ("query_id", "repo_id", "query_path")]
    schema = StructType([*kept, StructField("source_id", StringType()),
                         StructField("similarity", DoubleType()), StructField("rank", IntegerType())])
    names = [f.name for f in kept]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source_id")
        q, s, similarity, rank = _ranked(left, right, k, min_similarity)
        out = left.select(names).take(pa.array(q))
        out = out.append_column("source_id", right.column("source_id").take(pa.array(s)))
        return out.append_column("similarity", pa.array(similarity)).append_column(
            "rank", pa.array(rank.astype("int32")))

    return asked.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInArrow(
        lambda a, b: run(a, b), schema)


def guidance_queries(added: DataFrame, limit: int = C.QUERY_FILES) -> DataFrame:
    """The first changed files of each change as query texts."""
    rank = F.row_number().over(Window.partitionBy("change_id").orderBy("file_no"))
    return added.withColumn("_rank", rank).filter(F.col("_rank") <= limit).select(
        "change_id", "file_no", "path",
        F.concat("path", F.lit("\n"), "added_text").alias("query_text"))


def retrieve_guidance(requests: DataFrame, store: DataFrame, repos: DataFrame,
                      k: int = C.DEFAULT_K, min_similarity: float = C.MIN_SIMILARITY,
                      embed: Callable[[DataFrame], DataFrame] = fixture_embedder,
                      embedder: str = C.EMBEDDER_NAME) -> DataFrame:
    """Matches of all changes: (change_id, file_no, changed_path, source_id,
    similarity, rank). requests: output of ``guidance_queries``; repos: change_id,
    repo_id. Only texts of changes with a repository are embedded."""
    queries = embed(requests.withColumn("text", F.col("query_text")).join(
        repos.select("change_id", F.lower("repo_id").alias("repo_id")), "change_id")).select(
        F.struct("change_id", "file_no").alias("query_id"), "repo_id",
        F.col("path").alias("query_path"), F.lit(embedder).alias("embedder"), "embedding")
    load = repos.groupBy(F.lower("repo_id").alias("repo_id")).agg(
        (F.count("*") * C.QUERY_FILES).alias("queries"))  # at most so many for each change
    found = cosine_topk(queries, store, min(k, C.MAX_K), min_similarity, load=load)
    return found.select(
        "query_id.change_id", "query_id.file_no", F.col("query_path").alias("changed_path"),
        "source_id", "similarity", F.col("rank").cast("bigint").alias("rank"))
