"""Mixing sources to target weights by weighted sampling without replacement (native).

Sources share the words of all documents by weight, up to a number of epochs each. A source's mix
is whole epochs and then a part: documents in the order of exponential keys scaled by their quality
weight (Efraimidis and Spirakis), up to the words that are left. Running sums are taken in buckets
of the key's rank space, whose offsets come from a small table, so that a source with a third of all
rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm import common as C

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 2_000
SEED = "mix"
# Weight of a document by its quality label.
LABEL_WEIGHTS = {1: 2.0, 0: 0.5}
DEFAULT_WEIGHT = 1.0


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) fixed by id and seed: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, get the weights in turn. Targets share the total by
    weight; those above ``max_epochs`` times their size stop there and the rest is shared again.
    Sources that stop are the first k in order of cap per weight, where k is the least number
    after which the next share fits its cap; one sorted pass finds it. Rows here are sources."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (
        (F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint")
    rows = sizes.withColumn("w", choice).withColumn(
        "cap", F.lit(max_epochs).cast("bigint") * F.col("source_size"))
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(every)).withColumn(
        "left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn(
        "left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    fits = F.col("left_words") * F.col("w") <= F.col("cap") * F.col("left_w")
    rows = rows.withColumn("_k", F.row_number().over(by_cap)).withColumn("_fits", fits)
    share = F.min(F.when(F.col("_fits"), F.struct("_k", "left_words", "left_w"))).over(every)
    return rows.withColumn("_s", share).select(
        "source", "source_size", F.when(
            F.col("_s").isNull() | (F.col("_k") < F.col("_s._k")), F.col("cap").cast("double")
        ).otherwise((F.col("_s.left_words") * F.col("w")).cast("double")
                    / F.col("_s.left_w").cast("double")).alias("target"))


def key_share(key: Column) -> Column:
    """The share of a source's documents that have smaller keys, about: keys of weight w are
    exponential with rate w. It rises with the key, so buckets of it are in order and even."""
    below = F.aggregate("powers", F.lit(0.0), lambda total, p: total + p.n * (
        1 - F.exp(-F.pow(F.lit(2.0), p.power / 4) * key)))
    return F.least(below / F.col("n_docs"), F.lit(1.0))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS,
        max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, part (boolean), taken per document.

    ``quality`` is (doc_id, weight > 0), one row per id; documents without one weigh 1. A source's
    target is its whole epochs, taken by all documents, and a rest, taken by documents in key order
    while the words before them are fewer than the rest by at least half of the document, so that
    the sum is off by at most half of one document. A document never counts in the part once its
    source has reached ``max_epochs``. Null texts have size 0; a null source is a source; rows with
    the same id are different documents with the same key, the smaller first. No rows give no rows."""
    sized = docs.select("doc_id", "source", C.word_count(F.col("text")).alias("size"))
    if quality is not None:
        sized = sized.join(quality.select("doc_id", "weight"), "doc_id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(None).cast("double"))
    sized = C.written(sized.select("doc_id", "source", "size", F.coalesce(
        "weight", F.lit(DEFAULT_WEIGHT)).alias("weight")))
    # Weights by quarter powers of two: few rows per source, whatever the weights.
    power = F.round(4 * F.log2("weight")).cast("int")
    shares = sized.groupBy("source", power.alias("power")).agg(
        F.sum("size").alias("words"), F.count("*").alias("n"))
    sizes = shares.groupBy("source").agg(
        F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"),
        F.array_sort(F.collect_list(F.struct("power", "n"))).alias("powers"))
    plan = targets(sizes.select("source", "source_size"), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_epochs)), F.floor(
        F.col("target") / F.col("source_size")).cast("double"))).otherwise(0.0)
    plan = plan.join(sizes.select(F.col("source").alias("_s"), "n_docs", "powers"),
                     F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
        "epochs", epochs.cast("bigint")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn(
        "n_buckets", F.ceil(F.col("n_docs") / ROWS_PER_BUCKET))
    plan = C.written(plan)
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight")
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "rest",
                    "n_buckets", "n_docs", "powers")
    keyed = sized.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
        "key", key).withColumn("bucket", F.floor(
            key_share(F.col("key")) * F.col("n_buckets")).cast("bigint"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("_words")).select(
        F.col("source").alias("_s"), F.col("bucket").alias("_b"),
        F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    start = F.col("_offset") + F.col("_inside")
    part = (F.col("epochs") < max_epochs) & (F.col("rest") > 0) & (
        start + F.col("size") / 2 <= F.col("rest"))
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", part.alias("part"),
        (F.col("size") * (F.col("epochs") + part.cast("bigint"))).alias("taken"))


def repeated(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS,
             max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, columns unchanged.

    Plans are made per doc_id and joined back to the texts; documents taken no time go. Documents
    without words stay once: they have no size to weigh. Rows that share a doc_id all take the
    count of the row the mix takes most; rows without an id come once."""
    plan = mix(docs, quality, weights, max_epochs, seed).withColumn(
        "_times", F.when(F.col("size") > 0, F.col("epochs") + F.col("part").cast("bigint")).otherwise(
            1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("_times").alias("_times"))
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id")
    taken = wide.join(plan, F.col("doc_id") == F.col("_id"), "left").withColumn(
        "_times", F.coalesce("_times", F.lit(1)))
    return taken.filter("_times > 0").select(
        "_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).select("_row.*")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from quality labels; the first of several labels by value counts."""
    weight = F.lit(DEFAULT_WEIGHT)
    for label, value in LABEL_WEIGHTS.items():
        weight = F.when(F.col("quality") == label, F.lit(value)).otherwise(weight)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("quality")).select("doc_id", weight.alias("weight"))
