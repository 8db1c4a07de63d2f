"""Quality rules whose thresholds adapt to language and source (native).

Four features per document are counted into log-linear histograms, a quantile sketch that merges
by adding counts: per language and source, then summed to languages and to all. A feature beyond
the upper fence of its group is a rejection. Everything is DataFrame work; the only shuffles are
partial counts of at most a few thousand buckets per group and feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm import common as C

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Feature -> the least distance of its fence from the upper quartile, in the feature's unit.
SLACK = {
    "symbols_permille": 150,     # symbols per 1,000 words
    "dup_lines_permille": 400,   # repeated lines per 1,000 lines with a word
    "repeats_permille": 400,     # words in repeated windows per 1,000 words
    "word_centichars": 500,      # hundredths of a character per word
}
FENCE = 3                        # interquartile ranges above the upper quartile
MIN_GROUP = 200                  # smaller groups use their language's sketch, then that of all
SUB_BITS = 5                     # 2^5 sub-buckets per power of two: within 1/32 of a value
MAX_BROADCAST_GROUPS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    A word is a run of characters other than space and 9 to 13. n_lines counts the \\n-split lines
    that hold a word, n_dup_lines those equal to an earlier one. n_repeat_words counts words inside
    3-word windows that occur twice or more in the text (windows are compared by a 64-bit hash).
    A null text counts as empty: all zeros. Columns of these names in ``df`` are replaced."""
    w, lines, hashes, sorted_, flagged = C.fresh(
        df, "_w", "_lines", "_hashes", "_sorted", "_flagged")
    value = F.coalesce(F.col(text), F.lit(""))
    n = F.size(w)
    triples = F.arrays_zip(w, F.slice(w, 2, F.greatest(n, F.lit(1))),
                           F.slice(w, 3, F.greatest(n, F.lit(1))))
    out = df.withColumn(w, C.words_of(F.col(text))).withColumn(
        lines, F.filter(F.split(value, "\n"), lambda s: s.rlike(C.WORD)))
    out = out.withColumn("n_words", F.size(w).cast("bigint")).withColumn(
        "word_chars", F.length(F.array_join(w, "")).cast("bigint")).withColumn(
        "n_symbols", F.length(F.regexp_replace(value, f"[^{SYMBOLS}]+", "")).cast("bigint")
    ).withColumn("n_lines", F.size(lines).cast("bigint")).withColumn(
        "n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"))
    # One hash per window, sorted with its place: equal windows become neighbours.
    out = out.withColumn(hashes, F.when(n >= 3, F.slice(F.transform(
        triples, lambda z: F.xxhash64(z)), F.lit(1), n - 2))).drop(w, lines)
    out = out.withColumn(sorted_, F.sort_array(F.arrays_zip(
        F.col(hashes).alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("p")))).drop(hashes)
    # The sorted array stays one column: a field taken out of it in a projection would be put back
    # into the lambda, which then reads the whole array for each element.
    same = lambda x, j: F.coalesce(F.get(sorted_, j).h == x.h, F.lit(False))
    out = out.withColumn(flagged, F.sort_array(F.filter(F.transform(sorted_, lambda x, i: F.when(
        same(x, i - 1) | same(x, i + 1), x.p)), lambda p: p.isNotNull()))).drop(sorted_)
    covered = F.transform(flagged, lambda p, i: F.least(
        F.lit(3), F.coalesce(F.get(flagged, i + 1) - p, F.lit(3))))
    repeats = F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, b: a + b),
                         F.lit(0).cast("bigint"))
    # Counts leave a generator: Catalyst pushes no filter below it, which would put whole arrays
    # back into lambdas.
    return out.withColumn("n_repeat_words", repeats).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in COUNTS],
        F.inline(F.array(F.struct(*COUNTS))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Whole numbers, so that buckets are exact in any engine; null without words or lines."""
    per = lambda a, b, k: F.expr(f"CASE WHEN {b} > 0 THEN ({k} * {a}) DIV {b} END")
    return {
        "symbols_permille": per("n_symbols", "n_words", 1000),
        "dup_lines_permille": per("n_dup_lines", "n_lines", 1000),
        "repeats_permille": per("n_repeat_words", "n_words", 1000),
        "word_centichars": per("word_chars", "n_words", 100),
    }


def bucket_of(value: Column) -> Column:
    """Log-linear bucket: the value itself below 2^(SUB_BITS+1), then 2^SUB_BITS per octave."""
    shift = F.length(F.bin(value)) - 1 - SUB_BITS
    return F.when(value < (2 << SUB_BITS), value).otherwise(
        shift * (1 << SUB_BITS) + F.call_function("shiftright", value, shift.cast("int")))


def bucket_top(bucket: Column) -> Column:
    """The largest value that falls into the bucket."""
    shift = F.greatest(F.call_function("shiftright", bucket, F.lit(SUB_BITS)) - 1, F.lit(0))
    mantissa = bucket - shift * (1 << SUB_BITS)
    return F.when(bucket < (2 << SUB_BITS), bucket).otherwise(
        F.call_function("shiftleft", mantissa + 1, shift.cast("int")) - 1)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n): one mergeable histogram per group and feature, over
    documents that pass the base rules."""
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("feature"), value.alias("value"))
                              for name, value in features().items()]))
    return measured.filter(~base_failed()).select("lang", "source", *COUNTS).select("lang", "source", rows).filter(
        F.col("value").isNotNull()).groupBy(
        "lang", "source", "feature", bucket_of(F.col("value")).cast("bigint").alias("bucket")
    ).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, total, q1, q3) of merged sketches: the top value of the first bucket whose
    running count reaches the quantile."""
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "feature")
    ranked = merged.withColumn("total", F.sum("n").over(group)).withColumn(
        "upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow))).withColumn(
        "top", bucket_top(F.col("bucket")))
    reach = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("top")))
    return ranked.groupBy(*keys, "feature", "total").agg(
        reach(1).alias("q1"), reach(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <feature columns>): the fence of each feature, from the finest of (language
    and source, language, all) that has MIN_GROUP documents; the last is always used as it is."""
    slack = F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair])
    fence = lambda q: (F.col("q3") + F.greatest(
        FENCE * (F.col("q3") - F.col("q1")), slack[F.col("feature")])).cast("bigint")
    level = lambda keys, name: quartiles(sketch, keys).select(
        *keys, "feature", F.col("total").alias(f"{name}_n"), fence(None).alias(name))
    fine, lang, all_ = (level(["lang", "source"], "fine"), level(["lang"], "per_lang"),
                        level([], "overall"))
    best = fine.alias("f").join(
        lang.alias("l"), F.col("f.lang").eqNullSafe(F.col("l.lang"))
        & (F.col("f.feature") == F.col("l.feature"))).join(
        all_.alias("a"), F.col("f.feature") == F.col("a.feature")).select(
        "f.lang", "f.source", "f.feature", F.when(F.col("fine_n") >= MIN_GROUP, F.col("fine")).when(
            F.col("per_lang_n") >= MIN_GROUP, F.col("per_lang")).otherwise(
            F.col("overall")).alias("fence"))
    return best.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("feature") == name, F.col("fence"))).alias(f"max_{name}")
        for name in SLACK])


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds base_failed and kept. Groups without a fence (no document passed the base rules) have
    only base failures. Fences are one row per language and source: up to MAX_BROADCAST_GROUPS
    rows they are broadcast, beyond that joined by shuffle."""
    fences = fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                           *[f"max_{name}" for name in SLACK])
    if fences.count() <= MAX_BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("_lang"))
                           & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = [F.coalesce(value <= F.col(f"max_{name}"), F.lit(True))
              for name, value in features().items()]
    verdict = within[0]
    for w in within[1:]:
        verdict = verdict & w
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict).drop(
        "_lang", "_source", *[f"max_{name}" for name in SLACK])


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept per document; texts are read once.

    Null texts have no words and fail the base rules. Null languages and sources are groups of
    their own. Repeated rows are rated one by one; no rows in give no rows out."""
    measured = C.written(base_columns(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    fences = C.written(thresholds(sketches(measured)))
    return judge(measured, fences).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected documents, columns unchanged. Texts are never shuffled: fences
    come from one pass, a second one measures and filters."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         "text", "lang", "source")
    fences = C.written(thresholds(sketches(base_columns(docs.select("text", "lang", "source")))))
    kept = judge(base_columns(packed), fences).filter("kept")
    return kept.select("_row.*")
