import re
from collections import Counter

from pyspark.sql import functions as F

from patchloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark, make_docs, odd_rows, prose):
    extra = [(500, "a a a a"), (501, "x y z x y z"), (502, "l\nl\n \nl\nm # *** <|>"),
             (503, "a b a b a b c"), (504, "é\u00a0ü 🎈🎈 z")]
    docs = make_docs(odd_rows + prose + extra)
    got = [tuple(r) for r in Q.base_columns(docs).select(*Q.COUNTS, "text").collect()]
    assert all(r[:-1] == brute(r[-1]) for r in got) and len(got) == docs.count()


def test_bucket_bounds(spark):
    values = spark.range(0, 70_000).select(F.col("id").alias("v"), Q.bucket_of(F.col("id")).alias(
        "bucket")).withColumn("top", Q.bucket_top(F.col("bucket")))
    bad = values.filter((F.col("top") < F.col("v")) | (F.col("top") > F.col("v") * 33 / 32 + 1))
    assert bad.count() == 0
    assert values.groupBy("bucket").agg(F.max("v").alias("m"), F.max("top").alias("t")).filter(
        "m <> t AND t < 69000").count() == 0


def test_thresholds_adapt_and_clean_documents_stay(spark, make_docs):
    clean = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) for i in range(8))
    rows = [(i, clean.replace("word", f"w{i}"), "en", "a") for i in range(300)]
    rows += [(1000 + i, clean.replace("word", f"q{i}#"), "en", "code") for i in range(300)]
    rows += [(2000, clean.replace("word", "w#"), "en", "a"), (2001, "too short", "en", "a"),
             (2002, ("same words again " * 40), "en", "a"), (2003, None, None, None)]
    got = {r.doc_id: r for r in Q.rate(make_docs(rows)).collect()}
    assert all(got[i].kept for i in range(300)) and all(got[1000 + i].kept for i in range(300))
    # The same symbols are normal in one source and an outlier in the other.
    assert not got[2000].kept and not got[2000].base_failed
    assert all(got[i].base_failed and not got[i].kept for i in (2001, 2002, 2003))


def test_stage_keeps_columns_and_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS _row",
                                          "4 AS base_failed")
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    want = Q.rate(docs).filter("kept").count()
    assert kept.count() == want
    assert Q.keep_good(make_docs([])).count() == 0 and Q.rate(make_docs([])).count() == 0
